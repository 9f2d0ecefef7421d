"""File, filter, tree, chunk and store queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from repoloom.functions import fixed, paths, payloads as pl, text as tx
from repoloom.operators import chunking, filters, rollups, run_totals
from repoloom.operators.code_facts import project_totals
from repoloom.plans.catalog import register
from repoloom.plans.views import EXT_SQL, FILES_SQL, NAME_SQL, files, pick, sql_in, table
from repoloom.sources import files as src_files
from repoloom.sources import store

_PARTS = "string_split(path, '/')"


def _dirs_sql(names: list[str]) -> str:
    return f"list_has_any({_PARTS}, {[filters.clean_dir(d) for d in names]})"


def _glob_sql(patterns: list[str]) -> str:
    import re

    plain = [p for p in patterns if "*" not in p]
    wild = ["[^/]*".join(re.escape(x) for x in p.split("*")) for p in patterns if "*" in p and "/" not in p]
    deep = ["[^/]*".join(re.escape(x) for x in p.split("*")) for p in patterns if "*" in p and "/" in p]
    return (
        f"({NAME_SQL} IN {sql_in(plain)} OR regexp_full_match({NAME_SQL}, '{'|'.join(wild)}')"
        f" OR regexp_matches(path, '(^|/)({'|'.join(deep)})(/|$)'))"
    )


_EXCLUDED = f"({_dirs_sql(fixed.EXCLUDED_DIRS)} OR {_glob_sql(fixed.EXCLUDED_FILES)})"
_CODE, _DOC = sql_in(fixed.CODE_EXTENSIONS), sql_in(fixed.DOC_EXTENSIONS)
_CLASSIFIED = f"""classified AS (
  SELECT file_no, repo, path, text, substr({EXT_SQL}, 2) AS type, {EXT_SQL} IN {_CODE} AS is_code,
    {EXT_SQL} IN {_CODE} AND NOT starts_with(path, 'test_') AND NOT starts_with(path, 'app_')
      AND NOT contains(lower(path), 'test') AS is_implementation, path AS title
  FROM files WHERE {EXT_SQL} IN {_CODE} OR {EXT_SQL} IN {_DOC})"""


@register(
    "a1_read_documents",
    f"""WITH {FILES_SQL}, {_CLASSIFIED} SELECT repo, path, type, is_code, is_implementation, title,
    (length(text) // 4)::BIGINT AS token_count FROM classified WHERE NOT {_EXCLUDED}
    AND length(text) // 4 <= CASE WHEN is_code THEN {fixed.CODE_TOKEN_LIMIT} ELSE {fixed.DOC_TOKEN_LIMIT} END""",
)
def read_documents(spark, sf_dir):
    """The whole ingest: path filter, classification and size gate over a table of files."""
    kept = files(spark, sf_dir).filter(filters.keep_path(F.col("path")))
    gated = filters.size_gate(filters.classify(kept), tx.token_estimate(F.col("text")))
    return gated.select("repo", "path", "type", "is_code", "is_implementation", "title", "token_count")


_HIDDEN_DIRS, _HIDDEN_FILES = sql_in(fixed.TREE_HIDDEN_DIRS), sql_in(fixed.TREE_HIDDEN_FILES)
_VISIBLE = f"""NOT starts_with({NAME_SQL}, '.') AND {NAME_SQL} NOT IN {_HIDDEN_FILES}
  AND len(list_filter({_PARTS}[:-2], lambda p: p LIKE '.%' OR p IN {_HIDDEN_DIRS})) = 0"""


@register(
    "a2_repository_tree",
    f"""WITH {FILES_SQL}, shown AS (SELECT * FROM files WHERE {_VISIBLE}),
    trees AS (SELECT repo, string_agg(path, chr(10) ORDER BY path) AS file_tree FROM (SELECT DISTINCT repo, path FROM shown) GROUP BY 1),
    readme AS (SELECT repo, arg_min(text, (len({_PARTS}), path)) AS readme FROM shown WHERE lower({NAME_SQL}) = 'readme.md' GROUP BY 1)
    SELECT repo, 0::BIGINT AS part_no, file_tree, coalesce(readme, '') AS readme FROM trees LEFT JOIN readme USING (repo)""",
)
def repository_tree(spark, sf_dir):
    return rollups.repository_tree(files(spark, sf_dir))


@register("b5_tree_noise_filter", f"WITH {FILES_SQL} SELECT file_no, path FROM files WHERE {_VISIBLE}")
def tree_noise_filter(spark, sf_dir):
    return files(spark, sf_dir).filter(filters.visible_in_tree(F.col("path"))).select("file_no", "path")


@register(
    "a3_project_scan",
    f"""WITH {FILES_SQL} SELECT file_no, path, lower({EXT_SQL}) AS ext FROM files
    WHERE lower({EXT_SQL}) IN {sql_in(sorted(fixed.LANGUAGE_BY_EXTENSION))}""",
)
def project_scan(spark, sf_dir):
    ext = F.lower(paths.extension(F.col("path")))
    return files(spark, sf_dir).filter(src_files.has_extension(F.col("path"))).select("file_no", "path", ext.alias("ext"))


@register("a4_java_files", f"WITH {FILES_SQL} SELECT file_no, path FROM files WHERE path LIKE '%.java'")
def java_files(spark, sf_dir):
    return files(spark, sf_dir).filter(src_files.has_extension(F.col("path"), src_files.JAVA)).select("file_no", "path")


@register("b1_exclusion_filter", f"WITH {FILES_SQL} SELECT file_no, path FROM files WHERE NOT {_EXCLUDED}")
def exclusion_filter(spark, sf_dir):
    return files(spark, sf_dir).filter(filters.keep_path(F.col("path"))).select("file_no", "path")


_COMPAT = sorted({filters.clean_dir(d, True) for d in fixed.EXCLUDED_DIRS})


@register(
    "b1_exclusion_filter_compat",
    f"""WITH {FILES_SQL} SELECT file_no, path FROM files WHERE NOT list_has_any({_PARTS}, {_COMPAT})
    AND {NAME_SQL} NOT IN {sql_in(fixed.EXCLUDED_FILES)}""",
)
def exclusion_filter_compat(spark, sf_dir):
    return files(spark, sf_dir).filter(filters.keep_path(F.col("path"), compat=True)).select("file_no", "path")


@register(
    "b2_inclusion_filter",
    f"""WITH {FILES_SQL} SELECT file_no, path FROM files
    WHERE list_has_any({_PARTS}, ['core', 'docs']) OR {NAME_SQL} LIKE '%.go' OR {NAME_SQL} LIKE '%README.md'""",
)
def inclusion_filter(spark, sf_dir):
    keep = filters.keep_path(F.col("path"), included_dirs=["core/", "./docs/"], included_files=[".go", "README.md"])
    return files(spark, sf_dir).filter(keep).select("file_no", "path")


@register(
    "b2_url_inclusion",
    "SELECT page_id FROM pages WHERE list_has_any(string_split(url, '/'), ['en', 'fr'])",
)
def url_inclusion(spark, sf_dir):
    return table(spark, sf_dir, "pages").filter(filters.in_dirs(F.col("url"), ["en", "fr"])).select("page_id")


@register(
    "b3_file_classification",
    f"WITH {FILES_SQL}, {_CLASSIFIED} SELECT file_no, path, type, is_code, is_implementation, title FROM classified",
)
def file_classification(spark, sf_dir):
    return filters.classify(files(spark, sf_dir)).select(
        "file_no", "path", "type", "is_code", "is_implementation", "title"
    )


@register(
    "b4_size_gate",
    f"""WITH {FILES_SQL}, {_CLASSIFIED} SELECT file_no, (length(text) // 4)::BIGINT AS token_count FROM classified
    WHERE length(text) // 4 <= CASE WHEN is_code THEN 400 ELSE 100 END""",
)
def size_gate(spark, sf_dir):
    gated = filters.size_gate(filters.classify(files(spark, sf_dir)), tx.token_estimate(F.col("text")), 400, 100)
    return gated.select("file_no", "token_count")


@register(
    "b6_project_search",
    """SELECT s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
    WHERE contains(lower(s_name), '00001') OR contains(lower('NAT/' || n_name), '00001') OR contains(lower(n_name), '00001')
    OR contains(lower('github'), '00001')""",
)
def project_search(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    projects = table(spark, sf_dir, "supplier").join(n, "s_nationkey").select(
        "s_suppkey", "s_name", F.col("s_name").alias("name"), F.concat(F.lit("NAT/"), "n_name").alias("owner"),
        F.col("n_name").alias("repo"), F.lit("github").alias("repo_type"),
    )
    return filters.search_projects(projects, "00001").select("s_suppkey", "s_name")


@register(
    "b10_language_fallback",
    """SELECT doc_id, CASE WHEN lang IN ('en','ja','zh','zh-tw','es','kr','vi','pt-br','fr','ru') THEN lang ELSE 'en' END AS code,
    CASE lang WHEN 'es' THEN 'Spanish (Español)' WHEN 'fr' THEN 'Français (French)' ELSE 'English' END AS name FROM documents""",
)
def language_fallback(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", tx.known_language(F.col("lang")).alias("code"), tx.language_name(F.col("lang")).alias("name")
    )


@register(
    "b14_size_route",
    """SELECT doc_id, CASE WHEN n_chars > 2000 THEN 'similarity_search' ELSE 'whole' END AS route,
    part_no, CASE WHEN strlen(text) > 1000 THEN substr(text, part_no * 250 + 1, 250) ELSE text END AS record,
    CASE WHEN strlen(text) > 1000 THEN 'in parts' END AS reason
    FROM (SELECT *, unnest(range(CASE WHEN strlen(text) > 1000 THEN (length(text) + 249) // 250 ELSE 1 END)) AS part_no FROM documents)""",
)
def size_route(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("project", F.col("doc_id"))
    read = store.analysis_record(docs.select("project"), docs.select("project", F.col("text").alias("record")), 1000)
    routes = docs.select("project", filters.size_route(F.col("n_chars"), 2000).alias("route"))
    return routes.join(read, "project").withColumnRenamed("project", "doc_id")


_LANG_CASE = " ".join(f"WHEN '{e}' THEN '{v}'" for e, v in fixed.LANGUAGE_BY_EXTENSION.items())


@register(
    "c10_extension_language",
    f"WITH {FILES_SQL} SELECT file_no, CASE lower({EXT_SQL}) {_LANG_CASE} ELSE 'unknown' END AS language FROM files",
)
def extension_language(spark, sf_dir):
    return files(spark, sf_dir).select("file_no", paths.language_of(F.col("path")).alias("language"))


@register(
    "d11_f2_sorted_tree",
    f"WITH {FILES_SQL} SELECT repo, 0::BIGINT AS part_no, string_agg(path, chr(10) ORDER BY path) AS file_tree FROM files GROUP BY 1",
)
def sorted_tree(spark, sf_dir):
    return rollups.tree_parts(files(spark, sf_dir))


@register(
    "d3_type_rollup",
    f"""WITH {FILES_SQL}, named AS (SELECT repo, {EXT_SQL} AS file_type, path, length(text) AS chars FROM files),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY repo, file_type ORDER BY path) - 1 AS n,
      count(*) OVER (PARTITION BY repo, file_type) AS file_count FROM named)
    SELECT repo, file_type, (n // 3)::BIGINT AS part_no, file_count, string_agg(path || ':' || chars, '|' ORDER BY path) AS files
    FROM numbered GROUP BY 1, 2, 3, 4""",
)
def type_rollup(spark, sf_dir):
    rows = files(spark, sf_dir).select(
        "repo", paths.extension(F.col("path")).alias("file_type"), "path", F.length("text").alias("chars")
    )
    item = F.concat(F.col("path"), F.lit(":"), F.col("chars").cast("string"))
    return rollups.type_rollup(rows, ["repo", "file_type"], "path", item, part_rows=3)


@register(
    "d5_project_totals",
    """SELECT source AS repo, count(*) AS total_files, count(*) FILTER (doc_id % 9 <> 0) AS processed_files
    FROM documents GROUP BY 1""",
)
def totals(spark, sf_dir):
    rows = files(spark, sf_dir).select(
        "repo", F.when(F.col("file_no") % 9 == 0, "invalid utf-8").alias("error")
    )
    return project_totals(rows)


_CHUNK_SQL = """words AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents),
steps AS (SELECT doc_id, w, unnest(range(0, greatest(ceil((len(w) - {size}) / {step}::DOUBLE), 0)::BIGINT + 1)) AS chunk_no FROM words)
SELECT doc_id, chunk_no, array_to_string(w[chunk_no * {step} + 1 : chunk_no * {step} + {size}], ' ') AS text FROM steps"""


@register("e6_word_chunks", "WITH " + _CHUNK_SQL.format(size=1000, step=700))
def word_chunks(spark, sf_dir):
    return chunking.word_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("e6_short_word_chunks", "WITH " + _CHUNK_SQL.format(size=50, step=35))
def short_word_chunks(spark, sf_dir):
    return chunking.word_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), size=50, overlap=15)


@register("u3_character_chunks")
def character_chunks(spark, sf_dir):
    return chunking.character_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))


# All white space, so that words are parted by single spaces; in the notation of both engines.
_ANY_SPACE = r"[\s\x0b\x1c-\x1f\x85\xa0{}]+"
_WIDE_SPACES = "\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@register(
    "u3_word_pieces",
    rf"""WITH RECURSIVE t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '{_ANY_SPACE.format(_WIDE_SPACES)}', ' ', 'g'), '[^ ]{{400,}}', '~', 'g')) AS text FROM documents),
    p AS (SELECT doc_id, i, length(x) + CASE WHEN i = 1 THEN 0 ELSE 1 END AS n FROM (
      SELECT doc_id, unnest(string_split(text, ' ')) AS x, generate_subscripts(string_split(text, ' '), 1) AS i FROM t WHERE text <> '')),
    e AS (SELECT doc_id, list(stop ORDER BY i) AS ends FROM (SELECT doc_id, i, sum(n) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS stop FROM p) GROUP BY 1),
    walk AS (
      SELECT doc_id, 0::BIGINT AS chunk_no, 0::BIGINT AS lo, len(list_filter(ends, lambda x: x <= {fixed.SPLIT_CHARS})) AS last FROM e
      UNION ALL
      SELECT doc_id, chunk_no, lo, len(list_filter(ends, lambda x: x <= lo + {fixed.SPLIT_CHARS})) FROM (
        SELECT doc_id, chunk_no, ends, CASE WHEN first = 0 THEN 0 ELSE ends[first] END AS lo FROM (
          SELECT w.doc_id, w.chunk_no + 1 AS chunk_no, e.ends,
            len(list_filter(e.ends[1:w.last], lambda x: x < greatest(e.ends[w.last] - {fixed.SPLIT_OVERLAP}, e.ends[w.last + 1] - {fixed.SPLIT_CHARS}))) + 1 AS first
          FROM walk w JOIN e USING (doc_id) WHERE w.last < len(e.ends))))
    SELECT doc_id, chunk_no, trim(substr(text, lo + 1, ends[last] - lo)) AS text FROM walk JOIN e USING (doc_id) JOIN t USING (doc_id)""",
)
def word_pieces(spark, sf_dir):
    """The splitter over texts whose words are parted by single spaces."""
    plain = F.regexp_replace(F.regexp_replace("text", _ANY_SPACE.format(_WIDE_SPACES), " "), "[^ ]{400,}", "~")
    return chunking.character_chunks(table(spark, sf_dir, "documents").select("doc_id", F.trim(plain).alias("text")))


@register(
    "u4_token_counter",
    "SELECT doc_id, len(string_split(text, ' ')) AS tokens FROM documents",
)
def token_counter(spark, sf_dir):
    """The pluggable counter, here with a plain word encoder."""
    count = chunking.token_counter(lambda t: t.split(" "))
    return table(spark, sf_dir, "documents").select("doc_id", count(F.col("text")).alias("tokens"))


@register(
    "h21_token_estimates",
    r"""SELECT doc_id, (length(text) // 4)::BIGINT AS tokens,
    CASE WHEN trim(text, ' ' || chr(10) || chr(9)) = '' THEN 0
      ELSE len(regexp_split_to_array(trim(text, ' ' || chr(10) || chr(9)), '\s+')) END::BIGINT AS words FROM documents""",
)
def token_estimates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", tx.token_estimate(F.col("text")).alias("tokens"), tx.word_count(F.col("text")).alias("words")
    )


@register(
    "h10_path_parts",
    f"""WITH {FILES_SQL} SELECT file_no, {NAME_SQL} AS name, {EXT_SQL} AS ext, path AS relative FROM files""",
)
def path_parts(spark, sf_dir):
    p = F.col("path")
    whole = F.concat(F.lit("/data/"), F.col("repo"), F.lit("/"), p)
    root = F.concat(F.lit("/data/"), F.col("repo"), F.lit("/"))
    return files(spark, sf_dir).select(
        "file_no", paths.file_name(p).alias("name"), paths.extension(p).alias("ext"),
        paths.relative_path(whole, root).alias("relative"),
    )


@register(
    "g1_code_then_docs",
    f"""WITH {FILES_SQL} SELECT file_no, path, true AS is_code FROM files WHERE {EXT_SQL} IN {_CODE}
    UNION ALL SELECT file_no, path, false FROM files WHERE {EXT_SQL} IN {_DOC}""",
)
def code_then_docs(spark, sf_dir):
    return filters.classify(files(spark, sf_dir)).select("file_no", "path", "is_code")


@register(
    "g2_exclusion_union",
    f"""WITH {FILES_SQL} SELECT file_no FROM files WHERE NOT ({_dirs_sql(fixed.EXCLUDED_DIRS + ['./core/', './app/'])}
    OR {_glob_sql(fixed.EXCLUDED_FILES + ['*.go'])})""",
)
def exclusion_union(spark, sf_dir):
    keep = filters.keep_path(F.col("path"), excluded_dirs=["./core/", "./app/", "./docs/"], excluded_files=["*.go"])
    return files(spark, sf_dir).filter(keep).select("file_no")


_STORE = """named AS (
  SELECT doc_id, ['github','gitlab','x'][doc_id % 3 + 1] AS kind, source AS owner, lang,
    CASE WHEN doc_id % 4 = 0 THEN 'my_repo' ELSE 'repo' || doc_id END AS repo, doc_id * 1000 AS ms FROM documents),
stored AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 'wiki_cache_x_' || lang || '.json' WHEN doc_id % 13 = 0 THEN 'other.json'
  ELSE 'wiki_cache_' || kind || '_' || owner || '_' || repo || '_' || lang || '.json' END AS file_name FROM named)"""


def _stored_names(spark, sf_dir):
    d = F.col("doc_id")
    repo = F.when(d % 4 == 0, "my_repo").otherwise(F.concat(F.lit("repo"), d.cast("string")))
    full = paths.store_name(pick(["github", "gitlab", "x"], d), F.col("source"), repo, F.col("lang"))
    return table(spark, sf_dir, "documents").select(
        F.when(d % 11 == 0, F.concat(F.lit("wiki_cache_x_"), "lang", F.lit(".json")))
        .when(d % 13 == 0, "other.json").otherwise(full).alias("file_name"),
        F.timestamp_millis(d * 1000).alias("modificationTime"),
    )


@register(
    "a7_f1_project_catalogue",
    f"""WITH {_STORE} SELECT file_name AS id, owner, repo, owner || '/' || repo AS name, kind AS repo_type,
    ms AS submitted_at, lang AS language FROM stored WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0 ORDER BY ms DESC""",
)
def project_catalogue(spark, sf_dir):
    return store.newest_first(store.project_catalogue(_stored_names(spark, sf_dir)))


@register(
    "f4_newest_projects",
    f"""WITH {_STORE} SELECT file_name AS id, ms AS submitted_at FROM stored
    WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0 ORDER BY ms DESC, id LIMIT 10""",
)
def newest_projects(spark, sf_dir):
    rows = store.newest_first(store.project_catalogue(_stored_names(spark, sf_dir)))
    return rows.limit(10).select("id", "submitted_at")


_WIKI_ROWS = """SELECT ['github','gitlab'][doc_id % 2 + 1] AS repo_type, source AS owner, '00' || (doc_id % 5) AS repo,
  lang AS language, doc_id AS page_id"""


def _wiki_rows(spark, sf_dir):
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        pick(["github", "gitlab"], d).alias("repo_type"), F.col("source").alias("owner"),
        F.concat(F.lit("00"), (d % 5).cast("string")).alias("repo"), F.col("lang").alias("language"),
        d.alias("page_id"), F.length("text").cast("long").alias("size"),
    )


@register(
    "a6_wiki_store_upsert",
    f"""WITH old AS ({_WIKI_ROWS}, length(text) AS size FROM documents),
    new AS ({_WIKI_ROWS}, -1::BIGINT AS size FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
    SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.repo_type = o.repo_type AND n.owner = o.owner
      AND n.repo = o.repo AND n.language = o.language) UNION ALL SELECT * FROM new""",
)
def wiki_store_upsert(spark, sf_dir):
    old = _wiki_rows(spark, sf_dir)
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("page_id"))
    new = old.join(toxic, "page_id", "left_semi").withColumn("size", F.lit(-1).cast("long"))
    return store.upserted(old, new)


@register(
    "a6_wiki_store_delete",
    f"""WITH old AS ({_WIKI_ROWS}, length(text) AS size FROM documents),
    gone AS ({_WIKI_ROWS} FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
    SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM gone n WHERE n.repo_type = o.repo_type AND n.owner = o.owner
      AND n.repo = o.repo AND n.language = o.language)""",
)
def wiki_store_delete(spark, sf_dir):
    old = _wiki_rows(spark, sf_dir)
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("page_id"))
    return store.without_keys(old, old.join(toxic, "page_id", "left_semi"))


@register(
    "a10_json_texts",
    """SELECT event_id, 0::BIGINT AS n, event_type AS text FROM events
    UNION ALL SELECT event_id, 1, replace(props, ' ', '') FROM events WHERE event_type <> 'view'""",
)
def json_texts(spark, sf_dir):
    named = F.to_json(F.struct(F.col("event_type").alias("text")))
    payload = F.when(F.col("event_type") == "view", named).otherwise(
        F.concat(F.lit("["), named, F.lit(", "), F.col("props"), F.lit("]"))
    )
    # JSON items come back in compact form.
    return table(spark, sf_dir, "events").select("event_id", F.posexplode(pl.json_texts(payload)).alias("n", "text"))


@register(
    "a11_listed_files",
    f"""WITH {FILES_SQL} SELECT file_no, string_agg(p, '|' ORDER BY i) AS files FROM (
      SELECT file_no, 0 AS i, path AS p FROM files UNION ALL SELECT file_no, 1, 'x/' || path FROM files WHERE file_no % 2 = 0) GROUP BY 1""",
)
def listed_files(spark, sf_dir):
    def entry(kind: str, path):
        return F.struct(F.lit(kind).alias("type"), path.alias("path"))

    p, no = F.col("path"), F.col("file_no")
    tree = F.to_json(F.struct(F.array(entry("blob", p), entry("tree", F.lit("d")), entry("blob", F.concat(F.lit("x/"), p))).alias("tree")))
    values = F.to_json(F.struct(F.array(entry("commit_directory", F.lit("d")), entry("commit_file", p)).alias("values")))
    listing = F.when(no % 2 == 0, tree).when(no % 3 == 0, values).otherwise(F.to_json(F.array(entry("blob", p))))
    return files(spark, sf_dir).select("file_no", pl.listed_files(listing).alias("files"))


@register(
    "a12_file_payloads",
    """SELECT doc_id, CASE WHEN doc_id % 5 > 1 THEN text END AS text,
    CASE doc_id % 5 WHEN 0 THEN 'host error: Not Found' WHEN 1 THEN 'unexpected encoding: none' END AS error FROM documents""",
)
def file_payloads(spark, sf_dir):
    d = F.col("doc_id")
    coded = F.regexp_replace(F.base64(F.encode("text", "utf-8")), r"\r\n", "\n")
    payload = (
        F.when(d % 5 == 0, '{"message":"Not Found","documentation_url":"u"}')
        .when(d % 5 == 1, '{"encoding":"none","content":"x"}')
        .otherwise(F.to_json(F.struct(F.lit("base64").alias("encoding"), coded.alias("content"))))
    )
    read = pl.file_payload(payload)
    return table(spark, sf_dir, "documents").select("doc_id", read["text"].alias("text"), read["error"].alias("error"))


@register(
    "d9_token_usage",
    """SELECT event_type AS provider, count(*) AS responses,
    sum(CASE WHEN event_id % 4 <> 0 THEN user_id END)::BIGINT AS prompt_tokens,
    sum(CASE WHEN event_id % 4 <> 0 THEN event_id END)::BIGINT AS completion_tokens,
    sum(CASE WHEN event_id % 4 <> 0 THEN user_id + event_id END)::BIGINT AS total_tokens FROM events GROUP BY 1""",
)
def token_usage(spark, sf_dir):
    return rollups.usage_by(_responses(spark, sf_dir), ["provider"])


def _responses(spark, sf_dir):
    """Responses of providers; every fourth is an error."""
    e, u = F.col("event_id"), F.col("user_id")
    usage = F.struct(
        F.struct(u.alias("prompt_tokens"), e.alias("completion_tokens"), (u + e).alias("total_tokens")).alias("usage")
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("provider"),
        F.when(e % 4 == 0, '{"error":"timeout"}').otherwise(F.to_json(usage)).alias("response"),
    )


@register(
    "k1_incremental_refresh",
    """SELECT event_id % 500 AS file_no, arg_max(event_type, event_id) AS text, max(event_id) AS version FROM events GROUP BY 1""",
)
def incremental_refresh(spark, sf_dir):
    """A second listing over a first store: the result equals one full build of the newest versions."""
    from repoloom.streaming import refresh

    rows = table(spark, sf_dir, "events").select(
        (F.col("event_id") % 500).cast("string").alias("path"), F.col("event_id").alias("version"),
        F.col("event_type").alias("text"),
    )
    early = refresh.latest_versions(rows.filter("text <> 'purchase'"))
    final = refresh.latest_versions(rows)
    hashed = F.sha2(F.concat("text", F.col("version").cast("string")), 256)

    def build(df):
        return df.select("path", "hash", "version", "text")

    stored = build(early.withColumn("hash", hashed))
    return refresh.refreshed(final.withColumn("hash", hashed), stored, build).select(
        F.col("path").cast("long").alias("file_no"), "text", "version"
    )


@register(
    "k2_piece_assembly",
    """SELECT user_id AS session, event_id // 100000 AS part_no, string_agg(replace(replace(piece, '<think>', ''), '</think>', ''), '' ORDER BY event_id) AS answer
    FROM (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'model=' || event_id WHEN event_type = 'view' THEN '<think>' || event_id || '</think>'
      ELSE event_type || ' ' END AS piece FROM events) WHERE NOT starts_with(piece, 'model=') GROUP BY 1, 2""",
)
def piece_assembly(spark, sf_dir):
    from repoloom.streaming import pieces

    e = F.col("event_id").cast("string")
    piece = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("model="), e))
        .when(F.col("event_type") == "view", F.concat(F.lit("<think>"), e, F.lit("</think>")))
        .otherwise(F.concat("event_type", F.lit(" ")))
    )
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session"), F.col("event_id").alias("seq"), piece.alias("piece")
    )
    return pieces.assembled(pieces.clean_pieces(rows))


def _event_stream(spark, sf_dir, files_per_batch: int = 1):
    schema = table(spark, sf_dir, "events").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    # The source takes a pattern where it would not take a file name.
    return reader.parquet(f"{sf_dir}/event[s].parquet")


def _fresh_store(spark, name: str) -> tuple[str, str]:
    """A new store and checkpoint folder below the session's checkpoint folder."""
    import uuid

    from repoloom.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    return f"{root}/store", f"{root}/checkpoint"


@register(
    "k1_stream_refresh",
    """SELECT event_id % 500 AS file_no, arg_max(event_type, event_id) AS text, max(event_id) AS version FROM events GROUP BY 1""",
)
def stream_refresh(spark, sf_dir):
    from repoloom.streaming import refresh

    store_path, checkpoint = _fresh_store(spark, "refresh")
    rows = _event_stream(spark, sf_dir).select(
        (F.col("event_id") % 500).cast("string").alias("path"), F.col("event_id").alias("version"),
        F.col("event_type").alias("text"),
    )
    refresh.refresh_stream(spark, rows, store_path, checkpoint, lambda df: df.select("path", "hash", "version", "text"))
    return refresh.stored_rows(spark, store_path).select(
        F.col("path").cast("long").alias("file_no"), "text", "version"
    )


@register(
    "k2_stream_assembly",
    """SELECT user_id AS session, event_id // 100000 AS part_no, string_agg(event_type || event_id, '' ORDER BY event_id) AS answer
    FROM events WHERE event_type <> 'error' GROUP BY 1, 2""",
)
def stream_assembly(spark, sf_dir):
    from repoloom.streaming import pieces

    store_path, checkpoint = _fresh_store(spark, "assembly")
    piece = F.when(F.col("event_type") == "error", "model=x").otherwise(
        F.concat(F.lit("<think>"), "event_type", F.lit("</think>"), F.col("event_id").cast("string"))
    )
    rows = _event_stream(spark, sf_dir).select(
        F.col("user_id").alias("session"), F.col("event_id").alias("seq"), piece.alias("piece")
    )
    pieces.assembly_stream(spark, rows, store_path, checkpoint)
    return pieces.stored_answers(spark, store_path)


@register("a5_chunk_store", "WITH " + _CHUNK_SQL.format(size=1000, step=700).replace("doc_id, chunk_no,", "doc_id, chunk_no::BIGINT AS chunk_no,"))
def chunk_store(spark, sf_dir):
    """Built on the first call, read on the second."""
    path, _ = _fresh_store(spark, "chunks")

    def build():
        docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
        return chunking.word_chunks(docs)

    for _ in range(2):
        stored = store.load_or_build(spark, path, build, ["source"])
    return stored.select("doc_id", "chunk_no", "text")


@register(
    "a8_analysis_sink",
    f"""WITH {FILES_SQL} SELECT repo AS project, path, CASE lower({EXT_SQL}) {_LANG_CASE} ELSE 'unknown' END AS language, length(text) AS chars FROM files""",
)
def analysis_sink(spark, sf_dir):
    path, _ = _fresh_store(spark, "analysis")
    rows = files(spark, sf_dir).select(
        F.col("repo").alias("project"), "path", paths.language_of(F.col("path")).alias("language"),
        F.length("text").cast("long").alias("chars"),
    )
    store.write_analysis(rows, path)
    return spark.read.schema(rows.schema).json(path)


@register(
    "a9_vector_store",
    """SELECT vec_id, 'label ' || label AS text, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS value, label::VARCHAR AS label FROM embeddings""",
)
def vector_store(spark, sf_dir):
    path, _ = _fresh_store(spark, "vectors")
    label = F.col("label").cast("string")
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.concat(F.lit("label "), label).alias("text"), F.col("embedding").alias("vector"),
        F.create_map(F.lit("label"), label).alias("meta"),
    )
    store.save_vectors(rows, path)
    return spark.read.parquet(path).select(
        "vec_id", "text", F.posexplode("vector").alias("i", "value"), F.col("meta")["label"].alias("label")
    )


@register(
    "a6_wiki_files",
    f"""WITH old AS ({_WIKI_ROWS}, length(text) AS size FROM documents), new AS ({_WIKI_ROWS}, -1::BIGINT AS size FROM documents WHERE lang = 'en')
    SELECT * FROM old WHERE language <> 'en' UNION ALL SELECT * FROM new""",
)
def wiki_files(spark, sf_dir):
    """Stored by key; writing the English wikis again replaces them and leaves the others."""
    path, _ = _fresh_store(spark, "wikis")
    old = _wiki_rows(spark, sf_dir)
    store.save_wikis(old, path)
    store.save_wikis(old.filter("language = 'en'").withColumn("size", F.lit(-1).cast("long")), path)
    return store.read_wikis(spark, path)


@register("d5_observed_totals", "SELECT count(*) AS total_files, count(*) FILTER (doc_id % 9 <> 0) AS processed_files FROM documents")
def observed_files(spark, sf_dir):
    """Totals of a scan, observed while its files are stored."""
    path, _ = _fresh_store(spark, "observed")
    rows = files(spark, sf_dir).withColumn("error", F.when(F.col("file_no") % 9 == 0, "invalid utf-8"))
    return spark.createDataFrame([run_totals.write_observed(rows, path, run_totals.file_totals())], "total_files long, processed_files long")


@register(
    "d9_observed_usage",
    """SELECT count(*) AS responses, sum(CASE WHEN event_id % 4 <> 0 THEN user_id END)::BIGINT AS prompt_tokens,
    sum(CASE WHEN event_id % 4 <> 0 THEN event_id END)::BIGINT AS completion_tokens, sum(CASE WHEN event_id % 4 <> 0 THEN user_id + event_id END)::BIGINT AS total_tokens FROM events""",
)
def observed_usage(spark, sf_dir):
    """Token usage of responses, observed while they are stored."""
    path, _ = _fresh_store(spark, "observed")
    totals = run_totals.write_observed(_responses(spark, sf_dir), path, run_totals.usage_totals())
    return spark.createDataFrame([totals], "responses long, prompt_tokens long, completion_tokens long, total_tokens long")
