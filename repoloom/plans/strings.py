"""URL, text, Markdown, JSON and response-text queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repoloom.functions import fixed, paths, payloads as pl, text as tx
from repoloom.plans.catalog import register
from repoloom.plans.views import pick, sql_pick, sql_text, table

NL = "chr(10)"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _s(c: str = "doc_id") -> Column:
    return F.col(c).cast("string")


# ---------------------------------------------------------------- repository addresses

_URL_FORMS = ["https://github.com/", "https://gitlab.com/group/", "https://bitbucket.org/", "/home/user/", ""]
_KINDS = ["github", "gitlab", "bitbucket", "local", "github"]
_TAILS = ["", ".git", "/"]
_ADDRESS_SQL = f"""addresses AS (
  SELECT doc_id, {sql_pick(_KINDS, 'doc_id')} AS kind, source AS owner, 'r' || doc_id AS repo,
    {sql_pick(_URL_FORMS, 'doc_id')} || source || '/r' || doc_id || {sql_pick(_TAILS, 'doc_id // 5')} AS url FROM documents)"""


def _addresses(spark, sf_dir):
    d = F.col("doc_id")
    return _docs(spark, sf_dir).select(
        "doc_id", pick(_KINDS, d).alias("kind"), F.col("source").alias("owner"), F.concat(F.lit("r"), _s()).alias("repo"),
        F.concat(
            pick(_URL_FORMS, d), "source", F.lit("/r"), _s(), pick(_TAILS, F.floor(d / 5))
        ).alias("url"),
        "text", "lang",
    )


@register(
    "h1_repo_name",
    f"""WITH {_ADDRESS_SQL} SELECT doc_id, url, kind, CASE WHEN doc_id % 5 < 3 THEN owner || '_' || repo ELSE repo END AS name FROM addresses""",
)
def repo_name(spark, sf_dir):
    return _addresses(spark, sf_dir).select(
        "doc_id", "url", "kind", paths.repo_name(F.col("url"), F.col("kind")).alias("name")
    )


@register(
    "h1_page_repo_name",
    """SELECT page_id, CASE WHEN len(p) >= 5 THEN replace(concat_ws('_', p[-2], replace(p[-1], '.git', '')), chr(0), '') ELSE replace(p[-1], '.git', '') END AS name
    FROM (SELECT page_id, string_split(rtrim(url, '/'), '/') AS p FROM pages)""",
)
def page_repo_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", paths.repo_name(F.col("url"), F.lit("github")).alias("name")
    )


_OWNER_FORMS = [
    "git@github.com:{o}/{r}.git", "https://github.com/{o}/{r}", "https://gitlab.com/{o}/{r}.git/", "{o}/{r}.git",
    "https://example.com/{o}/{r}", "plain{r}", "git@host.org:{o}/{r}", "git@gitlab.com:{r}", "  git://bitbucket.org/{o}/{r}/tree ",
    "https://github.com/{r}",
]
_OWNER_ERRORS = [
    None, None, None, None, "unsupported host", "owner/repo expected", "unsupported host", "owner/repo expected", None,
    "owner or repo not found",
]


@register(
    "h2_owner_repo",
    "SELECT doc_id, CASE WHEN doc_id % 10 IN (0, 1, 2, 3, 8) THEN source || '_digit' || doc_id END AS name, CASE doc_id % 10 "
    + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_OWNER_ERRORS) if e)
    + " END AS error FROM documents",
)
def owner_repo(spark, sf_dir):
    form = pick(_OWNER_FORMS, F.col("doc_id"))
    repo = F.concat(F.lit("digit"), _s())
    url = F.replace(F.replace(form, F.lit("{o}"), F.col("source")), F.lit("{r}"), repo)
    r = paths.owner_repo(url)
    return _docs(spark, sf_dir).select("doc_id", r["name"].alias("name"), r["error"].alias("error"))


_INPUTS = [
    "C:\\work\\{r}", "/home/x/{r}/", "https://github.com/{o}/{r}.git", "https://gitlab.my.org/a/{o}/{r}",
    "http://bitbucket.org/{o}/{r}/", "git.host.io/{o}/{r}", "justtext", "https://github.com/{o}",
]


@register(
    "h3_repository_input",
    """SELECT doc_id, CASE WHEN k < 2 THEN 'local' WHEN k < 6 THEN source END AS owner, CASE WHEN k < 6 THEN 'r' || doc_id END AS repo,
    ['local','local','github','gitlab','bitbucket','web',NULL,NULL][k + 1] AS type,
    CASE k WHEN 2 THEN source || '/r' || doc_id WHEN 3 THEN 'a/' || source || '/r' || doc_id
      WHEN 4 THEN source || '/r' || doc_id WHEN 5 THEN source || '/r' || doc_id END AS full_path,
    CASE k WHEN 0 THEN 'C:\\work\\r' || doc_id WHEN 1 THEN '/home/x/r' || doc_id || '/' END AS local_path
    FROM (SELECT *, (doc_id % 8)::INT AS k FROM documents)""",
)
def repository_input(spark, sf_dir):
    form = pick(_INPUTS, F.col("doc_id"))
    url = F.replace(F.replace(form, F.lit("{o}"), F.col("source")), F.lit("{r}"), F.concat(F.lit("r"), _s()))
    r = paths.repository_input(url)
    return _docs(spark, sf_dir).select("doc_id", *[r[c].alias(c) for c in ("owner", "repo", "type", "full_path", "local_path")])


@register(
    "h4_url_domain_path",
    r"""SELECT page_id, regexp_extract(url, '^(https?://[^/?#:]+)', 1) AS domain,
    regexp_replace(regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '^/', ''), '/$', '') AS path FROM pages""",
)
def url_domain_path(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", paths.url_domain(u).alias("domain"), paths.url_path(u).alias("path"))


@register(
    "h5_repo_type_and_display",
    f"""WITH {_ADDRESS_SQL} SELECT doc_id, CASE WHEN url LIKE '%bitbucket.org%' THEN 'bitbucket' WHEN url LIKE '%gitlab.com%' THEN 'gitlab' ELSE 'github' END AS type,
    CASE WHEN kind = 'local' THEN url WHEN doc_id % 2 = 0 THEN url ELSE 'http://example/' || owner || '/' || repo END AS display FROM addresses""",
)
def repo_type_and_display(spark, sf_dir):
    u = F.col("url")
    stored = F.when(F.col("doc_id") % 2 == 0, u)
    return _addresses(spark, sf_dir).select(
        "doc_id", paths.repo_type(u).alias("type"),
        paths.display_url(F.col("kind"), u, stored, F.col("owner"), F.col("repo")).alias("display"),
    )


@register(
    "h6_file_url",
    f"""WITH {_ADDRESS_SQL} SELECT doc_id, CASE WHEN kind = 'local' OR doc_id % 5 = 4 THEN 'a/b.py' WHEN kind = 'github' THEN url || '/blob/main/a/b.py'
    WHEN kind = 'gitlab' THEN url || '/-/blob/main/a/b.py' ELSE url || '/src/main/a/b.py' END AS file_url FROM addresses""",
)
def file_url(spark, sf_dir):
    return _addresses(spark, sf_dir).select(
        "doc_id", paths.file_url(F.col("kind"), F.col("url"), F.lit("main"), F.lit("a/b.py")).alias("file_url")
    )


@register(
    "h7_content_api_url",
    f"""WITH {_ADDRESS_SQL} SELECT doc_id, CASE
    WHEN kind = 'github' AND doc_id % 5 = 0 THEN 'https://api.github.com/repos/' || owner || '/' || repo || '/contents/a b/c*.py'
    WHEN kind = 'gitlab' THEN 'https://gitlab.com/api/v4/projects/group%2F' || owner || '%2F' || repo || '/repository/files/a%20b%2Fc%2A.py/raw?ref=main'
    WHEN kind = 'bitbucket' THEN 'https://api.bitbucket.org/2.0/repositories/' || owner || '/' || repo || '/src/main/a b/c*.py' END AS api_url FROM addresses""",
)
def content_api_url(spark, sf_dir):
    return _addresses(spark, sf_dir).select(
        "doc_id", paths.content_api_url(F.col("kind"), F.col("url"), F.lit("a b/c*.py"), F.lit("main")).alias("api_url")
    )


@register("h8_filter_list", "SELECT doc_id, source || '/x y|a+b|' || lang || '%zz' AS items FROM documents")
def filter_list(spark, sf_dir):
    raw = F.concat("source", F.lit("%2Fx%20y\n  \na+b\n\n"), "lang", F.lit("%zz"))
    return _docs(spark, sf_dir).select("doc_id", paths.filter_list(raw).alias("items"))


@register(
    "h9_store_name",
    """SELECT doc_id, 'wiki_cache_github_' || source || '_my_repo' || doc_id || '_' || lang || '.json' AS file_name,
    'github' AS repo_type, source AS owner, 'my_repo' || doc_id AS repo, lang AS language FROM documents""",
)
def store_name(spark, sf_dir):
    name = paths.store_name(F.lit("github"), F.col("source"), F.concat(F.lit("my_repo"), _s()), F.col("lang"))
    k = paths.parse_store_name(F.col("file_name"))
    return _docs(spark, sf_dir).select("doc_id", name.alias("file_name")).select("doc_id", "file_name", k.alias("k")).select(
        "doc_id", "file_name", "k.*"
    )


@register(
    "g3_branch_candidates",
    "SELECT doc_id, CASE lang WHEN 'en' THEN 'main|master' WHEN 'fr' THEN 'master|main' ELSE lang || '|main|master' END AS branches FROM documents",
)
def branch_candidates(spark, sf_dir):
    named = F.when(F.col("lang") == "en", "main").when(F.col("lang") == "fr", "master").otherwise(F.col("lang"))
    return _docs(spark, sf_dir).select("doc_id", paths.branch_candidates(named).alias("branches"))


# ---------------------------------------------------------------- Markdown and stream text


@register(
    "h11_fences",
    f"SELECT doc_id, regexp_replace(text, '^\\s+', '') || {NL} AS markdown, regexp_replace(text, '^\\s+', '') AS xml FROM documents",
)
def fences(spark, sf_dir):
    body = F.col("text")
    md = F.concat(F.lit("```markdown\n"), body, F.lit("\n```\n"))
    xml = F.concat(F.lit("```XML "), body, F.lit("```"))
    return _docs(spark, sf_dir).select(
        "doc_id", tx.drop_fences_exact(md, "markdown").alias("markdown"), tx.drop_fences(xml, "xml").alias("xml")
    )


@register("h12_control_characters", f"SELECT doc_id, 'a' || chr(9) || text || chr(10) || 'b' AS text FROM documents")
def control_characters(spark, sf_dir):
    noisy = F.concat(F.lit("a\t\x00\x08"), "text", F.lit("\x0b\x1f\n\x7fb"))
    return _docs(spark, sf_dir).select("doc_id", tx.drop_control(noisy).alias("text"))


@register(
    "h13_stream_pieces",
    "SELECT doc_id, text || 'end' AS piece FROM documents WHERE lang <> 'en'",
)
def stream_pieces(spark, sf_dir):
    from repoloom.streaming.pieces import clean_pieces

    piece = F.when(F.col("lang") == "en", F.concat(F.lit("created_at="), "text")).otherwise(
        F.concat(F.lit("<think>"), "text", F.lit("</think>end"))
    )
    return clean_pieces(_docs(spark, sf_dir).select("doc_id", piece.alias("piece")))


# A workshop text: title, introduction, then every line of the document as a heading, an exercise or prose.
_WORKSHOP_SQL = f"""w AS (
  SELECT doc_id, '# Title ' || doc_id || {NL} || {NL} || 'Intro.' || {NL} || {NL} || string_agg(
      CASE i % 4 WHEN 1 THEN '## Part ' || i || ': ' || l || '!'
        WHEN 2 THEN '## Exercise ' || i || ': do' || {NL} || l ELSE l END, {NL} ORDER BY i)
      || {NL} || '## Final Project' || {NL} || 'end' AS c
  FROM (SELECT doc_id, unnest(string_split(text, {NL})) AS l, generate_subscripts(string_split(text, {NL}), 1) AS i FROM documents) GROUP BY 1)"""


def _workshops(spark, sf_dir):
    def line(l, i):
        n = (i + 1).cast("string")
        return (
            F.when((i + 1) % 4 == 1, F.concat(F.lit("## Part "), n, F.lit(": "), l, F.lit("!")))
            .when((i + 1) % 4 == 2, F.concat(F.lit("## Exercise "), n, F.lit(": do\n"), l))
            .otherwise(l)
        )

    body = F.array_join(F.transform(F.split("text", "\n"), line), "\n")
    return _docs(spark, sf_dir).select(
        "doc_id", F.concat(F.lit("# Title "), _s(), F.lit("\n\nIntro.\n\n"), body, F.lit("\n## Final Project\nend")).alias("c")
    )


@register(
    "h14_contents_list",
    rf"""WITH {_WORKSHOP_SQL}, heads AS (SELECT doc_id, c, regexp_extract_all(c, '(?m)^## (.*)$', 1) AS h FROM w)
    SELECT doc_id, string_split(c, '## ')[1] || '## Table of Contents' || {NL} || {NL} ||
      array_to_string(list_transform(h, lambda x: '- [' || x || '](#' || regexp_replace(regexp_replace(lower(x), '[^\w\s-]', '', 'g'), '\s+', '-', 'g') || ')' || {NL}), '')
      || {NL} || substr(c, length(string_split(c, '## ')[1]) + 1) AS content FROM heads""",
)
def contents_list(spark, sf_dir):
    return _workshops(spark, sf_dir).select("doc_id", tx.insert_contents(F.col("c")).alias("content"))


@register(
    "h15_project_note",
    f"""WITH {_WORKSHOP_SQL} SELECT doc_id, replace(c, '## Final Project' || {NL}, '## Final Project' || {NL} ||
    {sql_text(fixed.NOTE_OPEN + fixed.PROJECT_NOTE)} || {NL} || '</div>' || {NL} || {NL}) AS content FROM w""",
)
def project_note(spark, sf_dir):
    return _workshops(spark, sf_dir).select("doc_id", tx.insert_project_note(F.col("c")).alias("content"))


_EXERCISES_SQL = f"""{_WORKSHOP_SQL}, ex AS (
  SELECT doc_id, unnest(e) AS heading, generate_subscripts(e, 1) AS i, len(e) AS total FROM (
    SELECT doc_id, regexp_extract_all(c, '(?m)^## Exercise \\d+:') AS e FROM w)),
timed AS (SELECT *, CASE WHEN i = 1 THEN 5 WHEN i = total THEN 15 WHEN i - 1 > total // 2 THEN 12 ELSE 10 END AS minutes FROM ex)"""


@register(
    "e8_exercises",
    f"WITH {_EXERCISES_SQL} SELECT doc_id, heading, i AS number, total::BIGINT AS total, minutes::BIGINT AS minutes FROM timed",
)
def exercises(spark, sf_dir):
    found = tx.exercise_headings(F.col("c"))
    rows = _workshops(spark, sf_dir).select("doc_id", F.size(found).alias("total"), F.posexplode(found).alias("i", "heading"))
    return rows.select(
        "doc_id", "heading", (F.col("i") + 1).cast("long").alias("number"), "total",
        tx.exercise_minutes(F.col("i"), F.col("total")).alias("minutes"),
    )


@register(
    "e8_annotated_workshops",
    f"""WITH {_EXERCISES_SQL} SELECT w.doc_id, coalesce(string_split(c, '## Exercise ')[1] || x, c) AS content FROM w LEFT JOIN (
      SELECT t.doc_id, string_agg('## Exercise ' || string_split(part, {NL})[1] || {NL} || {sql_text(fixed.NOTE_OPEN)} || 'Exercise ' || i || '/' || total
        || ' | about ' || minutes || ' min' || {NL} || '</div>' || {NL} || {NL} || substr(part, length(string_split(part, {NL})[1]) + 2), '' ORDER BY i) AS x
      FROM timed t JOIN (SELECT doc_id, unnest(string_split(c, '## Exercise ')[2:]) AS part,
        generate_subscripts(string_split(c, '## Exercise ')[2:], 1) AS i FROM w) p USING (doc_id, i) GROUP BY 1) y ON w.doc_id = y.doc_id""",
)
def annotated_workshops(spark, sf_dir):
    return _workshops(spark, sf_dir).select("doc_id", tx.annotate_exercises(F.col("c")).alias("content"))


_PARAGRAPH = r"'# .*?\n\n(.*?)(?:\n\n|\z)'"


@register(
    "h16_first_paragraph",
    f"""WITH bodies AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN text || {NL} || '## Head' || {NL} || {NL} || replace(text, {NL}, ' ') || {NL} || {NL} || text
      ELSE '## Head' || {NL} || {NL} || text || {NL} || {NL} || 'more' END AS body FROM documents),
    found AS (SELECT doc_id, regexp_matches(body, {_PARAGRAPH}) AS any_, regexp_extract(body, {_PARAGRAPH}, 1) AS p FROM bodies)
    SELECT doc_id, CASE WHEN any_ THEN trim(p, ' ' || chr(9) || chr(11) || chr(12) || chr(13) || {NL}) ELSE 'No summary available' END AS summary FROM found""",
)
def first_paragraph(spark, sf_dir):
    text, head = F.col("text"), F.lit("## Head\n\n")
    body = (
        F.when(F.col("doc_id") % 3 == 0, text)
        .when(F.col("doc_id") % 3 == 1, F.concat(text, F.lit("\n"), head, F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("\n\n"), text))
        .otherwise(F.concat(head, text, F.lit("\n\nmore")))
    )
    return _docs(spark, sf_dir).select("doc_id", tx.first_paragraph(body).alias("summary"))


# Slide plans: each document line becomes one plan line, in one of five forms.
_SLIDE_SQL = f"""lines AS (
  SELECT doc_id, (doc_id % 5)::INT AS form, 'Topic ' || i || regexp_replace(split_part(l, ' ', 1), '[^A-Za-z]', '', 'g') AS t,
    'w' || regexp_replace(l, '[^A-Za-z]+', ' ', 'g') || 'w' AS d, i
  FROM (SELECT doc_id, unnest(string_split(text, {NL})) AS l, generate_subscripts(string_split(text, {NL}), 1) AS i FROM documents))"""


def _plans(spark, sf_dir):
    form = F.col("doc_id") % 5

    def line(l, i):
        n = (i + 1).cast("string")
        title = F.concat(F.lit("Topic "), n, F.regexp_replace(F.split_part(l, F.lit(" "), F.lit(1)), "[^A-Za-z]", ""))
        desc = F.concat(F.lit("w"), F.regexp_replace(l, "[^A-Za-z]+", " "), F.lit("w"))
        item = F.concat(title, F.lit(": "), desc)
        return (
            F.when(form == 0, F.concat(n, F.lit(". "), item))
            .when(form == 1, F.concat(n, F.lit(") "), item))
            .when(form == 2, F.concat(F.lit("Slide "), n, F.lit(": "), item))
            .when(form == 3, item)
            .otherwise("ab")
        )

    return _docs(spark, sf_dir).select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("plan"))


_DEFAULT_ROWS = ", ".join(
    f"({i}, {sql_text(t)}, {sql_text(d)})" for i, (t, d) in enumerate(s.replace("{repo}", "demo").split(": ") for s in fixed.DEFAULT_SLIDES)
)


@register(
    "h17_slide_items",
    f"""WITH {_SLIDE_SQL} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n, t AS title, CASE WHEN form = 3 THEN '' ELSE d END AS description
    FROM lines WHERE form < 3 OR form = 3 AND lower(t) NOT LIKE '%please%' AND lower(t) NOT LIKE '%here%'
    UNION ALL SELECT doc_id, n, title, description FROM (SELECT doc_id FROM documents WHERE doc_id % 5 = 4) CROSS JOIN (VALUES {_DEFAULT_ROWS}) v(n, title, description)""",
)
def slide_items(spark, sf_dir):
    rows = _plans(spark, sf_dir).select("doc_id", F.posexplode(tx.slide_items(F.col("plan"), F.lit("demo"))).alias("n", "item"))
    return rows.select(
        "doc_id", F.col("n").cast("long").alias("n"), tx.slide_title(F.col("item")).alias("title"),
        tx.slide_description(F.col("item")).alias("description"),
    )


_WRAP_HEAD, _WRAP_REST = tx.SLIDE_WRAPPER.split("{title}")
_WRAP_MIDDLE, _WRAP_TAIL = _WRAP_REST.split("{body}")


@register(
    "h18_slide_html",
    f"""SELECT doc_id, CASE doc_id % 4
      WHEN 0 THEN '<style></style>' || doc_id || ' ' || t || '.'
      ELSE {sql_text(_WRAP_HEAD)} || 'T' || doc_id || {sql_text(_WRAP_MIDDLE)} || CASE doc_id % 4
        WHEN 1 THEN '<div class="slide"><div>' || t || '</div></div>' WHEN 2 THEN '<p>' || t || '</p>' ELSE 'raw ' || t END
        || {sql_text(_WRAP_TAIL)} END AS html FROM (SELECT doc_id, translate(text, '<>`', '') AS t FROM documents)""",
)
def slide_html(spark, sf_dir):
    s, d, t = _s(), F.col("doc_id"), F.translate("text", "<>`", "")
    body = (
        F.when(d % 4 == 0, F.concat(F.lit("Here:\n```html\n<style></style>"), s, F.lit(" "), t, F.lit(".\n```\nbye "), t))
        .when(d % 4 == 1, F.concat(t, F.lit('ok <div class="slide"><div>'), t, F.lit("</div></div> end")))
        .when(d % 4 == 2, F.concat(t, F.lit("a <p>"), t, F.lit("</p><b>x</b>"), t))
        .otherwise(F.concat(F.lit("raw "), t))
    )
    return _docs(spark, sf_dir).select("doc_id", tx.slide_html(body, F.concat(F.lit("T"), s)).alias("html"))


@register(
    "h20_retrieval_query",
    "SELECT doc_id, CASE WHEN lang = 'en' THEN 'Contexts related to src/' || doc_id || '.py' ELSE text END AS query FROM documents",
)
def retrieval_query(spark, sf_dir):
    path = F.when(F.col("lang") == "en", F.concat(F.lit("src/"), _s(), F.lit(".py")))
    return _docs(spark, sf_dir).select("doc_id", tx.retrieval_query(F.col("text"), path).alias("query"))


_JS_NAMES = ["get", "is", "has", "create", "make", "calculate", "compute", "to", "run", "toString"]


@register(
    "h22_js_return_type",
    f"""SELECT doc_id, CASE doc_id % 10 WHEN 7 THEN '' || doc_id WHEN 9 THEN 'string' || doc_id ELSE {sql_pick(['boolean', 'boolean', 'boolean', 'object', 'object', 'number', 'number', 'x', 'any', 'x'], 'doc_id')} END AS return_type FROM documents""",
)
def js_return_type(spark, sf_dir):
    name = F.concat(pick(_JS_NAMES, F.col("doc_id")), _s())
    return _docs(spark, sf_dir).select("doc_id", tx.js_return_type(name).alias("return_type"))


@register(
    "b15_response_errors",
    "SELECT doc_id, CASE lang WHEN 'en' THEN 'missing_api_key' WHEN 'fr' THEN 'missing_model' END AS error FROM documents",
)
def response_errors(spark, sf_dir):
    key = F.lit(" Error preparing retriever: Environment variable OPENAI_API_KEY must be set")
    body = (
        F.when(F.col("lang") == "en", F.concat("text", key))
        .when(F.col("lang") == "fr", F.concat(F.lit("Ollama model "), "text", F.lit(" not found")))
        .otherwise(F.concat(F.lit("Ollama model "), "text"))
    )
    return _docs(spark, sf_dir).select("doc_id", tx.response_error(body).alias("error"))


@register(
    "h23_completion_note",
    f"SELECT doc_id, (doc_id % 7)::BIGINT AS iteration, CASE WHEN doc_id % 7 >= 5 AND lang <> 'en' THEN text || {sql_text(fixed.COMPLETION_NOTE)} WHEN lang = 'en' THEN text || 'In conclusion,' ELSE text END AS text FROM documents",
)
def completion_note(spark, sf_dir):
    it = F.col("doc_id") % 7
    body = F.when(F.col("lang") == "en", F.concat("text", F.lit("In conclusion,"))).otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", it.alias("iteration"), tx.with_completion_note(body, it).alias("text"))


_PHRASES = [
    "## Final Conclusion", "## Conclusion", "## Summary Next Steps", "This concludes our research", "the Final word, Conclusion",
    "This Dockerfile", "The Dockerfile Next Steps", "nothing", "In conclusion,", "## Conclusion I will now proceed to",
    "Key Findings and Implementation Details",
]


@register(
    "b11_research_complete",
    "SELECT doc_id, doc_id % 11 IN (0, 1, 3, 4, 5, 8, 10) AS complete FROM documents",
)
def research_complete(spark, sf_dir):
    body = F.concat("text", F.lit(" "), pick(_PHRASES, F.col("doc_id")))
    return _docs(spark, sf_dir).select("doc_id", tx.research_complete(body).alias("complete"))


_STAGE_TEXTS = ["## Research Plan", "## Research Update 1", "## Research Update 3", "## Final Conclusion", "none"]


@register(
    "h19_research_stage",
    """SELECT doc_id, title, CASE WHEN title LIKE '%Plan' THEN 'plan' WHEN title LIKE '%Update%' THEN 'update' WHEN title IS NOT NULL THEN 'conclusion' END AS type FROM (
    SELECT doc_id, CASE WHEN doc_id % 5 = 0 AND doc_id % 6 = 1 THEN 'Research Plan' WHEN doc_id % 5 = 1 AND doc_id % 6 = 1 THEN 'Research Update 1'
      WHEN doc_id % 5 = 2 AND doc_id % 6 = 3 THEN 'Research Update 3' WHEN doc_id % 5 = 3 THEN 'Final Conclusion' END AS title FROM documents)""",
)
def research_stage(spark, sf_dir):
    d = F.col("doc_id")
    s = tx.research_stage(F.concat(pick(_STAGE_TEXTS, d), F.lit("\n"), "text"), (d % 6).cast("int"))
    return _docs(spark, sf_dir).select("doc_id", s["title"].alias("title"), s["type"].alias("type"))


# ---------------------------------------------------------------- response objects


@register(
    "h24_wiki_block",
    "SELECT doc_id, CASE WHEN doc_id % 4 <> 3 THEN '<wiki_structure>' || replace(text, chr(9), '') || '</wiki_structure>' END AS xml FROM documents",
)
def wiki_block(spark, sf_dir):
    d = F.col("doc_id")
    clean = F.replace("text", F.lit("\t"), F.lit(""))
    body = F.when(d % 4 == 3, clean).otherwise(
        F.concat(F.lit("```xml\nfirst <wiki_structure>"), clean, F.lit("\x01</wiki_structure> <wiki_structure>b</wiki_structure>```"))
    )
    return _docs(spark, sf_dir).select("doc_id", pl.wiki_block(body).alias("xml"))


@register(
    "h25_repair_xml",
    """SELECT page_id, replace(replace(replace(replace(replace(replace(replace(
      trim(html, ' ' || chr(10) || chr(9) || chr(13)), '&', '&amp;'), '&amp;amp;', '&amp;'), '&amp;lt;', '&lt;'), '&amp;gt;', '&gt;'),
      '&amp;apos;', '&apos;'), '&amp;quot;', '&quot;'), '  >', '>') AS xml FROM pages""",
)
def repair_xml(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", pl.repair_xml(F.col("html")).alias("xml"))


_PROVIDERS = ["anthropic.m1", "amazon.t", "cohere.c", "ai21.j", "other.x", "plainmodel"]


@register(
    "h34_response_text",
    f"SELECT doc_id, {sql_pick(['anthropic', 'amazon', 'cohere', 'ai21', 'other', 'amazon'], 'doc_id')} AS provider, CASE WHEN doc_id % 6 = 5 THEN '' ELSE text END AS text FROM documents",
)
def response_text(spark, sf_dir):
    t, d = F.col("text"), F.col("doc_id")
    one = F.struct(t.alias("text"))
    forms = [
        F.struct(F.array(one).alias("content")),
        F.struct(F.array(F.struct(t.alias("outputText"))).alias("results")),
        F.struct(F.array(one).alias("generations")),
        F.struct(F.array(F.struct(one.alias("data"))).alias("completions")),
        F.struct(t.alias("output")),
        F.struct(F.lit("odd").alias("other")),
    ]
    body = None
    for i, f in enumerate(forms):
        body = F.when(d % 6 == i, F.to_json(f)) if body is None else body.when(d % 6 == i, F.to_json(f))
    provider = pl.model_provider(pick(_PROVIDERS, d))
    return _docs(spark, sf_dir).select("doc_id", provider.alias("provider"), pl.response_text(provider, body).alias("text"))


@register(
    "h35_token_logprobs",
    """SELECT doc_id, choice, i - 1 AS position, token, (-0.5 * i)::DOUBLE AS logprob FROM (
      SELECT doc_id, unnest(string_split(text, ' ')) AS token, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents)
      CROSS JOIN (VALUES (0::BIGINT), (1::BIGINT)) c(choice) WHERE choice = 0 OR i = 1""",
)
def token_logprobs(spark, sf_dir):
    words = F.split("text", " ")
    items = F.transform(words, lambda w, i: F.struct(w.alias("token"), ((i + 1) * F.lit(-0.5)).alias("logprob")))

    def choice(a):
        return F.struct(F.struct(a.alias("content")).alias("logprobs"))

    body = F.to_json(F.struct(F.array(choice(items), choice(F.slice(items, 1, 1))).alias("choices")))
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(pl.token_logprobs(body)).alias("choice", "l"))
    return rows.select("doc_id", "choice", F.posexplode("l").alias("position", "t")).select(
        "doc_id", "choice", "position", "t.token", "t.logprob"
    )
