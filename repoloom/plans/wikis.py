"""Wiki structure, section and export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from repoloom.functions import fixed
from repoloom.operators import wiki
from repoloom.plans import views
from repoloom.plans.catalog import register
from repoloom.plans.views import GENERATED_SQL, PAGES_SQL, SECTIONS_SQL, table
from repoloom.session import cut_lineage

NL = "chr(10)"
_AT = "2024-01-01 00:00:00"


def _url():
    return F.concat(F.lit("https://github.com/o/"), F.col("wiki_id"))


@register(
    "c2_related_titles",
    f"""WITH {PAGES_SQL}, refs AS (SELECT wiki_id, id AS page_id, unnest(related_pages) AS id, generate_subscripts(related_pages, 1) AS n FROM pages_v)
    SELECT r.wiki_id, r.page_id, string_agg('[' || p.title || '](#' || p.id || ')', ', ' ORDER BY n) AS links
    FROM refs r JOIN pages_v p ON p.wiki_id = r.wiki_id AND p.id = r.id GROUP BY 1, 2""",
)
def related_titles(spark, sf_dir):
    return wiki.related_titles(views.pages(spark, sf_dir))


@register(
    "c3_pages_with_content",
    f"""WITH {PAGES_SQL}, {GENERATED_SQL} SELECT p.wiki_id, p.id, p.title, coalesce(nullif(g.content, ''), 'Content not generated') AS content
    FROM pages_v p LEFT JOIN generated g ON g.wiki_id = p.wiki_id AND g.id = p.id""",
)
def pages_with_content(spark, sf_dir):
    return wiki.with_content(views.pages(spark, sf_dir), views.generated(spark, sf_dir)).select(
        "wiki_id", "id", "title", "content"
    )


@register(
    "c4_section_pages",
    f"""WITH {SECTIONS_SQL}, cp AS (SELECT 'w' || n_regionkey AS wiki_id, 'c' || c_custkey AS id, c_name AS title, lower(c_mktsegment) AS importance
      FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0)
    SELECT r.wiki_id, r.section_id, r.n, r.id AS page_id, title, importance FROM page_refs r JOIN cp USING (wiki_id, id)""",
)
def section_pages(spark, sf_dir):
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    pages = customer.filter("c_acctbal > 0").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("w"), F.col("n_regionkey").cast("string")).alias("wiki_id"),
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("title"),
        F.lower("c_mktsegment").alias("importance"),
    )
    return wiki.section_pages(views.page_refs(spark, sf_dir), pages)


@register(
    "c5_g5_root_sections",
    f"""WITH {SECTIONS_SQL} SELECT wiki_id, id, title, pos FROM sections s
    WHERE NOT EXISTS (SELECT 1 FROM refs r WHERE r.wiki_id = s.wiki_id AND r.id = s.id)""",
)
def root_sections(spark, sf_dir):
    return wiki.root_sections(views.sections(spark, sf_dir), views.section_refs(spark, sf_dir))


@register(
    "c6_savable_wikis",
    f"""WITH {PAGES_SQL}, {GENERATED_SQL}, w AS (SELECT p.wiki_id || ':' || importance AS wiki_id, p.id, g.content FROM pages_v p
      LEFT JOIN generated g ON g.wiki_id = p.wiki_id AND g.id = p.id WHERE g.id IS NOT NULL OR importance = 'low'),
    k AS (SELECT wiki_id || '/' || substr(id, 6, 2) AS wiki_id, id, content FROM w)
    SELECT wiki_id, count(*) AS pages, count(content) AS contents FROM k GROUP BY 1
    HAVING bool_and(coalesce(content, '') NOT IN ('', 'Loading...'))""",
)
def savable_wikis(spark, sf_dir):
    pages, made = views.pages(spark, sf_dir), views.generated(spark, sf_dir)
    joined = pages.drop("content").join(made, ["wiki_id", "id"], "left").filter("content IS NOT NULL OR importance = 'low'")
    key = F.concat("wiki_id", F.lit(":"), "importance", F.lit("/"), F.substr(F.col("id"), F.lit(6), F.lit(2)))
    small = joined.select(key.alias("wiki_id"), "id", "content")
    return wiki.savable_wikis(small.select("wiki_id", "id"), small.filter("content IS NOT NULL"))


_CATEGORY_SQL = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(title), '{w}')" for w in words) + f" THEN '{name}'"
    for name, _, words in fixed.SECTION_CATEGORIES if words
) + " ELSE 'other' END"


@register("c8_title_category", f"WITH {PAGES_SQL} SELECT id, title, {_CATEGORY_SQL} AS category FROM pages_v")
def title_category(spark, sf_dir):
    return views.pages(spark, sf_dir).select("id", "title", wiki.title_category(F.col("title")).alias("category"))


@register("c8_part_category", f"SELECT p_partkey, p_name, {_CATEGORY_SQL.replace('title', 'p_name')} AS category FROM part")
def part_category(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", wiki.title_category(F.col("p_name")).alias("category"))


def _sections_case(groups, what: str) -> str:
    return "CASE g " + " ".join(f"WHEN '{n}' THEN {what.format(i=i, t=t)}" for i, (n, t) in enumerate(groups)) + " END"


_TITLE_GROUPS = [(n, t) for n, t, _ in fixed.SECTION_CATEGORIES]


@register(
    "d12_title_sections",
    f"""WITH {PAGES_SQL}, c AS (SELECT *, {_CATEGORY_SQL} AS g FROM pages_v)
    SELECT wiki_id, ({_sections_case(_TITLE_GROUPS, '{i}')})::BIGINT AS section_no, 'section-' || g AS id, {_sections_case(_TITLE_GROUPS, "'{t}'")} AS title,
    pos // 500 AS part_no, string_agg(c.id, '|' ORDER BY pos) AS pages FROM c GROUP BY wiki_id, g, part_no""",
)
def title_sections(spark, sf_dir):
    return wiki.title_sections(views.pages(spark, sf_dir), part_pages=500)


@register(
    "d12_importance_sections",
    f"""WITH {PAGES_SQL}, c AS (SELECT *, importance AS g FROM pages_v)
    SELECT wiki_id, ({_sections_case(fixed.IMPORTANCE_SECTIONS, '{i}')})::BIGINT AS section_no, 'section-' || g AS id,
    {_sections_case(fixed.IMPORTANCE_SECTIONS, "'{t}'")} AS title, pos // 500 AS part_no, string_agg(c.id, '|' ORDER BY pos) AS pages FROM c GROUP BY wiki_id, g, part_no""",
)
def importance_sections(spark, sf_dir):
    return wiki.importance_sections(views.pages(spark, sf_dir), part_pages=500)


@register("f5_first_pages", f"WITH {PAGES_SQL} SELECT wiki_id, arg_min(id, pos) AS page_id FROM pages_v GROUP BY 1")
def first_pages(spark, sf_dir):
    return wiki.first_pages(views.pages(spark, sf_dir))


@register(
    "j7_section_tree",
    f"""WITH RECURSIVE {SECTIONS_SQL}, walk AS (
      SELECT wiki_id, id, title, 0::BIGINT AS level, [id] AS trail, [pos] AS order_path FROM sections s
      WHERE NOT EXISTS (SELECT 1 FROM refs r WHERE r.wiki_id = s.wiki_id AND r.id = s.id)
      UNION ALL SELECT s.wiki_id, s.id, s.title, w.level + 1, list_append(w.trail, s.id), list_append(w.order_path, r.n)
      FROM walk w JOIN refs r ON r.wiki_id = w.wiki_id AND r.parent_id = w.id JOIN sections s ON s.wiki_id = r.wiki_id AND s.id = r.id
      WHERE NOT list_contains(w.trail, s.id))
    SELECT wiki_id, id, title, level, array_to_string(trail, '|') AS trail, array_to_string(order_path, '|') AS order_path FROM walk""",
)
def section_tree(spark, sf_dir):
    tree = wiki.section_tree(views.sections(spark, sf_dir), views.section_refs(spark, sf_dir))
    return tree.withColumn("order_path", F.array_join(F.transform("order_path", lambda x: x.cast("string")), "|"))


# Responses: a wiki per document; each text line is a page, some ids or importances are missing.
_LINE = f"""rl AS (SELECT doc_id, i, 'w' || regexp_replace(split_part(l, ' ', 1), '[^A-Za-z]', '', 'g') AS w, 'w' || regexp_replace(l, '[<>&]+', ' ', 'g') AS line
  FROM (SELECT doc_id, generate_subscripts(string_split(text, {NL}), 1) AS i, unnest(string_split(text, {NL})) AS l FROM documents))"""


def _responses(spark, sf_dir):
    """Well-formed, with a bare ampersand, or broken (an unclosed element) by document."""
    d = F.col("doc_id")

    def page(l, i):
        n = (i + 1).cast("string")
        w = F.concat(F.lit("w"), F.regexp_replace(F.split_part(l, F.lit(" "), F.lit(1)), "[^A-Za-z]", ""))
        title = F.concat(F.lit("w"), F.regexp_replace(l, "[<>&]+", " "))
        importance = (
            F.when(i % 3 == 0, "").when(i % 3 == 1, "<importance>high</importance>").otherwise("<importance>urgent</importance>")
        )
        return F.concat(
            F.lit('<page id="'), F.when((i % 4 == 3) & (d % 3 != 2), "").otherwise(F.concat(F.lit("p"), n)), F.lit('"><title>'), title, F.lit(" & "), n, F.lit("</title>"),
            importance, F.lit("<relevant_files><file_path>"), w, F.lit(".py</file_path><file_path>b.py</file_path></relevant_files>"),
            F.lit("<related_pages><related>p1</related></related_pages></page>"),
        )

    def section(l, i):
        n = (i + 1).cast("string")
        return F.concat(
            F.lit('<section id="s'), n, F.lit('"><title>T '), F.regexp_replace(l, "[<>&]+", " "), n, F.lit("</title><pages><page_ref>p"), n,
            F.lit("</page_ref></pages><subsections><section_ref>s"), ((i + 1) * 2).cast("string"), F.lit("</section_ref></subsections></section>"),
        )

    lines = F.split("text", "\n")
    xml = F.concat(
        F.lit("Sure:\n```xml\n<wiki_structure><title>Wiki "), d.cast("string"), F.lit("</title><description>d</description><sections>"),
        F.array_join(F.transform(lines, section), ""), F.lit("</sections><pages>"), F.array_join(F.transform(lines, page), "\n"),
        F.when(d % 3 == 2, "<broken>").otherwise(""), F.lit("</pages></wiki_structure>\n```"),
    )
    return table(spark, sf_dir, "documents").select(d.alias("wiki_id"), xml.alias("response"))


@register(
    "h24_h26_structure_pages",
    f"""WITH {_LINE} SELECT doc_id AS wiki_id, i - 1 AS pos, CASE WHEN (i - 1) % 4 = 3 AND doc_id % 3 <> 2 THEN 'page-' || i ELSE 'p' || i END AS id, line || ' & ' || i AS title,
    CASE (i - 1) % 3 WHEN 0 THEN 'medium' WHEN 1 THEN 'high' ELSE 'low' END AS importance, w || '.py|b.py' AS file_paths, 'p1' AS related_pages FROM rl""",
)
def structure_pages(spark, sf_dir):
    return wiki.structure_pages(wiki.parse_structures(_responses(spark, sf_dir)))


@register(
    "h27_structure_sections",
    f"""WITH {_LINE} SELECT doc_id AS wiki_id, i - 1 AS pos, 's' || i AS id, 'T ' || substr(line, 2) || i AS title, 'p' || i AS pages, 's' || (i * 2) AS subsections FROM rl""",
)
def structure_sections(spark, sf_dir):
    return wiki.structure_sections(wiki.parse_structures(_responses(spark, sf_dir)))


@register("h24_wiki_heads", "SELECT doc_id AS wiki_id, 'Wiki ' || doc_id AS title, 'd' AS description FROM documents")
def wiki_heads(spark, sf_dir):
    return wiki.wiki_heads(wiki.parse_structures(_responses(spark, sf_dir)))


@register(
    "h27_structure_roots",
    f"""WITH {_LINE}, n AS (SELECT doc_id, max(i) AS n FROM rl GROUP BY 1) SELECT doc_id AS wiki_id, 's' || i AS id FROM rl WHERE i % 2 = 1""",
)
def structure_roots(spark, sf_dir):
    """Both sides of the search for roots read the sections from storage; else every response would be parsed twice."""
    sections = cut_lineage(wiki.structure_sections(wiki.parse_structures(_responses(spark, sf_dir))).select("wiki_id", "id", "subsections"))
    return wiki.root_sections(sections, wiki.section_refs(sections)).select("wiki_id", "id")


@register(
    "e12_ordinal_ids",
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'page-' || (doc_id + 1) ELSE lang || doc_id END AS id FROM documents",
)
def ordinal_ids(spark, sf_dir):
    given = F.when(F.col("doc_id") % 3 == 0, F.when(F.col("doc_id") % 2 == 0, "")).otherwise(
        F.concat("lang", F.col("doc_id").cast("string"))
    )
    return table(spark, sf_dir, "documents").select("doc_id", wiki.ordinal_id(given, "page", F.col("doc_id")).alias("id"))


_MD_BODY = f"""'<a id=''' || p.id || '''></a>' || {NL} || {NL} || '## ' || p.title || {NL} || {NL} ||
  CASE WHEN len(related_pages) > 0 THEN '### Related Pages' || {NL} || {NL} || coalesce('Related topics: ' || links || {NL} || {NL}, '') ELSE '' END ||
  p.content || {NL} || {NL} || '---' || {NL} || {NL}"""


@register(
    "h28_a13_markdown_export",
    f"""WITH {PAGES_SQL}, refs AS (SELECT wiki_id, id AS page_id, unnest(related_pages) AS id, generate_subscripts(related_pages, 1) AS n FROM pages_v),
    l AS (SELECT r.wiki_id, r.page_id, string_agg('[' || p.title || '](#' || p.id || ')', ', ' ORDER BY n) AS links
      FROM refs r JOIN pages_v p ON p.wiki_id = r.wiki_id AND p.id = r.id GROUP BY 1, 2)
    SELECT DISTINCT wiki_id, 0::BIGINT AS section_no, 0::BIGINT AS part_no, '# Wiki Documentation for https://github.com/o/' || wiki_id || {NL} || {NL} ||
      'Generated on: {_AT}' || {NL} || {NL} || '## Table of Contents' || {NL} || {NL} AS text FROM pages_v
    UNION ALL SELECT wiki_id, 1, pos // 300, string_agg('- [' || title || '](#' || id || ')' || {NL}, '' ORDER BY pos) FROM pages_v GROUP BY 1, 3
    UNION ALL SELECT DISTINCT wiki_id, 2, 0, {NL} FROM pages_v
    UNION ALL SELECT p.wiki_id, 3, pos // 300, string_agg({_MD_BODY}, '' ORDER BY pos) FROM pages_v p LEFT JOIN l ON l.wiki_id = p.wiki_id AND l.page_id = p.id GROUP BY 1, 3""",
)
def markdown_export(spark, sf_dir):
    return wiki.markdown_parts(views.pages(spark, sf_dir), _url(), F.lit(_AT), part_pages=300)


@register(
    "h29_json_export",
    f"""WITH {PAGES_SQL}, c AS (SELECT wiki_id, count(*) AS n FROM pages_v GROUP BY 1)
    SELECT wiki_id, part_no, CASE WHEN part_no = 0 THEN n END AS page_count, string_agg(id || ':' || title || ':' || importance || ':' || md5(content) || ':' || array_to_string(related_pages, ','), ';' ORDER BY pos) AS pages,
    CASE WHEN part_no = 0 THEN 'https://github.com/o/' || wiki_id END AS repository FROM (SELECT *, pos // 300 AS part_no FROM pages_v) JOIN c USING (wiki_id) GROUP BY ALL""",
)
def json_export(spark, sf_dir):
    """The fragments, each closed to a document and read back field by field."""
    docs = wiki.json_parts(views.pages(spark, sf_dir), _url(), F.lit(_AT), part_pages=300)
    schema = (
        "metadata struct<repository:string,generated_at:string,page_count:bigint>, pages array<struct<id:string,title:string,"
        "content:string,filePaths:array<string>,importance:string,relatedPages:array<string>>>"
    )
    last = docs.groupBy("wiki_id").agg(F.max("part_no").alias("last"))
    opened = F.when(F.col("part_no") == 0, F.col("json")).otherwise(F.concat(F.lit('{"pages":['), F.substr("json", F.lit(2))))
    closed = F.when(F.col("part_no") == F.col("last"), opened).otherwise(F.concat(opened, F.lit("]}")))
    d = docs.join(last, "wiki_id").withColumn("d", F.from_json(closed, schema))
    line = F.transform(
        "d.pages",
        lambda p: F.concat_ws(
            ":", p["id"], p["title"], p["importance"], F.md5(p["content"]), F.array_join(p["relatedPages"], ",")
        ),
    )
    return d.select(
        "wiki_id", "part_no", F.col("d.metadata.page_count").alias("page_count"), F.array_join(line, ";").alias("pages"),
        F.col("d.metadata.repository").alias("repository"),
    )


@register(
    "a13_export_names",
    "SELECT doc_id, source || '_wiki_20240101_000000.md' AS name FROM documents",
)
def export_names(spark, sf_dir):
    url = F.concat(F.lit("https://github.com/o/"), "source", F.lit("/"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", wiki.export_name(url, F.lit("20240101_000000"), "md").alias("name")
    )


_BUDGET = 4000


@register(
    "e9_budget_context",
    f"""WITH RECURSIVE {PAGES_SQL}, p AS (SELECT wiki_id, CASE WHEN importance = 'high' THEN 0 ELSE 1 END AS phase, pos,
      '## ' || title || {NL} || content || {NL} || {NL} AS full_text,
      '## ' || title || {NL} || CASE WHEN regexp_matches(content, '# .*?\\n\\n(.*?)(?:\\n\\n|\\z)') THEN trim(regexp_extract(content, '# .*?\\n\\n(.*?)(?:\\n\\n|\\z)', 1))
        ELSE 'No summary available' END || {NL} || {NL} AS short_text FROM pages_v),
    o AS (SELECT *, row_number() OVER (PARTITION BY wiki_id ORDER BY phase, pos) AS i FROM p),
    walk AS (
      SELECT wiki_id, 0::BIGINT AS i, 0::BIGINT AS used, false AS entered, false AS stopped, '' AS context FROM (SELECT DISTINCT wiki_id FROM p)
      UNION ALL SELECT wiki_id, i, CASE WHEN skip THEN used ELSE used + length(t) END, entered OR (NOT skip AND phase = 1),
        stopped OR (NOT skip AND phase = 1 AND used + length(t) > {_BUDGET}), CASE WHEN skip THEN context ELSE context || t END
      FROM (SELECT w.wiki_id, o.i, w.used, w.entered, w.stopped, w.context, o.phase,
          CASE WHEN phase = 0 THEN w.used > {_BUDGET} ELSE w.stopped OR (NOT w.entered AND w.used >= {_BUDGET}) END AS skip,
          CASE WHEN phase = 0 OR w.used + length(full_text) <= {_BUDGET} THEN full_text ELSE short_text END AS t
        FROM walk w JOIN o ON o.wiki_id = w.wiki_id AND o.i = w.i + 1))
    SELECT wiki_id, arg_max(context, i) AS context, arg_max(used, i) AS used FROM walk GROUP BY 1""",
)
def budget_context(spark, sf_dir):
    return wiki.budget_context(views.pages(spark, sf_dir), _BUDGET)
