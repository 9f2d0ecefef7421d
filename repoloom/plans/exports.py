"""Queries that write named files and read them with the repository source."""

from __future__ import annotations

from pyspark.sql import functions as F

from repoloom.operators import wiki
from repoloom.plans import views
from repoloom.plans.catalog import register
from repoloom.plans.corpus import _fresh_store
from repoloom.plans.views import PAGES_SQL, table
from repoloom.plans.wikis import _AT, _url
from repoloom.sources import repository, text_files
from repoloom.sources.store import export_analysis, export_wikis

_ROW_BYTES = 1 << 16
_STAMP = "20240101_000000"


def _sizes(rows):
    """Characters, lines and largest row of each file."""
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return rows.groupBy("path").agg(
        F.sum(F.length("text")).alias("chars"), F.sum(lines).alias("lines"), (F.max(F.octet_length("text")) <= _ROW_BYTES + 3).alias("small_rows"), F.count("error").alias("errors")
    )


@register(
    "a1_repository_format",
    """SELECT source || '.md' AS path, sum(length(text) + 1)::BIGINT AS chars, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS lines,
    true AS small_rows, 0::BIGINT AS errors, 'docs' AS repo, max(strlen_sum) AS size FROM documents
    JOIN (SELECT source, sum(strlen(text) + 1)::BIGINT AS strlen_sum FROM documents GROUP BY 1) USING (source) GROUP BY source""",
)
def repository_format(spark, sf_dir):
    """The documents of a source as one file each, read back in rows of bounded size."""
    root, _ = _fresh_store(spark, "tree")
    rows = table(spark, sf_dir, "documents").select(F.concat("source", F.lit(".md")).alias("file"), "doc_id", F.concat("text", F.lit("\n")).alias("text"))
    text_files.write_files(rows, root, ["doc_id"])
    read = repository.load(spark, {"docs": root}, rowBytes=_ROW_BYTES, partitionBytes=1 << 20).filter("extension = '.md'")
    return _sizes(read).join(read.groupBy("path", "repo").agg(F.max("size").alias("size")), "path")


def _markdown_sql() -> str:
    from repoloom.plans.catalog import ORACLES

    return ORACLES["h28_a13_markdown_export"]


@register(
    "a13_exported_files",
    f"""SELECT wiki_id || '_wiki_{_STAMP}.md' AS path, sum(length(text))::BIGINT AS chars, sum(length(text) - length(replace(text, chr(10), '')))::BIGINT AS lines,
    true AS small_rows, 0::BIGINT AS errors FROM ({_markdown_sql()}) GROUP BY wiki_id""",
)
def exported_files(spark, sf_dir):
    """Markdown exports under their promised names."""
    root, _ = _fresh_store(spark, "exports")
    pages = views.pages(spark, sf_dir)
    export_wikis(wiki.markdown_parts(pages, _url(), F.lit(_AT), part_pages=300), pages, _url(), F.lit(_STAMP), "md", root)
    return _sizes(repository.load(spark, {"exports": root}, rowBytes=_ROW_BYTES))


@register(
    "a13_exported_json",
    f"""WITH {PAGES_SQL} SELECT wiki_id || '_wiki_{_STAMP}.json' AS file, 'https://github.com/o/' || wiki_id AS repository, count(*) AS page_count, count(*) AS pages,
    sum(length(content))::BIGINT AS chars FROM pages_v GROUP BY wiki_id""",
)
def exported_json(spark, sf_dir):
    """Each export is one JSON document."""
    root, _ = _fresh_store(spark, "exports")
    pages = views.pages(spark, sf_dir)
    export_wikis(wiki.json_parts(pages, _url(), F.lit(_AT), part_pages=300), pages, _url(), F.lit(_STAMP), "json", root)
    schema = "metadata struct<repository:string,page_count:bigint>, pages array<struct<id:string,content:string>>"
    read = spark.read.schema(schema).option("multiLine", True).json(root).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    chars = F.aggregate("pages", F.lit(0).cast("long"), lambda n, p: n + F.length(p["content"]))
    return read.select("file", "metadata.repository", "metadata.page_count", F.size("pages").alias("pages"), chars.alias("chars"))


@register(
    "a8_exported_records",
    """SELECT source || '.json' AS path, sum(length(text) + 1)::BIGINT AS chars, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS lines, true AS small_rows, 0::BIGINT AS errors
    FROM documents GROUP BY source""",
)
def exported_records(spark, sf_dir):
    """Analysis records of projects, one file each, from parts of any number."""
    root, _ = _fresh_store(spark, "records")
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("project"), F.col("doc_id").alias("part_no"), F.concat("text", F.lit("\n")).alias("record"))
    export_analysis(rows, root)
    return _sizes(repository.load(spark, {"records": root}, rowBytes=_ROW_BYTES))
