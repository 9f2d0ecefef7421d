"""Stored tables: chunk vectors, wikis, analyses."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repoloom.functions import fixed
from repoloom.functions.paths import parse_store_name
from repoloom.functions.text import known_language
from repoloom.operators.columns import join_salted
from repoloom.operators.wiki import export_name
from repoloom.session import cut_lineage, path_exists
from repoloom.sources.text_files import distinct_names, write_files

WIKI_KEY = ["repo_type", "owner", "repo", "language"]


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table, or None when it is absent, half written, damaged or empty.

    A complete write leaves a success marker. Counting reads the footers of all files, so a broken one is found here.
    """
    if not path_exists(spark, f"{path}/_SUCCESS"):
        return None
    try:
        df = spark.read.parquet(path)
        return df if df.count() else None
    except (PySparkException, Py4JJavaError):
        return None


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], partition_by: list[str] | None = None) -> DataFrame:
    """Reuse the stored table when there is a complete one, else build it and store it in its place."""
    stored = read_or_none(spark, path)
    if stored is not None:
        return stored
    writer = build().write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.parquet(path)


# Wikis are stored in hash buckets of their key, so that their number doesn't grow with the store; the key stays a string in the rows.
WIKI_BUCKETS = 256


def _bucket(*key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(WIKI_BUCKETS)).cast("int")


def read_wikis(spark: SparkSession, path: str) -> DataFrame:
    """All stored wikis."""
    return spark.read.parquet(path).drop("bucket")


def _replace_buckets(rows: DataFrame, path: str) -> None:
    # Rebalancing keeps a bucket's rows together but splits one that is larger than a usual partition.
    writer = rows.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("bucket").parquet(path)


def save_wikis(wikis: DataFrame, path: str) -> None:
    """Write wikis (key columns + data); an existing wiki with the same key is replaced, others stay.

    Only the buckets of the given keys are read and written again.
    """
    spark = wikis.sparkSession
    rows = wikis.withColumn("bucket", _bucket(*[F.col(c) for c in WIKI_KEY]))
    if path_exists(spark, path):
        rows = cut_lineage(rows)
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # at most WIKI_BUCKETS numbers
        stored = spark.read.parquet(path).filter(F.col("bucket").isin(touched))
        kept = stored.join(rows.select(*WIKI_KEY).distinct(), WIKI_KEY, "left_anti")
        # The rows that stay are read before their files are replaced.
        rows = rows.unionByName(cut_lineage(kept), allowMissingColumns=True)
    _replace_buckets(rows, path)


def _key_filter(key: dict[str, str]) -> Column:
    cond = F.col("bucket") == _bucket(*[F.lit(key[c]) for c in WIKI_KEY])
    for c in WIKI_KEY:
        cond = cond & (F.col(c) == key[c])
    return cond


def read_wiki(spark: SparkSession, path: str, key: dict[str, str]) -> DataFrame:
    """One stored wiki; only its bucket is read. An unknown language falls back to the default."""
    if key["language"] not in fixed.LANGUAGE_NAMES:
        key = {**key, "language": fixed.DEFAULT_LANGUAGE}
    return spark.read.parquet(path).filter(_key_filter(key)).drop("bucket")


def delete_wiki(spark: SparkSession, path: str, key: dict[str, str]) -> bool:
    """Remove one stored wiki from its bucket; an unsupported language is rejected."""
    if key["language"] not in fixed.LANGUAGE_NAMES:
        raise ValueError(f"unsupported language: {key['language']}")
    table = spark.read.parquet(path)
    if table.filter(_key_filter(key)).isEmpty():
        return False
    number = spark.range(1).select(_bucket(*[F.lit(key[c]) for c in WIKI_KEY]).alias("b")).first()["b"]
    kept = cut_lineage(table.filter((F.col("bucket") == number) & ~_key_filter(key)))
    if kept.isEmpty():
        # A dynamic overwrite leaves a partition without new rows as it is.
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={number}")
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    else:
        _replace_buckets(kept, path)
    return True


def upserted(stored: DataFrame, changes: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Rows after replacing every changed key."""
    key = key or WIKI_KEY
    return stored.join(changes.select(*key).distinct(), key, "left_anti").unionByName(changes)


def without_keys(stored: DataFrame, keys: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Rows after deleting keys."""
    key = key or WIKI_KEY
    return stored.join(keys.select(*key).distinct(), key, "left_anti")


def stored_files(spark: SparkSession, path: str) -> DataFrame:
    """Names and modification times below a folder; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("file_name"), "modificationTime")


def project_catalogue(files: DataFrame, prefix: str = "wiki_cache_") -> DataFrame:
    """Stored wikis by file name (file_name, modificationTime); names of another form are skipped."""
    return (
        files.withColumn("k", parse_store_name(F.col("file_name"), prefix))
        .filter("k IS NOT NULL")
        .select(
            F.col("file_name").alias("id"),
            "k.owner",
            "k.repo",
            F.concat("k.owner", F.lit("/"), "k.repo").alias("name"),
            "k.repo_type",
            F.unix_millis(F.col("modificationTime").cast("timestamp")).alias("submitted_at"),
            "k.language",
        )
    )


def newest_first(projects: DataFrame) -> DataFrame:
    return projects.orderBy(F.desc("submitted_at"), "id")


def write_analysis(analysis: DataFrame, path: str) -> None:
    """JSON records partitioned by project."""
    analysis.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project").json(path)


def analysis_record(projects: DataFrame, records: DataFrame, limit: int = fixed.EXTRACT_BYTES_LIMIT) -> DataFrame:
    """Stored record per project, in ordered parts: ``{}`` when missing, one part up to the size limit, several beyond it.

    Parts follow each other by ``part_no``; ``reason`` says how to route the record. A part has at most
    ``limit`` bytes, since a character has at most four.
    """
    joined = projects.join(records.select("project", "record"), "project", "left")
    large = F.coalesce(F.octet_length("record") > limit, F.lit(False))
    size = max(1, limit // 4)
    parts = F.when(large, F.ceil(F.length("record") / size)).otherwise(F.lit(1))
    at = joined.withColumn("part_no", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)))
    piece = F.when(large, F.substr("record", (F.col("part_no") * size + 1).cast("int"), F.lit(size))).otherwise(F.col("record"))
    return at.select(
        "project",
        "part_no",
        F.when(F.col("record").isNull(), "{}").otherwise(piece).alias("record"),
        F.when(F.col("record").isNull(), "missing").when(large, "in parts").alias("reason"),
    )


def stored_language(code: Column) -> Column:
    """Language used for reading and writing."""
    return known_language(code)


def save_vectors(vectors: DataFrame, path: str) -> None:
    """Vector table keyed by vec_id (vec_id, text, vector, meta)."""
    vectors.select("vec_id", "text", "vector", "meta").write.mode("overwrite").parquet(path)


def write_markdown(parts: DataFrame, path: str) -> None:
    """Markdown exports, one folder per wiki; its files in name order are the document.

    Range partitioning by position keeps the order over any number of files, so a
    huge wiki is written by many tasks.
    """
    order = ["wiki_id", "section_no", "part_no"]
    # Every part ends with a line feed, which the writer adds itself.
    lines = parts.withColumn("text", F.regexp_replace("text", r"\n\z", ""))
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("wiki_id", "text").write.mode(
        "overwrite"
    ).partitionBy("wiki_id").text(path)


def write_json_export(documents: DataFrame, path: str) -> None:
    """JSON exports, one folder per wiki, one document per line."""
    order = ["wiki_id", "part_no"]
    documents.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "wiki_id", F.col("json").alias("value")
    ).write.mode("overwrite").partitionBy("wiki_id").text(path)


def export_wikis(parts: DataFrame, pages: DataFrame, repo_url: Column, stamp: Column, extension: str, path: str) -> None:
    """Write Markdown or JSON parts as one file ``{repo}_wiki_{stamp}.{extension}`` per wiki, all of them or none.

    Wikis that would share a name have their wiki_id in it.
    """
    names = distinct_names(pages.withColumn("__name", export_name(repo_url, stamp, extension)), "wiki_id", F.col("__name"))
    order = [c for c in ("section_no", "part_no") if c in parts.columns]
    text = F.col("text" if "text" in parts.columns else "json")
    rows = join_salted(parts.select("wiki_id", *order, text.alias("text")), names, ["wiki_id"], F.col("part_no"))
    write_files(rows, path, order)


def export_analysis(records: DataFrame, path: str) -> None:
    """Write analysis records in parts (project, part_no, record) as one file ``{project}.json`` per project."""
    safe = F.regexp_replace(F.col("project"), r"[/\x00]", "_")
    write_files(records.select(F.concat(safe, F.lit(".json")).alias("file"), "part_no", F.col("record").alias("text")), path, ["part_no"])


def save_bucketed(rows: DataFrame, table: str, path: str, key: str, buckets: int) -> DataFrame:
    """Store rows at ``path`` in buckets of their key, as a table of the session's catalog, and return it.

    A join on the key reads the buckets as they lie: only the other side is shuffled, into as many partitions as there are buckets. Choose them so
    that one bucket fits a task.
    """
    rows.write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("overwrite").saveAsTable(table)
    return rows.sparkSession.table(table)
