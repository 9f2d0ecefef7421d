"""Incremental refresh of a chunk table from a table of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repoloom.streaming.versioned import VersionedTable, new_id


def content_hash(text: str = "text") -> Column:
    return F.sha2(F.col(text), 256)


def changed_files(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Files of the listing (path, hash, ...) that the store lacks or holds with another hash."""
    return current.join(stored.select("path", "hash").distinct(), ["path", "hash"], "left_anti")


def refreshed(current: DataFrame, stored: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Store rows of unchanged files plus newly built rows; files gone from the listing drop out.

    Only changed files reach ``build``, which keeps ``path`` and ``hash``.
    """
    kept = stored.join(current.select("path", "hash").distinct(), ["path", "hash"], "left_semi")
    return kept.unionByName(build(changed_files(current, stored)))


def latest_versions(files: DataFrame) -> DataFrame:
    """Newest row per path of a table of file versions (path, version, ...)."""
    rest = [c for c in files.columns if c != "path"]
    return files.groupBy("path").agg(F.max_by(F.struct(*rest), "version").alias("v")).select("path", "v.*")


# ---------------------------------------------------------------- stores of streams


def run_to_end(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None]):
    """Process everything a stream has now, batch by batch."""
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


_ENTRY = "path string, version long, hash string, rows_batch string"


def newest_entries(entries: DataFrame) -> DataFrame:
    """One ledger entry per path: that of the highest version."""
    return entries.groupBy("path").agg(F.max_by(F.struct("version", "hash", "rows_batch"), "version").alias("e")).select("path", "e.*")


def ledger(spark: SparkSession, store: str) -> VersionedTable:
    """File versions taken in so far: path, version, hash and the batch that holds the rows."""
    return VersionedTable(spark, f"{store}/ledger", "path", newest_entries)


def rows_table(spark: SparkSession, store: str) -> VersionedTable:
    """Rows built from file versions. Compaction drops those that a newer version of the file has replaced."""

    def living(rows: DataFrame) -> DataFrame:
        known = ledger(spark, store).read()
        if known is None:
            return rows
        known = newest_entries(known).select("path", F.col("version").alias("__v"), F.col("rows_batch").alias("__b"))
        joined = rows.join(known, "path", "left")
        replaced = F.coalesce((F.col("__v") > F.col("version")) & (F.col("__b") != F.col("rows_batch")), F.lit(False))
        return joined.filter(~replaced).select(*rows.columns)

    return VersionedTable(spark, f"{store}/rows", "path", living)


def refresh_stream(
    spark: SparkSession, files: DataFrame, store: str, checkpoint: str, build: Callable[[DataFrame], DataFrame]
):
    """Take in all new file versions (path, version, text); ``build`` keeps path, hash and version.

    The store has a table of rows and a ledger of file versions, both compacted as they grow. A batch looks up its paths in the ledger,
    builds the files whose content changed, appends their rows, and then its entries to the ledger; that append is the
    commit, so rows without an entry are never seen and a repeated batch finds nothing new. A version older than the known one changes
    nothing, also if the known one has no rows; a newer one with the same content gets an entry and is not built again.
    """
    book, table = ledger(spark, store), rows_table(spark, store)

    def batch(rows: DataFrame, epoch: int) -> None:
        newest = latest_versions(rows).withColumn("hash", content_hash()).persist()
        try:
            known = book.find(newest)
            known = spark.createDataFrame([], _ENTRY) if known is None else newest_entries(known)
            known = known.select("path", F.col("version").alias("v"), F.col("hash").alias("h"), F.col("rows_batch").alias("b"))
            fresh = newest.join(known, "path", "left").filter(F.col("v").isNull() | (F.col("version") > F.col("v"))).persist()
            count = fresh.count()
            if not count:
                return
            changed = F.col("h").isNull() | (F.col("hash") != F.col("h"))
            name = new_id()
            built = build(fresh.filter(changed).drop("v", "h", "b")).withColumn("rows_batch", F.lit(name)).persist()
            table.append(built, built.count())
            book.append(fresh.select("path", "version", "hash", F.when(changed, F.lit(name)).otherwise(F.col("b")).alias("rows_batch")), count)
            built.unpersist()
            fresh.unpersist()
            book.compact()
            table.compact()
        finally:
            newest.unpersist()

    return run_to_end(files, checkpoint, batch)


def stored_rows(spark: SparkSession, store: str) -> DataFrame:
    """Rows of the newest version of every file."""
    book, table = ledger(spark, store), rows_table(spark, store)
    while True:
        # Rows appended behind this entry, or dropped for a later one, would not fit it.
        version = book.versions()[-1]
        rows = table.read()
        if book.versions()[-1] == version:
            break
    entries = newest_entries(book.read(version)).select("path", "rows_batch", F.col("version").alias("__newest"))
    found = rows.join(entries, ["path", "rows_batch"])
    return found.select(*[F.col("__newest").alias(c) if c == "version" else F.col(c) for c in rows.columns if c != "rows_batch"])


def vacuum(spark: SparkSession, store: str, versions: int = 2, grace_seconds: float = 24 * 3600) -> int:
    """Delete what compaction has replaced and no reader of the last versions needs."""
    return sum(t.vacuum(versions, grace_seconds) for t in (ledger(spark, store), rows_table(spark, store)))
