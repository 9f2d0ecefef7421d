"""The data source ``repository``: source trees as rows, planned by bytes.

    register(spark)
    spark.read.format("repository").option("roots", '{"demo": "s3://bucket/tree"}').load()

Columns: repo, path, extension, size, mtime, part_no, n_parts, text, error. A file of over ``rowBytes`` comes in several rows, each read by
its own range request and cut at characters; the texts of its parts by ``part_no`` are the file. Ranges are packed into partitions of
``partitionBytes``, so one huge file keeps many tasks busy and thousands of small ones share one. Filters on repo, path, extension and size
are pushed: a file that they leave out is never opened.

Where the driver lists the roots itself, ``maxFiles`` bounds what it holds. For larger trees ``write_manifest`` lists in tasks and stores the
ranges, one Parquet file per partition; with the option ``manifest`` the driver sees the names of those files only.
"""

from __future__ import annotations

import json
import operator
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition

from repoloom.sources.files import _file_system, list_files

SCHEMA = "repo string, path string, extension string, size long, mtime timestamp, part_no long, n_parts long, text string, error string"
PARTITION_BYTES, ROW_BYTES, OPEN_BYTES = 64 << 20, 8 << 20, 64 << 10
MAX_FILES = 1_000_000
_BATCH_BYTES = 16 << 20

_COMPARE: dict[str, Callable] = {
    "EqualTo": operator.eq,
    "In": lambda value, wanted: value in wanted,
    "StringStartsWith": str.startswith,
    "StringEndsWith": str.endswith,
    "StringContains": operator.contains,
    "GreaterThan": operator.gt,
    "GreaterThanOrEqual": operator.ge,
    "LessThan": operator.lt,
    "LessThanOrEqual": operator.le,
}
_PUSHED = ("repo", "path", "extension", "size")


@dataclass
class Range:
    """Part ``part_no`` of a file."""

    root: str
    repo: str
    path: str
    size: int
    mtime: datetime | None
    part_no: int
    n_parts: int


@dataclass
class Ranges(InputPartition):
    ranges: list[Range]


@dataclass
class Stored(InputPartition):
    uri: str


def extension_of(path: str) -> str:
    return os.path.splitext(path)[1]


def read_part(stream, row_bytes: int, part_no: int, n_parts: int) -> bytes:
    """Bytes of a part: from the first character that begins in its range to the end of the last one that does."""
    start = part_no * row_bytes
    stream.seek(start)
    if part_no == n_parts - 1:
        data, size = stream.read(), None
    else:
        data, size = stream.read(row_bytes + 3), row_bytes
    lead = 0
    while part_no and lead < min(3, len(data)) and data[lead] & 0xC0 == 0x80:
        lead += 1
    end = len(data) if size is None else size
    while size is not None and end < len(data) and data[end] & 0xC0 == 0x80:
        end += 1
    return data[lead:end]


class RepositoryReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.manifest = options.get("manifest")
        self.hidden = options.get("hidden", "false").lower() == "true"
        self.partition_bytes, self.row_bytes = int(options.get("partitionbytes", PARTITION_BYTES)), int(options.get("rowbytes", ROW_BYTES))
        self.max_files = int(options.get("maxfiles", MAX_FILES))
        path = options.get("path")
        self.roots = json.loads(options["roots"]) if "roots" in options else {}
        if path:
            self.roots[options.get("repo") or path.rstrip("/").rsplit("/", 1)[-1]] = path
        if not self.roots and not self.manifest:
            raise ValueError("give a path, roots or a manifest")
        self.filters: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            kind, column = type(f).__name__, getattr(f, "attribute", ("",))[0]
            if column in _PUSHED and kind == "IsNotNull":
                continue  # they never are null
            if column in _PUSHED and kind in _COMPARE and getattr(f, "value", None) is not None:
                self.filters.append((column, kind, f.value))
            else:
                yield f

    def _wanted(self, repo: str, path: str, size: int) -> bool:
        have = {"repo": repo, "path": path, "extension": extension_of(path), "size": size}
        return all(_COMPARE[kind](have[column], value) for column, kind, value in self.filters)

    def _listed(self) -> Iterator[Range]:
        from pyarrow import fs

        seen = 0
        for repo, root in sorted(self.roots.items()):
            system, base = _file_system(root)
            folders = [""]
            while folders:
                folder = folders.pop()
                try:
                    entries = system.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base, allow_not_found=True))
                except OSError:
                    continue  # what cannot be read is left out, as in list_files
                for e in sorted(entries, key=lambda e: e.base_name):
                    if e.base_name.startswith(".") and not self.hidden:
                        continue
                    path = f"{folder}/{e.base_name}" if folder else e.base_name
                    if e.type == fs.FileType.Directory:
                        folders.append(path)
                    elif self._wanted(repo, path, e.size or 0):
                        seen += 1
                        if seen > self.max_files:
                            raise ValueError(f"more than {self.max_files} files to plan on the driver: write a manifest")
                        size = e.size or 0
                        parts = max(1, -(-size // self.row_bytes))
                        yield from (Range(root, repo, path, size, e.mtime, i, parts) for i in range(parts))

    def partitions(self) -> list[InputPartition]:
        if self.manifest:
            from pyarrow import fs

            system, base = _file_system(self.manifest)
            names = sorted(i.path for i in system.get_file_info(fs.FileSelector(base)) if i.base_name.endswith(".parquet"))
            return [Stored(n) for n in names] or [Ranges([])]
        out, held, size = [], [], 0
        for r in self._listed():
            cost = min(r.size - r.part_no * self.row_bytes, self.row_bytes) + OPEN_BYTES
            if held and size + cost > self.partition_bytes:
                out.append(Ranges(held))
                held, size = [], 0
            held.append(r)
            size += cost
        return [*out, Ranges(held)]

    def _ranges(self, partition: InputPartition) -> Iterator[Range]:
        if isinstance(partition, Ranges):
            yield from partition.ranges
            return
        import pyarrow.parquet as pq

        system, _ = _file_system(self.manifest)
        with system.open_input_file(partition.uri) as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=list(Range.__dataclass_fields__)):
                for row in batch.to_pylist():
                    if self._wanted(row["repo"], row["path"], row["size"]):
                        yield Range(**row)

    def read(self, partition: InputPartition) -> Iterator:
        import pyarrow as pa

        systems: dict = {}
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        rows, held = [], 0
        for r in self._ranges(partition):
            if r.root not in systems:
                systems[r.root] = _file_system(r.root)
            system, base = systems[r.root]
            text = error = None
            try:
                with system.open_input_file(f"{base}/{r.path}") as f:
                    text = read_part(f, self.row_bytes, r.part_no, r.n_parts).decode()
            except OSError as e:
                error = type(e).__name__
            except UnicodeDecodeError:
                error = "invalid utf-8"
            rows.append((r.repo, r.path, extension_of(r.path), r.size, r.mtime, r.part_no, r.n_parts, text, error))
            held += len(text or "")
            if held >= _BATCH_BYTES or len(rows) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


class RepositorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RepositoryReader:
        return RepositoryReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let Spark push filters into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RepositorySource)


def load(spark: SparkSession, roots: dict[str, str], **options) -> DataFrame:
    """Rows of the source trees (repo name -> URI)."""
    register(spark)
    return spark.read.format("repository").option("roots", json.dumps(roots)).options(**options).load()


def write_manifest(
    spark: SparkSession, roots: dict[str, str], path: str, keep: Column | None = None, partition_bytes: int = PARTITION_BYTES, row_bytes: int = ROW_BYTES
) -> None:
    """Store the ranges of all files below the roots, one Parquet file per partition of about ``partition_bytes``.

    Listing runs in tasks, level by level; a condition on repo, path and size may leave files out. Ranges are dealt out by hash: each is
    small against a partition, so partitions come out even. Read it with the same ``rowBytes``.
    """
    files = list_files(spark, roots)
    files = files if keep is None else files.filter(keep)
    parts = F.greatest(F.lit(1), F.ceil(F.col("size") / row_bytes)).cast("long")
    ranges = files.select("root", "repo", "path", "size", "mtime", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part_no"), parts.alias("n_parts"))
    cost = ranges.agg(F.sum(F.least(F.lit(row_bytes), F.col("size") - F.col("part_no") * row_bytes) + OPEN_BYTES)).first()[0] or 0
    ranges.repartition(max(1, -(-cost // partition_bytes)), F.xxhash64("root", "path", "part_no")).write.mode("overwrite").parquet(path)


def whole_files(rows: DataFrame) -> DataFrame:
    """One row per file, its parts joined; for files known to fit in a row. An error in one part is an error of the file."""
    piece = F.array_sort(F.collect_list(F.struct("part_no", "text")))
    joined = rows.groupBy("repo", "path", "extension", "size", "mtime").agg(F.min("error").alias("error"), F.array_join(F.transform(piece, lambda x: x["text"]), "").alias("text"))
    return joined.withColumn("text", F.when(F.col("error").isNull(), F.col("text")))
