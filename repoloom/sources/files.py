"""Directory scans on executors.

Spark's own file sources skip names starting with ``_`` and files below dot
directories, which source trees need (``__init__.py``). Here directories are listed
level by level in tasks, paths are filtered before anything is opened, and bytes are
read in tasks as well; the driver only sees the number of directories left.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoloom.functions import fixed
from repoloom.functions.paths import extension
from repoloom.operators.code_facts import decode_files
from repoloom.operators.filters import classify, keep_path
from repoloom.session import cut_lineage

_ENTRY = "root string, repo string, path string, is_dir boolean, size long, mtime timestamp, list_error string"


def _file_system(root: str):
    """File system and base path of a root: a URI, or a plain local path."""
    from pyarrow import fs

    if root.startswith("file:/") and "://" not in root:  # as Hadoop writes local paths
        root = root[len("file:") :]
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root.rstrip("/"))


def _client(known: dict, root: str):
    """File system and base path of a root; one client per root and task."""
    if root not in known:
        known[root] = _file_system(root)
    return known[root]


_NAMES = ["root", "repo", "path", "is_dir", "size", "mtime", "list_error"]


def _list_dirs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    open_systems: dict = {}
    for pdf in frames:
        for root, repo, rel in zip(pdf["root"], pdf["repo"], pdf["path"]):
            system, base = _client(open_systems, root)
            where = f"{base}/{rel}" if rel else base
            try:
                found = system.get_file_info(fs.FileSelector(where, allow_not_found=True))
            except OSError as e:
                # What cannot be read is skipped and noted.
                yield pd.DataFrame([(root, repo, rel, False, 0, None, type(e).__name__)], columns=_NAMES)
                continue
            rows = [
                (root, repo, f"{rel}/{i.base_name}" if rel else i.base_name, i.type == fs.FileType.Directory, i.size or 0, i.mtime, None)
                for i in found
            ]
            # A directory of any size leaves in slices.
            for s in range(0, len(rows), 10_000):
                yield pd.DataFrame(rows[s : s + 10_000], columns=_NAMES)


def list_files(spark: SparkSession, roots: dict[str, str], hidden: bool = False) -> DataFrame:
    """Files below the roots (repo name -> URI): root, repo, path, size, mtime; see ``list_entries``."""
    return list_entries(spark, roots, hidden).filter("list_error IS NULL").drop("list_error")


def list_entries(spark: SparkSession, roots: dict[str, str], hidden: bool = False) -> DataFrame:
    """Files and, with a ``list_error``, the folders that could not be read.

    ``hidden`` also enters dot entries, which a plain recursive pattern leaves out.
    """
    level = spark.createDataFrame(
        [(u, r, "") for r, u in sorted(roots.items())], "root string, repo string, path string"
    )
    out = None
    while True:
        spread = level.repartition(F.xxhash64("root", "path"))
        found = spread.mapInPandas(_list_dirs, _ENTRY)
        if not hidden:
            found = found.filter(~F.substring_index("path", "/", -1).startswith("."))
        found = cut_lineage(found)
        files = found.filter("NOT is_dir").drop("is_dir")
        out = files if out is None else out.unionByName(files)
        level = found.filter("is_dir").select("root", "repo", "path")
        if level.isEmpty():
            return out


def read_bytes(paths: DataFrame, batch_bytes: int = 64 << 20) -> DataFrame:
    """Add ``content`` (binary) and ``read_error``; big and small files are mixed over all tasks."""
    schema = T.StructType(
        [*paths.schema.fields, T.StructField("content", T.BinaryType()), T.StructField("read_error", T.StringType())]
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_systems: dict = {}
        for pdf in frames:
            rows, held = [], 0
            for i, (root, rel) in enumerate(zip(pdf["root"], pdf["path"])):
                try:
                    system, base = _client(open_systems, root)
                    with system.open_input_stream(f"{base}/{rel}") as f:
                        data, error = f.read(), None
                except OSError as e:
                    data, error = None, type(e).__name__
                rows.append((i, data, error))
                held += len(data or b"")
                if held >= batch_bytes:
                    yield _with_content(pdf, rows)
                    rows, held = [], 0
            if rows:
                yield _with_content(pdf, rows)

    return paths.repartition(F.xxhash64("root", "path")).mapInPandas(run, schema)


def _with_content(pdf: pd.DataFrame, rows: list) -> pd.DataFrame:
    out = pdf.iloc[[r[0] for r in rows]].copy()
    out["content"] = [r[1] for r in rows]
    out["read_error"] = [r[2] for r in rows]
    return out


JAVA = (".java",)


def read_repositories(
    spark: SparkSession,
    roots: dict[str, str],
    excluded_dirs: Iterable[str] | None = None,
    excluded_files: Iterable[str] | None = None,
    included_dirs: Iterable[str] | None = None,
    included_files: Iterable[str] | None = None,
    compat: bool = False,
) -> DataFrame:
    """Code and documentation files with text; unreadable and non-UTF-8 files carry an error and no text."""
    listed = list_files(spark, roots).filter(
        keep_path(F.col("path"), excluded_dirs, excluded_files, included_dirs, included_files, compat)
    )
    return _read(classify(listed))


def has_extension(path: Column, extensions: Iterable[str] | None = None) -> Column:
    """True for a path with a parser language's extension (or one of the given ones), case-folded."""
    return F.lower(extension(path)).isin(sorted(extensions or fixed.LANGUAGE_BY_EXTENSION))


def project_files(spark: SparkSession, roots: dict[str, str], extensions: Iterable[str] | None = None) -> DataFrame:
    """All files with a parser language (or the given extensions, case-folded), from every directory."""
    return _read(list_files(spark, roots, hidden=True).filter(has_extension(F.col("path"), extensions)))


def java_files(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """Java files from every directory."""
    return project_files(spark, roots, JAVA)


def _read(paths: DataFrame) -> DataFrame:
    decoded = decode_files(read_bytes(paths))
    return decoded.withColumn("error", F.coalesce("read_error", "error")).drop("read_error")
