"""The data sink ``text_files``: one file of a given name per group of rows, all of them or none.

    write_files(parts, path, ["section_no", "part_no"])        # parts: file, text and the order of the texts

Rows of a file come to one task in order and are written one after the other, so a document of any size needs no more memory than a
row. Tasks write below a hidden folder of the job; the commit moves finished files to their names, an abort removes the folder. A task that
runs twice writes two hidden files, one of which is moved.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from repoloom.sources.files import _file_system


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # hidden path, name


class TextFilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite
        self.hidden = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        system, base = _file_system(self.path)
        folder = f"{base}/{self.hidden}/{uuid.uuid4().hex}"
        files, names, out = [], set(), None
        try:
            for batch in iterator:
                at = batch.schema.get_field_index
                for name, text in zip(batch.column(at("file")).to_pylist(), batch.column(at("text")).to_pylist()):
                    if not files or files[-1][1] != name:
                        _check_name(name)
                        if name in names:
                            raise ValueError(f"rows of {name} do not follow each other")
                        if out is not None:
                            out.close()
                        system.create_dir(folder)
                        names.add(name)
                        files.append((f"{folder}/{len(files)}", name))
                        out = system.open_output_stream(files[-1][0])
                    out.write((text or "").encode())
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, base = _file_system(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            raise ValueError("rows of one file were in several tasks")
        system.create_dir(base)
        for hidden, name in files:
            system.move(hidden, f"{base}/{name}")
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(base)):
                if old.type == fs.FileType.File and old.base_name not in set(names):
                    system.delete_file(old.path)
        self._clear(system, base)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_file_system(self.path))

    def _clear(self, system, base: str) -> None:
        from pyarrow import fs

        folder = f"{base}/{self.hidden}"
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


def _check_name(name: str | None) -> None:
    if not name or "/" in name or "\0" in name or name.startswith((".", "_")):
        raise ValueError(f"not a file name: {name!r}")


class TextFilesSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return "file string, text string"

    def writer(self, schema, overwrite: bool) -> TextFilesWriter:
        return TextFilesWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TextFilesSink)


def write_files(parts: DataFrame, path: str, order: list[str], overwrite: bool = False) -> None:
    """Write ``text`` of all rows of a ``file`` into a file of that name below ``path``, in the given order.

    Files of the same name are replaced; ``overwrite`` also removes the other files of the folder.
    """
    register(parts.sparkSession)
    rows = parts.repartition("file").sortWithinPartitions("file", *order).select("file", "text")
    rows.write.format("text_files").mode("overwrite" if overwrite else "append").save(path)


def distinct_names(rows: DataFrame, key: str, name: Column) -> DataFrame:
    """key and file of every key; where keys share a name, each of them has its key in it, before the extension."""
    named = rows.select(key, name.alias("file")).distinct()
    shared = named.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    stem, ending = F.regexp_extract("file", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("file", r"^(.*?)(\.[^.]*)?$", 2)
    own = F.concat(stem, F.lit("_"), F.regexp_replace(F.col(key).cast("string"), r"[/\x00]", "_"), ending)
    return named.join(shared, "file").select(key, F.when(F.col("n") > 1, own).otherwise(F.col("file")).alias("file"))
