"""Repository trees and catalogue rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoloom.functions import payloads as pl
from repoloom.functions.paths import file_name
from repoloom.operators.columns import join_salted
from repoloom.operators.filters import visible_in_tree
from repoloom.operators.ordered import number_rows


def tree_parts(files: DataFrame, part_rows: int = 100_000) -> DataFrame:
    """Sorted path list per repository as text, in parts of at most ``part_rows`` paths."""
    numbered = number_rows(files.select("repo", "path").distinct(), ["repo"], ["path"], "n")
    return numbered.groupBy("repo", F.floor(F.col("n") / part_rows).alias("part_no")).agg(
        F.array_join(F.sort_array(F.collect_list("path")), "\n").alias("file_tree")
    )


def readmes(files: DataFrame) -> DataFrame:
    """First README of each repository, by depth and path."""
    rows = files.filter(F.lower(file_name(F.col("path"))) == "readme.md")
    at = F.struct(F.size(F.split("path", "/")), F.col("path"))
    return rows.groupBy("repo").agg(F.min_by("text", at).alias("readme"))


def repository_tree(files: DataFrame, part_rows: int = 100_000) -> DataFrame:
    """Visible tree of each repository with its README on the first part."""
    shown = files.filter(visible_in_tree(F.col("path")))
    first = F.col("part_no") == 0
    # The README belongs to the first part only, so a repository of many parts meets it once.
    tops = readmes(shown).withColumn("part_no", F.lit(0).cast("long"))
    return tree_parts(shown, part_rows).join(tops, ["repo", "part_no"], "left").select(
        "repo", "part_no", "file_tree", F.when(first, F.coalesce("readme", F.lit(""))).alias("readme")
    )


def type_rollup(summaries: DataFrame, keys: list[str], name: str, item: Column, part_rows: int = 10_000) -> DataFrame:
    """Per file type: file count and nested file summaries, in parts of at most ``part_rows`` files.

    ``name`` is the unique sort column inside a type.
    """
    counts = summaries.groupBy(*keys).agg(F.count(F.lit(1)).alias("file_count"))
    numbered = number_rows(summaries.withColumn("__item", item), keys, [name], "n")
    parts = numbered.groupBy(*keys, F.floor(F.col("n") / part_rows).alias("part_no")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "__item"))), lambda x: x["__item"]).alias("files")
    )
    return join_salted(parts, counts, keys, F.col("part_no"))


def usage_by(responses: DataFrame, keys: list[str], body: str = "response") -> DataFrame:
    """Token usage totals of response records."""
    u = pl.usage_totals(F.col(body))
    return responses.withColumn("u", u).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("responses"),
        F.sum("u.prompt_tokens").alias("prompt_tokens"),
        F.sum("u.completion_tokens").alias("completion_tokens"),
        F.sum("u.total_tokens").alias("total_tokens"),
    )


def key_info(files: DataFrame, statistics: DataFrame, classes: DataFrame, functions: DataFrame, deps: DataFrame) -> DataFrame:
    """Short summary per file: classes with first methods, functions, import count and dependencies."""
    cls = classes.groupBy("file_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("class_line", "class_name", "methods", "method_count"))),
            lambda x: F.struct(
                x["class_name"].alias("name"), x["methods"].alias("methods"), x["method_count"].alias("method_count")
            ),
        ).alias("key_classes")
    )
    fun = functions.groupBy("file_id").agg(
        F.transform(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "line_no", "name", F.coalesce("params", F.lit("")).alias("parameters"),
                        F.coalesce("return_type", F.lit("unknown")).alias("return_type"),
                    )
                )
            ),
            lambda x: F.struct(
                x["name"].alias("name"), x["parameters"].alias("parameters"), x["return_type"].alias("return_type")
            ),
        ).alias("key_functions")
    )
    return (
        files.join(statistics.select("file_id", "total_imports"), "file_id", "left")
        .join(cls, "file_id", "left")
        .join(fun, "file_id", "left")
        .join(deps, "file_id", "left")
        .withColumn("imports_count", F.coalesce("total_imports", F.lit(0)))
        .drop("total_imports")
    )
