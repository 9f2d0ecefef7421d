"""Batch embedding and vector checks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoloom.functions import fixed
from repoloom.functions.literals import bound
from repoloom.operators.ordered import number_rows_by_id
from repoloom.session import cut_lineage

EmbedFn = Callable[[list[str]], Sequence[Sequence[float]]]


def hashing_embedder(dims: int = 256) -> EmbedFn:
    """Word-count vectors over hashed buckets, L2-normalised; needs no model and no network."""

    @lru_cache(maxsize=200_000)
    def bucket(word: str) -> int:
        return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dims

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for i, t in enumerate(texts):
            found = [bucket(w) for w in t.split(" ") if w]
            if found:
                out[i] = np.bincount(found, minlength=dims)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=out, where=norms > 0)

    return embed


def embed_texts(
    df: DataFrame, make: Callable[[], EmbedFn], text: str = "text", batch: int = fixed.EMBED_BATCH
) -> DataFrame:
    """Add ``vector`` and ``embed_status`` (ok, empty, error).

    ``make`` builds the embedder once per task. A failing batch yields empty
    vectors and the job goes on; row order inside a partition is kept.
    """
    schema = T.StructType(
        [*df.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("embed_status", T.StringType())]
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = make()
        for pdf in frames:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch].copy()
                try:
                    vectors = fn([t or "" for t in part[text]])
                    if len(vectors) != len(part):
                        raise ValueError("embedder returned a different number of vectors")
                    status = ["ok" if len(v) else "empty" for v in vectors]
                except Exception:
                    vectors, status = [[] for _ in range(len(part))], ["error"] * len(part)
                part["vector"], part["embed_status"] = [np.asarray(v, dtype="float32") for v in vectors], status
                yield part

    return df.mapInPandas(run, schema)


def embed_cached(
    df: DataFrame, cache: DataFrame, model: str, make: Callable[[], EmbedFn], text: str = "text", batch: int = fixed.EMBED_BATCH
) -> tuple[DataFrame, DataFrame]:
    """(rows with vectors, new cache rows): every distinct text is embedded once per model.

    cache: (model, text_hash, vector). Copies of one text share its hash, so a
    corpus full of copies costs one embedding each, and failed texts are not cached.
    """
    keyed = df.withColumn("text_hash", F.sha2(F.col(text), 256))
    known = cache.filter(F.col("model") == model).select("text_hash", "vector")
    missing = keyed.groupBy("text_hash").agg(F.any_value(text).alias(text)).join(known, "text_hash", "left_anti")
    # Written once: the new vectors go to the cache and to the result.
    fresh = cut_lineage(embed_texts(missing, make, text, batch).filter("embed_status = 'ok'").select("text_hash", "vector"))
    rows = keyed.join(known.unionByName(fresh), "text_hash", "left").drop("text_hash")
    return rows, fresh.select(F.lit(model).alias("model"), "text_hash", "vector")


def normalise(vector: Column) -> Column:
    """Unit-length vector; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    # Inlined into the lambda, the norm would be computed anew for every element.
    return bound(norm, lambda n: F.transform(vector, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double"))))


def inner_product(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def valid_vectors(df: DataFrame, vector: str = "vector") -> DataFrame:
    """Drop rows with a null or empty vector."""
    return df.filter(F.coalesce(F.size(F.col(vector)), F.lit(-1)) > 0)


def vector_sizes(df: DataFrame, vector: str = "vector", position: str = "vec_id") -> DataFrame:
    """Row count and first position per vector size."""
    return (
        valid_vectors(df, vector)
        .groupBy(F.size(vector).cast("long").alias("vector_size"))
        .agg(F.count(F.lit(1)).alias("vectors"), F.min(position).alias("first_position"))
    )


def majority_size(df: DataFrame, vector: str = "vector", position: str = "vec_id") -> DataFrame:
    """Keep the rows of the most frequent vector size; ties go to the size seen first."""
    best = vector_sizes(df, vector, position).agg(
        F.max_by("vector_size", F.struct("vectors", -F.col("first_position"))).alias("__size")
    )
    # One row by construction, so the broadcast is bounded.
    return df.join(F.broadcast(best), F.size(vector) == F.col("__size"), "left_semi")


def batch_numbers(df: DataFrame, id_col: str, batch: int = fixed.EMBED_BATCH) -> DataFrame:
    """Batch number of each row in id order."""
    rows = number_rows_by_id(df, [], id_col, "__n")
    return rows.withColumn("batch_no", F.floor(F.col("__n") / batch)).drop("__n")


def embedding_stats(df: DataFrame, keys: list[str], vector: str = "vector", status: str = "embed_status") -> DataFrame:
    """Row counts of an embedding run: all, valid, empty and failed."""
    filled = F.coalesce(F.size(F.col(vector)), F.lit(0)) > 0
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(filled).alias("valid"),
        F.count_if(~filled).alias("empty"),
        F.count_if(F.col(status) == "error").alias("failed"),
    )
