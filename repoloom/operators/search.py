"""Exact top-k similarity search and question contexts.

Scores are inner products rounded to ``DIGITS`` places before ranking and ties go
to the smaller id, so results do not depend on the partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoloom.functions import fixed
from repoloom.session import cut_lineage

DIGITS = 6
_SCORES = 4_000_000  # scores held at once


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Top k rows of each column by (score desc, id asc); inputs are (rows, queries)."""
    order = np.lexsort((ids, -scores), axis=0)[:k]
    return np.take_along_axis(scores, order, 0), np.take_along_axis(ids, order, 0)


class _TopK:
    """Running top k of many queries over batches of corpus vectors."""

    def __init__(self, qids: np.ndarray, qvecs: np.ndarray, k: int):
        self.qids, self.qvecs, self.k = qids, qvecs, k
        self.scores = np.zeros((0, len(qids)))
        self.ids = np.zeros((0, len(qids)), dtype="int64")

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        if not len(ids):
            return
        new_s, new_i = [], []
        step = max(1, min(4096, _SCORES // len(ids)))
        for b in range(0, len(self.qids), step):
            cols = slice(b, b + step)
            s = np.round(vectors @ self.qvecs[cols].T, DIGITS)
            old_s, old_i = self.scores[:, cols], self.ids[:, cols]
            rows = ids
            if len(old_s) == self.k:
                useful = (s >= old_s[-1]).any(axis=1)
                s, rows = s[useful], ids[useful]
            pool_s = np.vstack([old_s, s])
            pool_i = np.vstack([old_i, np.broadcast_to(rows[:, None], s.shape)])
            if len(pool_s) > 4 * self.k:
                # Only rows that reach some query's k-th best score are sorted.
                edge = np.partition(pool_s, len(pool_s) - self.k, axis=0)[len(pool_s) - self.k]
                useful = (pool_s >= edge).any(axis=1)
                pool_s, pool_i = pool_s[useful], pool_i[useful]
            bs, bi = _best(pool_s, pool_i, self.k)
            new_s.append(bs)
            new_i.append(bi)
        # Blocks can keep different pools but always the same number of rows.
        self.scores, self.ids = np.hstack(new_s), np.hstack(new_i)

    def frame(self) -> pd.DataFrame:
        n = len(self.scores)
        return pd.DataFrame(
            {
                "query_id": np.repeat(self.qids, n),
                "vec_id": self.ids.T.ravel(),
                "score": self.scores.T.ravel(),
            }
        )


_HITS = "query_id long, vec_id long, score double"


def _rank(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_k(corpus: DataFrame, queries: DataFrame, k: int = fixed.TOP_K, max_broadcast_values: int = 8_000_000) -> DataFrame:
    """The k most similar corpus vectors of each query.

    corpus: ``vec_id long, vector array<float>``; queries: ``query_id long,
    query_vector array<float|double>``; all vectors of one size. Fewer than k
    corpus rows give fewer hits. Null and empty vectors of either side take no part.

    Queries travel to every task in blocks of at most about ``max_broadcast_values`` numbers (their vectors and the k hits kept for
    each), measured before; the corpus is scanned once per block and never shuffled. Each task leaves its k best per query.
    """
    corpus = corpus.select(F.col("vec_id").cast("long"), F.col("vector").cast("array<float>").alias("vector")).filter(F.size("vector") > 0)
    queries = queries.select(
        F.col("query_id").cast("long"), F.col("query_vector").cast("array<double>").alias("query_vector")
    ).filter(F.size("query_vector") > 0)
    queries = cut_lineage(queries)  # measured and read again; it may be an embedding run
    values = queries.agg(F.sum(F.size("query_vector") + 2 * k).alias("n")).first()["n"] or 0
    blocks = max(1, -(-values // max(1, max_broadcast_values)))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    scans = [_scan(corpus, queries.filter(block == i) if blocks > 1 else queries, k) for i in range(blocks)]
    return _rank(reduce(DataFrame.unionByName, scans), k)


def _scan(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    table = queries.orderBy("query_id").toArrow()
    qids = table["query_id"].to_numpy()
    shared = corpus.sparkSession.sparkContext.broadcast((qids, _matrix(table["query_vector"].combine_chunks())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vecs = shared.value
        state = _TopK(ids, vecs, k)
        for b in batches:
            if len(ids):
                state.add(b.column("vec_id").to_numpy(), _matrix(b.column("vector")))
        yield pa.RecordBatch.from_pandas(state.frame(), preserve_index=False)

    return corpus.mapInArrow(run, _HITS)


def hit_texts(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Join hits back to their chunks by vec_id."""
    return chunks.join(hits, "vec_id")


def hits_by_file(hits: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Texts per query and file, in rank order; a query has at most k hits, so groups are bounded."""
    keys = ["query_id", *(extra or [])]
    return hits.groupBy(*keys, "file_path").agg(
        F.min("rank").alias("first_rank"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("texts"),
    )


def context_blocks(hits: DataFrame) -> DataFrame:
    """One context text per query: file headers with their texts, files by best rank."""
    per_file = hits_by_file(hits)
    block = F.concat(F.lit("## File Path: "), F.col("file_path"), F.lit("\n\n"), F.array_join("texts", "\n\n"))
    ordered = F.array_sort(F.collect_list(F.struct("first_rank", block.alias("block"))))
    joined = F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n")
    return per_file.groupBy("query_id").agg(
        F.concat(F.lit("\n\n" + "-" * 10), joined).alias("context_text")
    )


def similarity(a: Column, b: Column) -> Column:
    """Rounded inner product of two vectors in one row."""
    from repoloom.operators.embedding import inner_product

    return F.round(inner_product(a, b), DIGITS)
