"""Exact top-k search over stored balls of vectors.

``write_balls`` puts vectors that lie together into blocks and stores with each its centre and radius. For a query q no vector of a block scores more than
q·centre + |q| radius, so ``search`` visits blocks from the highest bound down and leaves out those that cannot reach the k-th best score a
query has already; the hits are those of a full scan. One pass over the blocks serves all queries: they are stored too, and each
task reads them block by block, so neither the driver nor a task ever holds all of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoloom.functions import fixed
from repoloom.operators.search import _HITS, DIGITS, _matrix, _rank
from repoloom.session import cut_lineage, ensure_checkpoint_dir
from repoloom.sources.files import _file_system

MAX_PIVOTS = 2048
BLOCK_ROWS = 256
QUERY_ROWS = 2048
HELD_VALUES = 16_000_000  # numbers of vectors that a task keeps for one round of queries
_SLACK = 10.0**-DIGITS  # scores are rounded


def _nearest(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    norms = (pivots * pivots).sum(1)
    return np.concatenate([np.argmin(norms - 2 * vectors[i : i + 4096] @ pivots.T, axis=1) for i in range(0, len(vectors), 4096)])


def write_balls(corpus: DataFrame, path: str, block_rows: int = BLOCK_ROWS, stored: bool = False) -> None:
    """Store vectors (vec_id long, vector array<float> of one size) in blocks of at most ``block_rows``; null and empty ones are left out.

    Blocks form around a hash sample of the vectors, at most ``MAX_PIVOTS``; vectors around one pivot are split by id if they are many. The vectors
    are read three times and stored before, unless they are ``stored`` already.
    """
    rows = corpus.select(F.col("vec_id").cast("long"), F.col("vector").cast("array<float>").alias("vector")).filter(F.size("vector") > 0)
    rows = rows if stored else cut_lineage(rows)
    count = rows.count()
    wanted = min(MAX_PIVOTS, -(-count // block_rows))
    place = F.pmod(F.xxhash64("vec_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = rows.filter(place < 2 * wanted / max(count, 1)).limit(wanted).toArrow() if count else None
    shared = corpus.sparkSession.sparkContext.broadcast(_matrix(sample["vector"].combine_chunks()) if sample is not None and sample.num_rows else np.zeros((1, 1)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for b in batches:
            near = _nearest(_matrix(b.column(1)), pivots) if pivots.any() and b.num_rows else np.zeros(b.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), b.column(0), b.column(1)], ["pivot", "vec_id", "vector"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, pivot = [], [], None
        for b in batches:
            values = _matrix(b.column(2))
            for p, i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), values):
                if ids and (p != pivot or len(ids) >= block_rows):
                    yield _ball(ids, np.array(vectors))
                    ids, vectors = [], []
                pivot = p
                ids.append(i)
                vectors.append(v)
        if ids:
            yield _ball(ids, np.array(vectors))

    spread = rows.mapInArrow(assign, "pivot int, vec_id long, vector array<float>")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = spread.repartitionByRange(n, "pivot", "vec_id").sortWithinPartitions("pivot", "vec_id")
    placed.mapInArrow(pack, "centre array<double>, radius double, ids array<long>, vectors array<float>").write.mode("overwrite").parquet(path)


def _ball(ids: list[int], vectors: np.ndarray) -> pa.RecordBatch:
    centre = vectors.mean(0)
    radius = float(np.sqrt(((vectors - centre) ** 2).sum(1).max()))
    flat = pa.array([vectors.ravel().astype(np.float32)], pa.list_(pa.float32()))
    return pa.RecordBatch.from_arrays([pa.array([centre.tolist()]), pa.array([radius]), pa.array([ids], pa.list_(pa.int64())), flat], ["centre", "radius", "ids", "vectors"])


class _Best:
    """The k best hits so far of a block of queries."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.scores, self.ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        s = np.hstack([self.scores[rows], scores])
        i = np.hstack([self.ids[rows], np.broadcast_to(ids, scores.shape)])
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.scores[rows], self.ids[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def best_hits(queries: np.ndarray, balls: list[tuple[np.ndarray, float, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and ids of the k best vectors of each query, and how many (query, ball) pairs were compared.

    A ball is (centre, radius, ids, vectors). Missing hits score minus infinity.
    """
    best, compared = _Best(len(queries), k), 0
    centres, radii = np.array([b[0] for b in balls]), np.array([b[1] for b in balls])
    bounds = queries @ centres.T + np.linalg.norm(queries, axis=1)[:, None] * radii + _SLACK
    for b in np.argsort(-bounds.max(0)):
        rows = np.flatnonzero(bounds[:, b] >= best.scores[:, -1])
        if len(rows):
            _, _, ids, vectors = balls[b]
            best.add(rows, np.round(queries[rows] @ vectors.T, DIGITS), ids)
            compared += len(rows)
    return best.scores, best.ids, compared


def _stored_queries(spark: SparkSession, queries: DataFrame) -> str:
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/queries-{uuid.uuid4().hex}"
    rows = queries.select(F.col("query_id").cast("long"), F.col("query_vector").cast("array<double>").alias("query_vector")).filter(F.size("query_vector") > 0)
    rows.write.option("maxRecordsPerFile", QUERY_ROWS).parquet(path)
    return path


def search(
    spark: SparkSession, balls: str, queries: DataFrame, k: int = fixed.TOP_K, compared: Accumulator | None = None, pairs: Accumulator | None = None
) -> DataFrame:
    """The k most similar stored vectors of each query (query_id, query_vector), as ``operators.search.top_k`` finds them.

    ``compared`` and ``pairs`` count (query, block) pairs whose vectors were compared, and all of them; the rest was skipped.
    """
    asked = _stored_queries(spark, queries)

    def questions() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, base = _file_system(asked)
        for info in sorted(system.get_file_info(fs.FileSelector(base)), key=lambda i: i.path):
            if info.base_name.endswith(".parquet"):
                with system.open_input_file(info.path) as f:
                    for t in pq.ParquetFile(f).iter_batches(QUERY_ROWS):
                        yield t.column(0).to_numpy(), _matrix(t.column(1))

    def hits(held: list) -> Iterator[pa.RecordBatch]:
        for numbers, vectors in questions():
            scores, ids, done = best_hits(vectors, held, k)
            if compared is not None:
                compared.add(done)
            if pairs is not None:
                pairs.add(len(numbers) * len(held))
            found = np.isfinite(scores)
            owners = np.broadcast_to(numbers[:, None], scores.shape)
            yield pa.RecordBatch.from_arrays([pa.array(owners[found]), pa.array(ids[found]), pa.array(scores[found])], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for centre, radius, ids, flat in zip(*(b.column(i) for i in range(4))):
                values = flat.values.to_numpy(zero_copy_only=False).astype("float64")
                held.append((np.array(centre.as_py()), radius.as_py(), ids.values.to_numpy(), values.reshape(len(ids), -1)))
                size += len(values)
                if size >= HELD_VALUES:
                    yield from hits(held)
                    held, size = [], 0
        if held:
            yield from hits(held)

    rows = spark.read.parquet(balls).select("centre", "radius", "ids", "vectors")
    return _rank(rows.mapInArrow(run, _HITS), k)
