"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a bounded, hash-chosen sample (``sample`` vectors) and broadcast: at most about as many centres as sample vectors. Every vector of
the table goes to the leaf that a descent to the nearest centre reaches. A query walks the tree by a priority queue of nodes ordered by
the distance to their centres and visits leaves in that order. The number of leaves to visit is widened until the recall measured on the sample
against brute force reaches ``target``. Queries meet the vectors of their leaves in blocks of bounded size on both sides, so
a leaf with a third of all vectors is spread over many tasks; distances are exact and in double precision, and each block returns its k
best, as far as they are no farther than the query's k-th neighbour among ``BOUND`` vectors of the sample, which no true neighbour
can exceed. The sample is thinner than the table, so its neighbours are farther away and its recall is the lower one.

Edge cases: vectors that are null, zero, hold null or non-finite components, or are not of the most common length take no part, neither do rows with a
null id. Rows that repeat an id count once with their smallest distance. If there are no more than k candidates, all are
returned. Ties go to the smaller id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoloom.session import cut_lineage

BLOCK = 1024
BOUND = 4000


def usable(vector: Column) -> Column:
    """Neither null nor zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2.0 * points @ centres.T).argmin(1)


def _k_means(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = points[rng.choice(len(points), k, replace=False)]
    for _ in range(rounds):
        own = _nearest(points, centres)
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


class Tree:
    """Centres of nodes, children of inner nodes (as numbers), number of the leaf or -1."""

    def __init__(self, points: np.ndarray, leaf_size: int, branches: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.centres: list[np.ndarray] = [points.mean(0)]
        self.children: list[np.ndarray | None] = [None]
        self.leaf: list[int] = [-1]
        self.leaves = 0
        todo = [(0, points)]
        while todo:
            node, own = todo.pop()
            k = min(branches, max(2, len(own) // max(1, leaf_size)))
            side = None
            if len(own) > leaf_size and (own != own[0]).any():
                centres = _k_means(own, k, rng)
                side = _nearest(own, centres)
            parts = [] if side is None else [c for c in range(k) if (side == c).any()]
            if len(parts) < 2:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            numbers = []
            for c in parts:
                numbers.append(len(self.centres))
                self.centres.append(centres[c])
                self.children.append(None)
                self.leaf.append(-1)
                todo.append((numbers[-1], own[side == c]))
            self.children[node] = np.array(numbers)
        self.centres = np.array(self.centres)

    @classmethod
    def of(cls, parts: tuple) -> Tree:
        """A tree from ``parts`` of another one, which are plain values that a broadcast can carry."""
        tree = cls.__new__(cls)
        tree.centres, tree.children, tree.leaf, tree.leaves = parts
        return tree

    @property
    def parts(self) -> tuple:
        return self.centres, self.children, self.leaf, self.leaves

    def assign(self, points: np.ndarray) -> np.ndarray:
        """Leaf of every point."""
        out = np.zeros(len(points), np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if kids is None:
                out[rows] = self.leaf[node]
                continue
            side = _nearest(points[rows], self.centres[kids])
            for c, kid in enumerate(kids):
                if (side == c).any():
                    todo.append((int(kid), rows[side == c]))
        return out

    def visit(self, query: np.ndarray):
        """Leaves in best-bin-first order."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if kids is None:
                yield self.leaf[node]
                continue
            d = ((self.centres[kids] - query) ** 2).sum(1)
            for x, kid in zip(d.tolist(), kids.tolist()):
                heapq.heappush(queue, (x, kid))

    def visits_for(self, points: np.ndarray, queries: np.ndarray, k: int, target: float) -> int:
        """Leaves to visit so that the recall of ``queries`` (row numbers) among ``points`` reaches ``target``."""
        leaf = self.assign(points)
        places = []
        for q in queries:
            d = ((points - points[q]) ** 2).sum(1)
            d[q] = np.inf
            near = np.argpartition(d, min(k, len(d) - 1))[:k]
            near = near[np.isfinite(d[near])]
            at = {x: i for i, x in enumerate(self.visit(points[q]))}
            places += [at[x] for x in leaf[near]]
        n, places = 1, np.array(places)
        while n < self.leaves and len(places) and (places < n).mean() < target:
            n = min(self.leaves, max(n + 1, int(n * 1.25)))
        return n


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def nearest(vectors: DataFrame, queries: Column, k: int = 10, sample: int = 20_000, leaf_rows: int = 400, target: float = 0.97) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row of ``vectors`` (vec_id, embedding) where ``queries`` holds."""
    spark = vectors.sparkSession
    rows = vectors.withColumn("__q", F.coalesce(queries, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), "__q")
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dimension, total = (sizes[0]["d"], sizes[0]["count"]) if sizes else (0, 0)
    rows = rows.filter(F.size("v") == dimension)
    share = min(1.0, sample / max(1, total))
    chosen = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_003)) < F.lit(share * 1_000_003)).select("vec_id", "v").orderBy("vec_id").toArrow()
    out = "query_id long, rank int, vec_id long, score double"
    if not chosen.num_rows:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).filter("false")
    points = _matrix(chosen["v"])
    some = np.unique(chosen["vec_id"].to_numpy(), return_index=True)[1]
    some = some[:: -(-len(some) // BOUND)]
    anchors = (chosen["vec_id"].to_numpy()[some], points[some])
    tree = Tree(points, max(8, round(leaf_rows * len(points) / max(total, 1))))
    trial = np.random.default_rng(11).choice(len(points), min(300, len(points)), replace=False)
    visits = tree.visits_for(points, trial, k, target)
    shared = spark.sparkContext.broadcast((tree.parts, anchors))

    def index(batches):
        import pyarrow as pa

        own = Tree.of(shared.value[0])
        for batch in batches:
            if batch.num_rows:
                leaf = own.assign(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], ["vec_id", "v", "q", "leaf"])

    indexed = cut_lineage(rows.select("vec_id", "v", F.col("__q").alias("q")).mapInArrow(index, "vec_id long, v array<double>, q boolean, leaf long"))
    # One count per leaf of the tree, which is bounded by the sample.
    counts = {r["leaf"]: r["count"] for r in indexed.groupBy("leaf").count().collect()}
    filled = np.array([counts.get(i, 0) for i in range(tree.leaves)])

    def walk(batches):
        import pyarrow as pa

        parts, (anchor_ids, anchor) = shared.value
        own = Tree.of(parts)
        for batch in batches:
            who, leaves, reach = [], [], []
            for i, (query_id, q) in enumerate(zip(batch.column(0).to_pylist(), _matrix(batch.column(1)))):
                d = np.sqrt(((anchor - q) ** 2).sum(1))
                d[anchor_ids == query_id] = np.inf
                reach.append(float(np.partition(d, k - 1)[k - 1]) if len(d) >= k else np.inf)
                seen = found = 0
                for leaf in own.visit(q):
                    seen += 1
                    found += filled[leaf]
                    if filled[leaf]:
                        who.append(i)
                        leaves.append(leaf)
                    if seen >= visits and found > 2 * k:
                        break
            take = pa.array(who, pa.int64())
            columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(leaves, pa.int64()), pa.array(reach, pa.float64()).take(take)]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "qv", "leaf", "reach"])

    walks = indexed.filter("q").select("vec_id", "v").mapInArrow(walk, "query_id long, qv array<double>, leaf long, reach double")
    walks = cut_lineage(walks)
    asked = {r["leaf"]: r["count"] for r in walks.groupBy("leaf").count().collect()}
    blocks = spark.createDataFrame([(i, -(-n // BLOCK), -(-asked[i] // BLOCK)) for i, n in sorted(counts.items()) if i in asked], "leaf long, vb long, qb long")
    blocks = F.broadcast(blocks)
    from_table = indexed.join(blocks, "leaf").select(
        "leaf", F.pmod(F.xxhash64("vec_id"), "vb").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("qb") - 1)).alias("c"), "vec_id", "v"
    )
    from_queries = walks.join(blocks, "leaf").select(
        "leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("vb") - 1)).alias("b"), F.pmod(F.xxhash64("query_id"), "qb").alias("c"), "query_id", "qv", "reach"
    )

    def search(left, right):
        import pyarrow as pa

        ids, table = left.column("vec_id").to_numpy(), _matrix(left.column("v"))
        q_ids, found = [], []
        for query_id, q, reach in zip(*[right.column(c).to_pylist() for c in ("query_id", "qv", "reach")]):
            if not len(ids):
                break
            d = np.sqrt(((table - np.array(q)) ** 2).sum(1))
            d[ids == query_id] = np.inf
            near = np.flatnonzero(d <= reach)
            some = near[d[near] <= np.partition(d[near], k)[k]] if len(near) > 4 * k else near
            if len(np.unique(ids[some])) <= k:  # repeated ids took places
                some = near
            best = some[np.lexsort((ids[some], d[some]))]
            best = best[np.sort(np.unique(ids[best], return_index=True)[1])]
            for i in best[: k + 1]:
                if np.isfinite(d[i]):
                    q_ids.append(query_id)
                    found.append((int(ids[i]), float(d[i])))
        return pa.table(
            {"query_id": pa.array(q_ids, pa.int64()), "vec_id": pa.array([f[0] for f in found], pa.int64()), "score": pa.array([f[1] for f in found], pa.float64())}
        )

    keys = ["leaf", "b", "c"]
    hits = from_table.groupBy(*keys).cogroup(from_queries.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    best = hits.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(*[x.split()[0] for x in out.split(", ")])
