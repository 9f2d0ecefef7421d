"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full shingle sets and union-find.

A document's set holds the distinct hashes of its word windows. SuperMinHash gives each element a random permutation of the slots and
puts step + random number into the slot of each step; a slot keeps its minimum. All elements of a document take a step together, and as soon as every slot has a
value below the next step the document is finished: long documents after one step, short ones after some.

1. Documents with equal sets (128-bit digest and size) are one class; its smallest id goes on.
2. Bands of slots are hashed; classes that share a band key are candidates. No pairs are emitted inside a bucket: each member is
   paired with the bucket's centre, of which eight hash orders of the keys give different ones.
3. Candidates are verified on the full sets, and verified links give components.
4. The exact rest: buckets whose members are still in several components are compared in cells of bounded size (two blocks of
   members with their texts); pairs of different components whose signatures may still mean a link (6.5 standard deviations below the
   threshold) are verified inside the cell, each in the first band it shares, and only links that join components come out.
   So two documents of different components that share a bucket have been compared, whatever the size of the bucket, and no pairs are shuffled.

A pair at the threshold shares no bucket with a probability of about 6e-11 (0.85) or 5e-8 (0.8) with 32 bands of 4 slots.

Edge cases: a document with fewer words than a window has one shingle of all its words; without words or text it has none and is linked with nothing. Rows
with a null doc_id are linked with nothing and kept. Rows that repeat a doc_id are one document; all are kept or none. Other columns are ignored
by ``near_duplicates`` and carried along by ``keep_first``, whatever their names (``__nd_`` is reserved).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoloom.llm.components import connected_components
from repoloom.llm.words import distinct, mix, slices, window_hashes, words_of
from repoloom.session import cut_lineage

_U = np.uint64
SLOTS, ROWS = 128, 4
BLOCK = 300_000  # shingles of a block


def shingle_sets(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of the distinct shingles of every text, sorted."""
    owner, words = words_of([t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts])
    return distinct(*window_hashes(owner, words, k, len(texts)))


def super_min_hash(owner: np.ndarray, h: np.ndarray, n_owners: int, m: int = SLOTS) -> np.ndarray:
    """Slots (owners x m): step in the high, random number in the low 32 bits; all ones where there is no element."""
    low, full = _U(0xFFFFFFFF), np.full(n_owners * m, ~_U(0), _U)
    state = mix(h ^ _U(0x51ED270B27B4F3CF))
    base = owner * m
    first = ((state & low) * _U(m) >> _U(32)).astype(np.int64)
    np.minimum.at(full, base + first, state >> _U(32))
    slots = full.reshape(n_owners, m)
    open_ = slots.max(1) >> _U(32) > 0 if n_owners else np.empty(0, bool)
    pick = open_[owner]
    if not pick.any():
        return slots
    owner, base, state, first = owner[pick], base[pick], state[pick], first[pick]
    order = np.tile(np.arange(m, dtype=np.uint8), (len(owner), 1))
    row = np.arange(len(owner))
    order[row, first] = 0  # swapped with place 0, which is not drawn again
    for step in range(1, m):
        with np.errstate(over="ignore"):
            state = mix(state + _U(0x9E3779B97F4A7C15))
        drawn = step + ((state & low) * _U(m - step) >> _U(32)).astype(np.int64)
        slot = order[row, drawn]
        order[row, drawn] = order[row, step]
        np.minimum.at(full, base + slot, (_U(step) << _U(32)) | (state >> _U(32)))
        some = np.unique(owner)
        finished = some[slots[some].max(1) >> _U(32) <= _U(step)]
        if len(finished):
            pick = ~np.isin(owner, finished)
            if not pick.any():
                break
            owner, base, state, order = owner[pick], base[pick], state[pick], order[pick]
            row = np.arange(len(owner))
    return slots


def band_keys(slots: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, m = slots.shape
    factors = mix(np.arange(1, m + 1, dtype=_U)) | _U(1)
    with np.errstate(over="ignore"):
        sums = (mix(slots) * factors).reshape(n, m // rows, rows).sum(2, dtype=_U)
    return mix(sums).view(np.int64)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (shingles), digest d1, d2 of the set, bands and one byte of every slot."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, column = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in slices(column):
                owner, h = shingle_sets(column[lo:hi], k)
                count = hi - lo
                n = np.bincount(owner, minlength=count)
                digests = []
                for salt in (0x8CB92BA72F3D8DD7, 0xD1B54A32D192ED03):
                    total = np.zeros(count, _U)
                    some = np.flatnonzero(n)
                    if len(some):
                        with np.errstate(over="ignore"):
                            total[some] = np.add.reduceat(mix(h ^ _U(salt)), (np.cumsum(n) - n)[some], dtype=_U)
                    digests.append(total.view(np.int64))
                slots = super_min_hash(owner, h, count)
                keys = band_keys(slots)
                width = keys.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (count + 1) * width, width), pa.int32()), pa.array(keys.ravel()))
                marks = (mix(slots) >> _U(56)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, count), pa.array(n.astype(np.int64)), *map(pa.array, digests), lists, pa.array([x.tobytes() for x in marks], pa.binary())],
                    ["doc_id", "n", "d1", "d2", "bands", "marks"],
                )

    rows = docs.select(F.col("doc_id").cast(T.LongType()), F.col("text").cast(T.StringType()))
    return rows.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, bands array<long>, marks binary")


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs ``a``, ``b`` whose sets have 100 x intersection >= percent x union."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            one, two = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = np.zeros(batch.num_rows, bool)
            for lo, hi in slices(one, 500_000):
                oa, ha = shingle_sets(one[lo:hi], k)
                ob, hb = shingle_sets(two[lo:hi], k)
                owner, h = np.concatenate((oa, ob)), np.concatenate((ha, hb))
                order = np.lexsort((h, owner))
                owner, h = owner[order], h[order]
                same = (owner[1:] == owner[:-1]) & (h[1:] == h[:-1])
                both = np.bincount(owner[1:][same], minlength=hi - lo)
                union = np.bincount(owner, minlength=hi - lo) - both
                ok[lo:hi] = (100 * both >= percent * union) & (union > 0)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in batch.columns[:2]], ["a", "b"])

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _star_pairs(buckets: DataFrame) -> DataFrame:
    """Each member of a bucket with the bucket's centre."""
    order = F.xxhash64("id", F.pmod("key", F.lit(8)))
    centre = buckets.groupBy("key").agg(F.min_by("id", order).alias("centre"))
    return buckets.join(centre, "key").filter("id <> centre").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()


class Cell:
    """Documents of one bucket, or of two blocks of a large one, with their full sets."""

    def __init__(self, band: int, comps: np.ndarray, sizes: np.ndarray, bands: np.ndarray, marks: np.ndarray, texts: list[str], k: int):
        self.band, self.sizes, self.bands, self.marks = band, sizes, bands, marks
        self.comp = np.unique(comps, return_inverse=True)[1]
        owners, hashes = [], []
        for lo, hi in slices(texts):
            owner, h = shingle_sets(texts[lo:hi], k)
            owners.append(owner + lo)
            hashes.append(h)
        owner = np.concatenate(owners)
        self.code = np.unique(np.concatenate(hashes), return_inverse=True)[1]
        self.ends = np.cumsum(np.bincount(owner, minlength=len(texts)))
        self.starts = self.ends - self.sizes

    def links(self, of, percent: int, least_equal: int):
        """Pairs of positions that link components; ``of(x)`` gives the positions to compare x with."""
        flag = np.zeros(int(self.code.max()) + 1, bool)
        for x in range(len(self.sizes)):
            y = of(x)
            y = y[self.comp[y] != self.comp[x]]
            if not len(y):
                continue
            small, large = np.minimum(self.sizes[y], self.sizes[x]), np.maximum(self.sizes[y], self.sizes[x])
            y = y[100 * small >= percent * large]
            # A pair is compared in the first band it shares.
            y = y[~(self.bands[y, : self.band] == self.bands[x, : self.band]).any(1)]
            y = y[(self.marks[y] == self.marks[x]).sum(1) >= least_equal]
            if not len(y):
                continue
            own = self.code[self.starts[x] : self.ends[x]]
            flag[own] = True
            if len(y) < 32:
                both = np.array([np.count_nonzero(flag[self.code[self.starts[z] : self.ends[z]]]) for z in y])
            else:
                both = np.add.reduceat(flag[self.code].astype(np.int64), self.starts)[y]
            flag[own] = False
            for z in y[100 * both >= percent * (self.sizes[y] + self.sizes[x] - both)]:
                if self.comp[z] != self.comp[x]:
                    yield x, int(z)
                    self.comp[self.comp == self.comp[z]] = self.comp[x]


def _cell_links(buckets: DataFrame, labels: DataFrame, heads: DataFrame, texts: DataFrame, k: int, percent: int, least_equal: int) -> DataFrame:
    """Links ``a``, ``b`` that join different components of one bucket, verified on the full sets."""
    labelled = buckets.join(labels, buckets["id"] == labels["node"], "left").select("key", "band", "id", "n", F.coalesce("comp", "id").alias("comp"))
    mixed = labelled.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("size > 2 and lo <> hi")
    blocks = F.ceil(F.col("total") / BLOCK).alias("blocks")
    rows = labelled.join(mixed.select("key", blocks), "key").withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "band", "own", "id", "comp", "n")
    rows = rows.join(heads.select(F.col("doc_id").alias("id"), "bands", "marks"), "id").join(texts, "id")
    rows = rows.select("key", "i", "j", "band", "own", "id", "comp", "n", "bands", "marks", "text")

    def run(batches):
        import pyarrow as pa

        def groups():
            """Rows of one (key, i, j) after the other; a cell of bounded size waits while batches go by."""
            held = None
            for batch in batches:
                t = pa.Table.from_batches([batch])
                held = t if held is None else pa.concat_tables([held, t])
                keys = np.stack([held.column(c).to_numpy() for c in range(3)])
                change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
                at = 0
                for c in change:
                    yield held.slice(at, c - at)
                    at = int(c)
                held = held.slice(at)
            if held is not None and held.num_rows:
                yield held

        for g in groups():
            comps = g.column("comp").to_numpy()
            if (comps == comps[0]).all():
                continue
            count, ids, own = g.num_rows, g.column("id").to_numpy(), g.column("own").to_numpy()
            i, j = g.column("i")[0].as_py(), g.column("j")[0].as_py()
            bands = np.array(g.column("bands").to_pylist(), np.int64)
            marks = np.frombuffer(b"".join(g.column("marks").to_pylist()), np.uint8).reshape(count, -1)
            cell = Cell(g.column("band")[0].as_py(), comps, g.column("n").to_numpy(), bands, marks, g.column("text").to_pylist(), k)
            right = np.flatnonzero(own == j)
            of = (lambda x, n=count: np.arange(x + 1, n)) if i == j else (lambda x, own=own, i=i, right=right: right if own[x] == i else right[:0])
            found = [(min(ids[x], ids[z]), max(ids[x], ids[z])) for x, z in cell.links(of, percent, least_equal)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept for every row."""
    signed = cut_lineage(signatures(docs, k))
    able = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    # Stored apart from its aggregation, so that the join of the members deals out both sides and Spark can split a hot class.
    classes = cut_lineage(signed.filter(able).groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep")))
    heads = signed.filter(able).join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    keys = heads.select(F.col("doc_id").alias("id"), "n", F.posexplode("bands").alias("band", "key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("key")
    buckets = cut_lineage(keys.join(shared, "key").select("key", "band", "id", "n"))
    ids = buckets.select("id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    texts = cut_lineage(texts.join(ids, "id", "left_semi").dropDuplicates(["id"]))
    links = cut_lineage(verified(_star_pairs(buckets), texts, k, percent))
    labels = connected_components(links)
    share = percent / 100
    deviation = math.sqrt(SLOTS * share * (1 - share))
    least_equal = max(1, math.floor(SLOTS * share - 6.5 * deviation))
    rest = cut_lineage(_cell_links(buckets, labels, heads, texts, k, percent, least_equal))
    if rest.limit(1).count():
        labels = connected_components(links.union(rest))
    members = signed.select("doc_id", "n", "d1", "d2").join(classes, ["d1", "d2", "n"], "left")
    found = members.join(labels, members["rep"] == labels["node"], "left")
    component = F.when(able, F.coalesce("comp", "rep")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id."""
    gone = near_duplicates(docs, k, percent).filter(~F.col("kept")).select(F.col("doc_id").alias("__nd_id")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__nd_id"], "left_anti")
