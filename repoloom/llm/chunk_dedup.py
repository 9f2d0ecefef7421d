"""Removal of repeated passages by content-defined chunks.

A gear hash rolls over the UTF-8 bytes of each text: shifting by one bit per byte, it depends on the last 32 bytes only, so it is
computed for all positions by five doubling steps. A chunk may end after white space where the hash has ``mask_bits`` zero bits,
not before ``least`` and at ``most`` bytes at the latest. Where no such place comes within ``WIDE`` bytes, as in scripts without
spaces or minified code, it may end before any character where the hash has ``LOOSE_BITS`` zero bits more. An insertion changes the chunks around it, the next ones fall
into step again. Chunks with the same 128-bit digest are copies; the one in the smallest doc_id (the first in it) stays. Neighbouring
copies form runs, and runs of at least ``least_run`` bytes are cut out of the text.

Only (digest, doc_id, place) rows are shuffled: one aggregation finds the first document of repeated digests, with
partial aggregation for frequent ones, and one sort-merge join, whose hot digests Spark splits, brings them back. Runs
are put together per document, and text is read again by one join on doc_id.

Edge cases: null and empty texts stay as they are, and so do rows with a null doc_id, which take no part. Rows that repeat a doc_id are one
document and don't remove each other's text. A text that is a copy as a whole becomes empty. Other columns are
carried along in ``dedup_chunks``, whatever their names (names that begin with ``__cd_`` are reserved).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoloom.llm.words import mix, slices
from repoloom.session import cut_lineage

GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
GEAR[0] = 0  # texts are hashed side by side with 32 zero bytes between them, as if each began anew
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
WIDE, LOOSE_BITS = 256, 2
SIZE_BITS = 12  # of a place: start, then size


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Rolling hash after every byte: the sum of GEAR[byte] << distance over the last 32 bytes, modulo 2^32."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step] << np.uint32(step)
    return h


def cut_points(ends: list[int], data: bytes, least: int, most: int) -> list[int]:
    """Chunk ends of a text from the positions where the content allows one."""
    out, last, n = [], 0, len(data)

    def long_ones(to: int) -> None:
        nonlocal last
        while to - last > most:
            cut = last + most
            while cut > last + least and data[cut] & 0xC0 == 0x80:  # not inside a character
                cut -= 1
            out.append(cut)
            last = cut

    for e in ends:
        if e - last >= least:
            if e - last > most:
                long_ones(e)
                if e - last < least:
                    continue
            out.append(e)
            last = e
    long_ones(n)
    if last < n:
        out.append(n)
    return out


def chunk_ends(texts: list[bytes], mask_bits: int, least: int, most: int) -> list[list[int]]:
    """Chunk ends of every text."""
    gap = b"\0" * 32
    data = np.frombuffer(gap.join(texts) + gap, np.uint8)
    # The first bits of a 32-bit gear hash depend on the most bytes.
    h = gear_hashes(data)
    allowed = np.flatnonzero((h >> np.uint32(32 - mask_bits) == 0) & SPACES[data]) + 1
    starts = np.concatenate(([0], np.cumsum([len(t) + 32 for t in texts])))
    # Whether a stretch is wide depends on its content only, not on the cuts before it.
    anchors = np.unique(np.concatenate((allowed, starts, starts[1:] - 32)))
    if (np.diff(anchors) > WIDE).any():
        loose = np.flatnonzero((h[:-1] >> np.uint32(32 - mask_bits - LOOSE_BITS) == 0) & (data[1:] & 0xC0 != 0x80)) + 1
        after = np.searchsorted(anchors, loose, side="right")
        allowed = np.union1d(allowed, loose[anchors[after] - anchors[after - 1] > WIDE])
    # Places behind the end of a text, between two texts, are none of its own.
    lo, hi = np.searchsorted(allowed, starts[:-1], side="right"), np.searchsorted(allowed, starts[1:] - 32, side="right")
    return [cut_points((allowed[lo[i] : hi[i]] - starts[i]).tolist(), t, least, most) if t else [] for i, t in enumerate(texts)]


def chunks(docs: DataFrame, mask_bits: int = 2, least: int = 24, most: int = 1024) -> DataFrame:
    """doc_id, place (start and size in bytes), again (copied from the same text) and the digest d1, d2 of every chunk."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            ids, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for lo, hi in slices(column):
                texts = [t.encode("utf-8", "surrogatepass") for t in column[lo:hi]]
                counts, places, again, digests = [], [], [], []
                for t, ends in zip(texts, chunk_ends(texts, mask_bits, least, most)):
                    found = [digest(t[a:b]) for a, b in zip([0, *ends], ends)]
                    seen = set()
                    again += [d in seen or seen.add(d) is not None for d in found] if len(set(found)) < len(found) else [False] * len(found)
                    e = np.array(ends, np.int64)
                    s = np.concatenate((np.zeros(1, np.int64), e[:-1])) if len(e) else e
                    places.append((s << SIZE_BITS) | (e - s))
                    counts.append(len(found))
                    digests += found
                if digests:
                    d = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(ids[lo:hi], counts)), pa.array(np.concatenate(places)), pa.array(again, pa.bool_()), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())],
                        ["doc_id", "place", "again", "d1", "d2"],
                    )

    rows = docs.select(F.col("doc_id").cast(T.LongType()), F.col("text").cast(T.StringType())).filter("doc_id is not null and length(text) > 0")
    return rows.mapInArrow(run, "doc_id long, place long, again boolean, d1 long, d2 long")


def repeated_chunks(parts: DataFrame) -> DataFrame:
    """doc_id, place, d1 and first (the document that keeps it) of chunks that are copies of an earlier one."""
    first = parts.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # Stored apart from its aggregation, so that the join deals out both sides and Spark can split a hot digest.
    first = cut_lineage(first)
    return parts.join(first, ["d1", "d2"]).filter((F.col("doc_id") > F.col("first")) | F.col("again")).select("doc_id", "place", "d1", "first")


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def dedup_chunks(docs: DataFrame, mask_bits: int = 2, least: int = 24, most: int = 1024, least_run: int = 100) -> DataFrame:
    """``docs`` with the text left after removal, and removed_chars, n_removed (runs) and kept_in (documents that hold the kept copies).

    A result whose name ``docs`` has already is called by that name and as many underscores as it takes.
    """
    if not 0 < least < most < 1 << SIZE_BITS:
        raise ValueError("chunk sizes")
    repeated = repeated_chunks(chunks(docs, mask_bits, least, most))
    lists = repeated.groupBy(F.col("doc_id").alias("__cd_id")).agg(F.collect_list(F.struct("place", "d1", "first")).alias("__cd_list"))
    joined = docs.join(lists, docs["doc_id"].cast("long") == lists["__cd_id"], "left").drop("__cd_id")
    names = docs.columns
    text_at = names.index("text")
    added = [T.StructField(_free(n, names), t) for n, t in (("removed_chars", T.LongType()), ("n_removed", T.LongType()), ("kept_in", T.ArrayType(T.LongType())))]
    schema = T.StructType([*[T.StructField(f.name, T.StringType() if f.name == "text" else f.dataType) for f in docs.schema.fields], *added])

    def cut(text: str, listed: list[dict]) -> tuple[str, int, int, list[int]]:
        import xxhash

        data = text.encode("utf-8", "surrogatepass")
        runs: list[list] = []  # start, end, first documents
        for x in sorted(listed, key=lambda x: x["place"]):
            start, size = x["place"] >> SIZE_BITS, x["place"] & ((1 << SIZE_BITS) - 1)
            if int.from_bytes(xxhash.xxh3_128_digest(data[start : start + size])[:8], "big", signed=True) != x["d1"]:
                continue  # of another row with this doc_id
            if runs and runs[-1][1] == start:
                runs[-1][1] = start + size
                runs[-1][2].add(x["first"])
            elif not runs or runs[-1][1] < start:
                runs.append([start, start + size, {x["first"]}])
        runs = [r for r in runs if r[1] - r[0] >= least_run]
        kept, at, holders = [], 0, set()
        for start, end, firsts in runs:
            kept.append(data[at:start])
            at = end
            holders |= firsts
        left = b"".join([*kept, data[at:]]).decode("utf-8", "surrogatepass")
        return left, len(text) - len(left), len(runs), sorted(holders)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts, lists = batch.column(text_at).to_pylist(), batch.column(len(names)).to_pylist()
            rows = [cut(t, x) if t and x else (t, 0, 0, []) for t, x in zip(texts, lists)]
            columns = batch.columns[:-1]
            columns[text_at] = pa.array([r[0] for r in rows], pa.string())
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds, 1)]], schema.names)

    return joined.mapInArrow(run, schema)
