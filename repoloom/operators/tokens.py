"""Exact token counts by byte-pair merging.

A vocabulary gives every byte string it knows a rank. A text is cut into words by the vocabulary's pattern; inside a word the pair of
neighbours with the lowest rank is merged again and again until no pair is known. What remains is the encoding, and the rank of a piece is its id.

Words repeat, so each task remembers the counts of words it has met, up to a bound. Text never leaves its
row: counting needs no shuffle, and the vocabulary (a bounded number of entries) is broadcast once.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# Fixed value: the published word pattern of byte-level vocabularies with 50,257 ids.
WORD_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_ENTRIES = 1_000_000
REMEMBERED = 100_000  # words a task keeps
LONGEST_REMEMBERED = 64  # bytes; longer words seldom come again


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with a base64 piece and its rank per line, in any file system Spark reads."""
    rows = spark.read.text(path).filter("trim(value) <> ''").limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"{path} has more than {MAX_ENTRIES} entries")
    pairs = (r.value.split() for r in rows)
    return {base64.b64decode(piece): int(rank) for piece, rank in pairs}


def byte_ranks(merges: list[str]) -> dict[bytes, int]:
    """Ranks of all single bytes and of ``merges`` behind them, in the given order."""
    pieces = [bytes([b]) for b in range(256)] + [m.encode() for m in merges]
    return {p: i for i, p in enumerate(pieces)}


def merge(word: bytes, ranks: Mapping[bytes, int]) -> list[bytes]:
    """Pieces of one word.

    Symbols are linked to their neighbours and known pairs wait in a queue by rank and place, so a word of n bytes takes n log n steps however long it is.
    Pairs that a merge has changed stay in the queue and are skipped by their ends.
    """
    if word in ranks or len(word) < 2:
        return [word] if word else []
    end = list(range(1, len(word) + 1))  # symbol at i is word[i:end[i]]; 0: merged into its left neighbour
    before = list(range(-1, len(word) - 1))
    queue: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if end[i] < len(word):
            last = end[end[i]]
            rank = ranks.get(word[i:last])
            if rank is not None:
                heapq.heappush(queue, (rank, i, last))

    for i in range(len(word) - 1):
        offer(i)
    while queue:
        _, i, last = heapq.heappop(queue)
        if not end[i] or end[i] >= len(word) or end[end[i]] != last:
            continue
        gone = end[i]
        end[i], end[gone] = last, 0
        if last < len(word):
            before[last] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < len(word):
        out.append(word[i : end[i]])
        i = end[i]
    return out


class BytePairs:
    """A vocabulary as used inside a task; ``ranks`` must hold every single byte that occurs."""

    def __init__(self, ranks: Mapping[bytes, int], pattern: str = WORD_PATTERN) -> None:
        import regex

        self.ranks, self.words = ranks, regex.compile(pattern)
        self.counts: dict[str, int] = {}

    def _pieces(self, text: str) -> Iterator[list[bytes]]:
        for word in self.words.finditer(text):
            yield merge(word.group().encode(), self.ranks)

    def ids(self, text: str) -> list[int]:
        return [self.ranks[p] for pieces in self._pieces(text) for p in pieces]

    def count(self, text: str) -> int:
        total, counts = 0, self.counts
        for match in self.words.finditer(text):
            word = match.group()
            n = counts.get(word)
            if n is None:
                n = len(merge(word.encode(), self.ranks))
                if len(word) <= LONGEST_REMEMBERED:
                    if len(counts) >= REMEMBERED:
                        counts.clear()
                    counts[word] = n
            total += n
        return total


def _column(spark: SparkSession, ranks: Mapping[bytes, int], pattern: str, kind: T.DataType, call: Callable) -> Callable[[Column], Column]:
    """A column function; a worker holds a batch as it comes (bounded by Spark in rows and bytes) and one text of it."""
    if len(ranks) > MAX_ENTRIES:
        raise ValueError(f"more than {MAX_ENTRIES} entries")
    shared = spark.sparkContext.broadcast(dict(ranks))

    out = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = BytePairs(shared.value, pattern)
        for batch in batches:
            yield pa.array((call(own, text.as_py() or "") for text in batch), out)

    return run


def token_counts(spark: SparkSession, ranks: Mapping[bytes, int], pattern: str = WORD_PATTERN) -> Callable[[Column], Column]:
    """Number of tokens of a text (null: 0), as a column function that the size gates take."""
    return _column(spark, ranks, pattern, T.LongType(), BytePairs.count)


def token_ids(spark: SparkSession, ranks: Mapping[bytes, int], pattern: str = WORD_PATTERN) -> Callable[[Column], Column]:
    """Ids of a text, as a column function."""
    return _column(spark, ranks, pattern, T.ArrayType(T.IntegerType()), BytePairs.ids)
