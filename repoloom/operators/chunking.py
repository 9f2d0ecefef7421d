"""Splitting long texts."""

from __future__ import annotations

import itertools
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoloom.functions import fixed

OUTPUT_CHARS = 1_000_000  # chunks that a worker gathers before it hands them on
OUTPUT_ROWS = 10_000
SLICE_BYTES = 500  # of a text in one row to a worker


def word_chunks(
    df: DataFrame,
    text: str = "text",
    size: int = fixed.CHUNK_WORDS,
    overlap: int = fixed.CHUNK_OVERLAP,
) -> DataFrame:
    """Overlapping windows of space-separated words, one row per chunk; the last one is the remainder.

    Works row by row inside one projection, so it adds no shuffle.
    """
    step = size - overlap
    words = F.split(F.col(text), " ")
    more = F.greatest(F.ceil((F.size("__w") - F.lit(size)) / F.lit(step)), F.lit(0)).cast("int")
    starts = F.sequence(F.lit(0), more)
    chunks = F.transform(
        starts, lambda i: F.array_join(F.slice(F.col("__w"), i * step + 1, F.lit(size)), " ")
    )
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, words.alias("__w")).select(
        *rest, F.posexplode(chunks).alias("chunk_no", text)
    )


def _merge(pieces: Iterable[str], size: int, overlap: int) -> Iterator[str]:
    """Greedy packing of consecutive pieces, carrying a tail of at most ``overlap`` characters over."""
    held: deque[str] = deque()
    total = 0
    for piece in pieces:
        if held and total + len(piece) > size:
            yield "".join(held)
            while held and (total > overlap or total + len(piece) > size):
                total -= len(held.popleft())
        held.append(piece)
        total += len(piece)
    if held:
        yield "".join(held)


def _pieces(text: str, sep: str) -> Iterator[str]:
    """Pieces of a text one after the other, each but the first with the separator before it."""
    start, at = 0, text.find(sep)
    while at >= 0:
        if at > start:
            yield text[start:at]
        start, at = at, text.find(sep, at + len(sep))
    if start < len(text):
        yield text[start:]


def _chunks(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> Iterator[str]:
    sep = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(sep) + 1 :]
    for is_short, run in itertools.groupby(_pieces(text, sep) if sep else text, lambda p: len(p) < size):
        if is_short:
            yield from _merge(run, size, overlap)
        else:
            for piece in run:
                yield from _chunks(piece, size, overlap, finer) if finer else [piece]


def each_chunk(
    text: str,
    size: int = fixed.SPLIT_CHARS,
    overlap: int = fixed.SPLIT_OVERLAP,
    separators: tuple[str, ...] = ("\n\n", "\n", " ", ""),
) -> Iterator[str]:
    """Split at the coarsest separator present, and finer ones inside pieces that stay too long; holds one chunk at a time."""
    return (s for s in (c.strip() for c in _chunks(text, size, overlap, separators)) if s)


def split_characters(
    text: str,
    size: int = fixed.SPLIT_CHARS,
    overlap: int = fixed.SPLIT_OVERLAP,
    separators: tuple[str, ...] = ("\n\n", "\n", " ", ""),
) -> list[str]:
    """All chunks of ``each_chunk``."""
    return list(each_chunk(text, size, overlap, separators))


def character_chunks(
    df: DataFrame, text: str = "text", size: int = fixed.SPLIT_CHARS, overlap: int = fixed.SPLIT_OVERLAP
) -> DataFrame:
    """Character windows cut at paragraph, line or word borders; each row is split on its own.

    Texts go to the workers in slices of at most SLICE_BYTES, one row each and in order, so that a batch of Arrow's row limit
    stays small however long the texts are. A worker holds such a batch, one text and a bounded number of chunks.
    """
    rest = [c for c in df.columns if c != text]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = bytearray()
        for batch in batches:
            slices, lasts = batch.column(len(rest)), batch.column(len(rest) + 1)

            def rows(at: list[int], numbers: list[int], chunks: list[str]) -> pa.RecordBatch:
                own = [batch.column(i).take(pa.array(at, pa.int32())) for i in range(len(rest))]
                return pa.RecordBatch.from_arrays([*own, pa.array(numbers, pa.int32()), pa.array(chunks, pa.string())], [*rest, "chunk_no", text])

            at, numbers, chunks, held = [], [], [], 0
            for i in range(batch.num_rows):
                data += slices[i].as_py() or b""
                if not lasts[i].as_py():
                    continue
                whole, data = data.decode(), bytearray()
                for n, chunk in enumerate(each_chunk(whole, size, overlap)):
                    at.append(i)
                    numbers.append(n)
                    chunks.append(chunk)
                    held += len(chunk)
                    if held >= OUTPUT_CHARS or len(at) >= OUTPUT_ROWS:
                        yield rows(at, numbers, chunks)
                        at, numbers, chunks, held = [], [], [], 0
            if at:
                yield rows(at, numbers, chunks)

    out = T.StructType([*(df.schema[c] for c in rest), T.StructField("chunk_no", T.IntegerType()), T.StructField(text, T.StringType())])
    return _sliced(df, rest, text).mapInArrow(split, out)


def _sliced(df: DataFrame, rest: list[str], text: str) -> DataFrame:
    """One row per slice of a text's bytes, in order; the last one of a text has the other columns."""
    count = F.greatest(F.ceil(F.octet_length(text) / SLICE_BYTES), F.lit(1)).cast("int")
    # The bytes as an element of an array: taken from the text once, not once per slice.
    slices = F.transform(
        F.array(F.col(text).cast("binary")),
        lambda b: F.transform(F.sequence(F.lit(0), F.col("__n") - 1), lambda i: F.substring(b, i * SLICE_BYTES + 1, F.lit(SLICE_BYTES))),
    )
    cut = df.select(*rest, text, count.alias("__n")).select(*rest, "__n", F.posexplode(F.flatten(slices)).alias("__i", "__slice"))
    last = F.col("__i") == F.col("__n") - 1
    return cut.select(*(F.when(last, F.col(c)).alias(c) for c in rest), "__slice", last.alias("__last"))


def token_counter(encode: Callable[[str], list]) -> Callable[[Column], Column]:
    """Exact token count with a given encoder, as a column function usable in the size gates."""

    @F.arrow_udf(T.LongType())
    def count(col: pa.Array) -> pa.Array:
        return pa.array((len(encode(t.as_py() or "")) for t in col), pa.int64())

    return count
