"""Removal of lines that equal or nearly equal an earlier one: a deletion-neighbourhood join over words.

A line is its sequence of words (ASCII letters in lower case; each character of a script without spaces is a word); the edit distance
counts words inserted, deleted or replaced, and the bound is ``max_edits`` (0 or 1). A line goes if an
earlier line (smaller doc_id, then smaller number) is within the bound; each line is judged against all lines, removed ones too.
Equal lines are found at every length (lines without a word are none); an edit is allowed where the longer of two lines has
``NEAR_WORDS`` words. A ``min_words`` that is given leaves lines of fewer words alone altogether.

1. Equal lines meet by 128-bit digest in one aggregation; each distinct line goes on once, at its earliest place.
2. Two lines one edit apart share their first or their last half word for word. Only lines that share a half with
   another one can have a neighbour (an exact filter, three keys a line), and only they emit variants.
3. Such a line emits itself and all variants with one word deleted, as hashed keys with the place of the deletion. Lines with the same variant and
   place are all one edit apart, so each needs its earliest partner there and no pairs. A variant that is another line links the
   two. Partners are verified on the words.

Frequent lines and variants cost one row per task in the aggregations, and Spark splits hot keys of the joins.

Edge cases: null and empty texts have no lines. Rows with a null doc_id take no part. Rows that repeat a doc_id are one document: they don't remove each
other's lines, and a line number removed is removed from all of them. Other columns are carried along in ``dedup_lines``, whatever their
names (names that begin with ``__ld_`` are reserved).
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoloom.llm.words import _tables, mix, slices, word_hashes
from repoloom.session import cut_lineage

_U = np.uint64
NEAR_WORDS = 8
#: Thai, Lao, Tibetan, Burmese, Khmer, kana, Chinese characters.
UNSPACED = re.compile("([\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")


class Spans:
    """Hashes of runs of words by prefix sums."""

    def __init__(self, words: np.ndarray, salt: int = 0):
        self.up, self.down, _, _ = _tables(len(words) + 2)
        with np.errstate(over="ignore"):
            w = mix(words ^ _U(salt)) if salt else words
            self.total = np.concatenate((np.zeros(1, _U), np.cumsum(w * self.up[: len(w)], dtype=_U)))

    def raw(self, a, b):
        """Sum of word x base^(place in the run)."""
        with np.errstate(over="ignore"):
            return (self.total[b] - self.total[a]) * self.down[a]

    def hash(self, a, b, tag: int = 0):
        with np.errstate(over="ignore"):
            return mix(self.raw(a, b) + (b - a).astype(_U) * _U(0x2545F4914F6CDD1D) + _U(tag))


def _bare(text: str) -> bytes:
    if not text.isascii():
        text = UNSPACED.sub(r" \1 ", text)
    return text.encode("utf-8", "surrogatepass").lower()


def lines(docs: DataFrame, least: int, near: int) -> DataFrame:
    """doc_id, line_no, again (equals an earlier line of the text), digest d1, d2, and keys of the halves h1, h2, h3 of lines of ``near`` words."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for lo, hi in slices(column):
                data = b"\n".join([_bare(t) for t in column[lo:hi]])
                starts, words = word_hashes(data)
                breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
                line = np.searchsorted(breaks, starts)  # of every word
                first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.empty(0, np.int64)
                end = np.concatenate((first[1:], [len(line)])) if len(first) else first
                n = end - first
                keep = n >= least
                first, end, n = first[keep], end[keep], n[keep]
                if not len(first):
                    continue
                number = line[first]
                text_line = np.concatenate(([0], np.cumsum([t.count("\n") + 1 for t in column[lo:hi]])))  # first line of each text
                doc = np.searchsorted(text_line, number, side="right") - 1
                one, two = Spans(words), Spans(words, 0x9FB21C651E98DF25)
                d1, d2 = one.hash(first, end), two.hash(first, end)
                order = np.lexsort((number, d1, doc))
                same = np.zeros(len(order), bool)
                same[1:] = (doc[order][1:] == doc[order][:-1]) & (d1[order][1:] == d1[order][:-1]) & (d2[order][1:] == d2[order][:-1])
                again = np.empty(len(order), bool)
                again[order] = same
                # Halves of the longer line of a pair, of n or n + 1 words: its last N // 2 words and those before.
                half, up = n // 2, (n + 1) // 2
                even = n % 2 == 0
                h1 = one.hash(end - half, end, 1)
                h2 = one.hash(first, first + (n - half), 2)
                h3 = np.where(even, one.hash(first, first + half + 1, 2), one.hash(end - up, end, 1))
                columns = [ids[lo:hi][doc], number - text_line[doc], again, *[x.view(np.int64) for x in (d1, d2)]]
                keys = [pa.array(x.view(np.int64), mask=n < near) for x in (h1, h2, h3)]
                yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in columns], *keys], ["doc_id", "line_no", "again", "d1", "d2", "h1", "h2", "h3"])

    rows = docs.select(F.col("doc_id").cast(T.LongType()), F.col("text").cast(T.StringType())).filter("doc_id is not null and length(text) > 0")
    return rows.mapInArrow(run, "doc_id long, line_no long, again boolean, d1 long, d2 long, h1 long, h2 long, h3 long")


def _earliest(rows: DataFrame) -> DataFrame:
    """Distinct lines with their earliest place and number of rows; all buffers are longs, so this is a hash aggregation."""
    return rows.groupBy("d1", "d2").agg(
        F.min("doc_id").alias("doc"),
        F.min_by("line_no", F.when(~F.col("again"), F.col("doc_id"))).alias("no"),
        F.count(F.lit(1)).alias("n"),
        *[F.first(h).alias(h) for h in ("h1", "h2", "h3")],
    )


def _candidates(distinct: DataFrame) -> DataFrame:
    """doc and no of the lines that share a half with another distinct line."""
    keys = distinct.filter("h1 is not null").select("doc", "no", F.explode(F.array("h1", "h2", "h3")).alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    return keys.join(shared, "key").select("doc", "no").distinct()


def _line_texts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """doc, no and text of the given lines."""
    wanted = places.groupBy("doc").agg(F.collect_list("no").alias("nos"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).filter("doc is not null and length(text) > 0")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out: list[tuple] = []
            for doc, text, nos in zip(*[c.to_pylist() for c in batch.columns]):
                all_lines = text.split("\n")
                out += [(doc, no, all_lines[no]) for no in nos if no < len(all_lines)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["doc", "no", "line"])

    # Rows that repeat a doc_id give the same line twice or lines of another text; one of each place goes on.
    return texts.join(wanted, "doc").select("doc", "text", "nos").mapInArrow(run, "doc long, no long, line string").dropDuplicates(["doc", "no"])


def _variants(texts: DataFrame, near: int) -> DataFrame:
    """doc, no, at (place of the deleted word, -1 for none) and key of every variant; lines of fewer than ``near`` words lose none."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column(2).to_pylist()
            for lo, hi in slices(column, 200_000):
                data = b"\n".join([_bare(t) for t in column[lo:hi]])
                starts, words = word_hashes(data)
                bounds = np.concatenate(([0], np.cumsum([len(_bare(t)) + 1 for t in column[lo:hi]])))
                owner = np.searchsorted(bounds, starts, side="right") - 1
                n = np.bincount(owner, minlength=hi - lo)
                end = np.cumsum(n)
                first = end - n
                span = Spans(words)
                word = np.arange(len(words))
                a, b = first[owner], end[owner]
                with np.errstate(over="ignore"):
                    # What follows the deleted word moves one place to the front.
                    rest = span.raw(a, word) + span.raw(word + 1, b) * span.up[word - a]
                    deleted = mix(rest + (b - a - 1).astype(_U) * _U(0x2545F4914F6CDD1D))
                long = n[owner] >= near
                key = np.concatenate((deleted[long], span.hash(first, end)))
                at = np.concatenate(((word - a)[long], np.full(hi - lo, -1)))
                who = np.concatenate((owner[long], np.arange(hi - lo))) + lo
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(who)), batch.column(1).take(pa.array(who)), pa.array(at), pa.array(key.view(np.int64))], ["doc", "no", "at", "key"]
                )

    return texts.select("doc", "no", "line").mapInArrow(run, "doc long, no long, at long, key long")


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """Whether two sequences are at most one insertion, deletion or replacement apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def _neighbours(docs: DataFrame, distinct: DataFrame, near: int) -> DataFrame:
    """doc, no of distinct lines that have an earlier line one edit away, and by_doc, by_no of the earliest such line."""
    texts = cut_lineage(_line_texts(docs, _candidates(distinct)))
    variants = _variants(texts, near)
    place = F.struct("doc", "no")
    cliques = variants.filter("at >= 0").groupBy("key", "at").agg(F.min(place).alias("by"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    same_place = variants.join(cliques, ["key", "at"]).select(place.alias("x"), "by").filter("by < x")
    whole = variants.filter("at < 0").select("key", place.alias("y"))
    # A line and its variant: the later one is the line that may go; of the longer lines of one variant the earliest will do.
    longer = variants.filter("at >= 0").select("key", place.alias("x")).join(whole, "key")
    later = longer.filter("y < x").select("x", F.col("y").alias("by"))
    shorter = longer.filter("x < y").groupBy("y").agg(F.min("x").alias("by")).select(F.col("y").alias("x"), "by")
    pairs = same_place.unionByName(later).unionByName(shorter).distinct()
    line = texts.select(F.struct("doc", "no").alias("at"), "line")
    both = pairs.join(line.select(F.col("at").alias("x"), F.col("line").alias("l1")), "x").join(line.select(F.col("at").alias("by"), F.col("line").alias("l2")), "by")

    def verify(batches):
        import pyarrow as pa

        for batch in batches:
            ok = [within_one(_bare(a).split(), _bare(b).split()) for a, b in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:4]], ["doc", "no", "by_doc", "by_no"])

    checked = both.select(F.col("x.doc").alias("doc"), F.col("x.no").alias("no"), F.col("by.doc").alias("by_doc"), F.col("by.no").alias("by_no"), "l1", "l2")
    good = checked.mapInArrow(verify, "doc long, no long, by_doc long, by_no long")
    return good.groupBy("doc", "no").agg(F.min(F.struct("by_doc", "by_no")).alias("by")).select("doc", "no", "by.by_doc", "by.by_no")


def duplicate_lines(docs: DataFrame, max_edits: int = 1, min_words: int | None = None) -> DataFrame:
    """One row per line to remove: doc_id, line_no (from 0), first_doc_id, first_line_no, edits."""
    if max_edits not in (0, 1) or min_words is not None and min_words < 2:
        raise ValueError("max_edits is 0 or 1, min_words 2 or more")
    # A line one word shorter than NEAR_WORDS may be the shorter one of a pair.
    least, shortest, longer = (1, NEAR_WORDS - 1, NEAR_WORDS) if min_words is None else (min_words, min_words, min_words)
    rows = lines(docs, least, shortest)  # a pure function of the input, computed twice rather than stored
    distinct = _earliest(rows)
    if max_edits:
        distinct = cut_lineage(distinct)
        near = _neighbours(docs, distinct, longer)
        distinct = distinct.join(near, ["doc", "no"], "left")
    else:
        distinct = distinct.withColumns({"by_doc": F.lit(None).cast("long"), "by_no": F.lit(None).cast("long")})
    near = F.col("by_doc").isNotNull()
    gone = distinct.filter((F.col("n") > 1) | near).select("d1", "d2", "doc", "no", "by_doc", "by_no")
    kept = ~near & (F.col("doc_id") == F.col("doc")) & (F.col("line_no") == F.col("no"))
    return rows.select("doc_id", "line_no", "d1", "d2").join(gone, ["d1", "d2"]).filter(~kept).select(
        "doc_id",
        "line_no",
        F.coalesce("by_doc", "doc").alias("first_doc_id"),
        F.coalesce("by_no", "no").alias("first_line_no"),
        near.cast("long").alias("edits"),
    ).distinct()


def dedup_lines(docs: DataFrame, max_edits: int = 1, min_words: int | None = None, spare: float | None = None) -> DataFrame:
    """``docs`` without the duplicate lines; a text keeps its other lines, joined as before.

    A text that would lose the share ``spare`` of its characters or more (without white space at the ends of lines) is a copy as a whole: it
    stays as it is, for an operator that judges documents. By default every duplicate line goes.
    """
    gone = duplicate_lines(docs, max_edits, min_words)
    lists = gone.groupBy(F.col("doc_id").alias("__ld_id")).agg(F.collect_set("line_no").alias("__ld_nos"))
    joined = docs.join(lists, docs["doc_id"].cast("long") == lists["__ld_id"], "left")
    names = docs.columns
    text_at = names.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = []
            for text, nos in zip(batch.column(text_at).to_pylist(), batch.column(len(names)).to_pylist()):
                if text and nos:
                    out, of_text = set(nos), text.split("\n")
                    size = [len(x.strip()) for x in of_text] if spare is not None else []
                    if spare is None or sum(n for i, n in enumerate(size) if i in out) < spare * sum(size):
                        text = "\n".join([x for i, x in enumerate(of_text) if i not in out])
                texts.append(text)
            columns = batch.columns[:-1]
            columns[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == "text" else f.dataType) for f in docs.schema.fields])
    return joined.drop("__ld_id").mapInArrow(run, schema)
