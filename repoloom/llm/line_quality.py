"""Quality rules: document statistics and line frequency across the documents of a host, in DataFrame functions only.

Base rules are computed inside each row: words, symbols, repeated lines, and words in five-word windows found twice or more.
Windows are hashed to longs; their repeats show in a sorted array, which is built for the few rows that have any.

Line rule: lines are normalised (lower case, white space collapsed) and hashed; each doc_id counts once per line and host. Lines in more than
``max(min_docs, share x documents of the host)`` documents are removed, by default 25 and 0.5 %: the share decides in hosts of over 5,000
documents, below it 25 documents are too few to call a line boilerplate. A document that keeps less than ``least_kept`` of its
words is depleted and rejected. The join back to the lines is salted, so that a hot line is spread over tasks.

Edge cases: a null text has no words and fails the base rules. A null host is a host of its own. Rows that share a doc_id
share the verdict on their lines, taken over all of them; null ids count as one such document. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoloom.operators.columns import join_salted, settle

SPACE = r"[\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE + "+"))


def text_statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    rows = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    worded = F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = settle(rows, __words=_words(F.col("__text")), __lines=worded, n_symbols=(F.length("__text") - F.length(F.regexp_replace("__text", SYMBOLS, ""))).cast("long"))
    rows = rows.select(
        *keep,
        "n_symbols",
        "__words",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
    )
    kept = [*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    rows = settle(rows.select(*kept, "__words"), __h=F.transform("__words", lambda x: F.xxhash64(x))).select(*kept, "__h")
    h = F.col("__h")
    windows = F.when(
        F.size(h) >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])),
    )
    rows = settle(rows, __w=windows).select(*kept, "__w")
    rows = settle(
        rows,
        __s=F.when(F.size(F.array_distinct("__w")) < F.size("__w"), F.array_sort(F.transform("__w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))),
    ).select(*kept, "__s")
    s = F.col("__s")
    beside = lambda e, j: F.coalesce(F.get(s, j)["x"] == e["x"], F.lit(False))
    repeated = F.filter(s, lambda e, i: beside(e, i + 1) | beside(e, i - 1))
    rows = settle(rows, __p=F.array_sort(F.transform(repeated, lambda e: e["i"]))).select(*kept, "__p")
    p = F.col("__p")
    # Words under overlapping windows count once: each window adds what lies before the next one.
    covered = F.aggregate(
        F.transform(p, lambda x, j: F.coalesce(F.least(F.lit(WINDOW), F.get(p, j + 1) - x), F.lit(WINDOW))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    return rows.select(*kept, F.coalesce(covered, F.lit(0)).alias("n_repeat_words"))


def _host() -> Column:
    """The host as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))


def line_keys(docs: DataFrame) -> DataFrame:
    """doc_id, host and the lines with a word as (key, words)."""
    lines = F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    norm = settle(docs.select("doc_id", _host().alias("host"), "text"), __l=lines).select("doc_id", "host", "__l")
    plain = F.transform("__l", lambda x: F.regexp_replace(F.lower(F.btrim(x, F.lit(BLANKS))), SPACE + "+", " "))
    norm = settle(norm, __n=plain).select("doc_id", "host", "__n")
    return norm.select(
        "doc_id",
        "host",
        F.transform("__n", lambda x: F.struct(F.md5(x).alias("key"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).cast("long").alias("words"))).alias("lines"),
    )


def frequent_lines(lines: DataFrame, docs: DataFrame, min_docs: int, share: float) -> DataFrame:
    """(host, key) of lines in more documents of the host than allowed."""
    ids = docs.select(_host().alias("host"), "doc_id").distinct()
    limit = ids.groupBy("host").agg(F.greatest(F.lit(float(min_docs)), F.count(F.lit(1)) * F.lit(share)).alias("limit"))
    # Rows that repeat a doc_id are one document.
    counted = (
        lines.select("host", "doc_id", F.explode(F.array_distinct(F.transform("lines", lambda x: x["key"]))).alias("key"))
        .distinct()
        .groupBy("host", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > min_docs)
    )
    return counted.join(limit, "host").filter(F.col("n") > F.col("limit")).select("host", "key", F.lit(True).alias("__frequent"))


def quality_rules(
    docs: DataFrame, min_docs: int = 25, share: float = 0.005, least_kept: float = 0.3, min_words: int = 10, most_repeated: int = 20
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words, kept."""
    stats = text_statistics(docs)
    lines = line_keys(docs)
    frequent = frequent_lines(lines, docs, min_docs, share)
    each = lines.select("doc_id", "host", F.explode("lines").alias("l")).select("doc_id", "host", F.col("l.key").alias("key"), F.col("l.words").alias("words"))
    # Frequent lines are few (at most lines / min_docs) and short; a line of a third of all documents is spread over the salts.
    removed = (
        join_salted(each, frequent, ["host", "key"], F.xxhash64("doc_id"), salts=16, how="left")
        .groupBy("doc_id")
        .agg(F.sum("words").alias("__all"), F.sum(F.when(F.col("__frequent"), F.col("words")).otherwise(0)).alias("__gone"))
        .select(F.col("doc_id").alias("__id"), "__all", "__gone")
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    depleted = F.coalesce(F.col("__all") - F.col("__gone") < F.lit(least_kept) * F.col("__all"), F.lit(False))
    return stats.join(removed, F.col("doc_id").eqNullSafe(F.col("__id")), "left").select(
        *stats.columns, failed.alias("base_failed"), F.coalesce("__gone", F.lit(0)).cast("long").alias("removed_words"), (~failed & ~depleted).alias("kept")
    )


SQL = r"""
with d as (select doc_id, source as host, coalesce(text, '') as text from documents),
w as (select doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, text from d),
b as (select doc_id, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols from w),
l as (select doc_id, host, unnest(list_filter(str_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) as line from d),
dl as (select doc_id, count(*) - count(distinct line) as n_dup_lines from l group by doc_id),
g as (select doc_id, i, array_to_string(list_slice(words, i, i + 4), ' ') as win
      from (select doc_id, words, unnest(range(1, len(words) - 3)) as i from w)),
r as (select doc_id, i, count(*) over (partition by doc_id, win) as n from g),
c as (select distinct doc_id, i + k as word from r, (values (0), (1), (2), (3), (4)) o(k) where n > 1),
rw as (select doc_id, count(*) as n_repeat_words from c group by doc_id),
nl as (select doc_id, host, lower(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ')) as line,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as words from l),
hosts as (select host, greatest(25.0, count(distinct doc_id) * 0.005) as lim from d group by host),
f as (select nl.host, nl.line from nl join hosts on nl.host is not distinct from hosts.host group by nl.host, nl.line, lim having count(distinct doc_id) > lim),
gone as (select nl.doc_id, sum(words) as all_words, sum(case when f.line is not null then words else 0 end) as gone
         from nl left join f on nl.host is not distinct from f.host and nl.line = f.line group by nl.doc_id),
j as (select b.doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
        coalesce(gone, 0) as removed_words, coalesce(all_words - gone < 0.3 * all_words, false) as depleted
      from b left join dl using (doc_id) left join rw using (doc_id) left join gone using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
  n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, cast(removed_words as bigint) as removed_words,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and not depleted as kept
from j
"""
