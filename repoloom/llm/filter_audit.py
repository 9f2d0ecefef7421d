"""Filter interaction audit: which filters agree, which repeat each other, and what every order of them would remove.

Each filter but the last is a condition on one text. The last one (``exact``) fails a document whose text equals the text of
a smaller doc_id anywhere in the table: hashes seen under two ids leave few candidates, and a left-semi join on
hash, exact text and smaller doc_id marks them. Its ids are joined by union with the ids that fail other filters, failures become
bits of one number per document, and documents are counted per part and combination. Everything else follows from
those counts, at most 2^filters per part: no order of filters is ever run on documents.

Scale: the hash side moves 16 bytes a row, texts move once against the repeated hashes, and texts of
candidates once more. A group of copies of any size is dealt over salts in both joins, ``GROUP`` rows a salt in the second one. A hot
part costs one row per task and combination.

Edge cases: a null text is empty, a null part is the empty string. Rows that repeat a doc_id count one by one; equal texts under
one doc_id are no copies of each other. A row without doc_id counts, but is neither a copy nor an original, and has no labels.
Several labels of one doc_id count as 1 where any is 1. No documents give no rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoloom.operators.columns import join_salted, settle
from repoloom.session import cut_lineage

BLANKS = " \t\n\x0b\x0c\r"
SALTS = 64
GROUP = 256  # rows of one group of copies that meet its witness in one task

Condition = Callable[[Column, Column], Column]


def _characters(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


#: Conditions on (text, words) under which a document fails.
FILTERS: dict[str, Condition] = {
    "A": lambda text, words: F.size(words) < 50,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
    "C": lambda text, words: 100 * _characters(text, "[A-Z]+") > 5 * F.length(text),
    "D": lambda text, words: text.rlike(r"[#$%&*|]"),
}


def _texts(docs: DataFrame, part: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))


def condition_bits(rows: DataFrame, filters: dict[str, Condition]) -> DataFrame:
    """doc_id, part, hash of the text, and the failed conditions as bits, in the order of ``filters``."""
    bare = F.btrim("text", F.lit(BLANKS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    rows = settle(rows, words=words)
    bits = F.lit(0)
    for i, failed in enumerate(filters.values()):
        bits = bits + F.when(failed(F.col("text"), F.col("words")), F.lit(1 << i)).otherwise(F.lit(0))
    return rows.select("doc_id", "part", F.unhex(F.md5("text")).alias("hash"), bits.alias("bits"))


def earlier_copies(rows: DataFrame) -> DataFrame:
    """Distinct doc_id, part and hash of the rows whose text a smaller doc_id has too.

    Takes doc_id, part and text.
    """
    hashed = rows.filter(F.col("doc_id").isNotNull()).withColumn("hash", F.unhex(F.md5("text")))
    repeated = hashed.groupBy("hash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n"))
    repeated = repeated.filter("least < most").select("hash", F.ceil(F.col("n") / GROUP).cast("int").alias("salts"))
    candidates = join_salted(hashed, repeated, ["hash"], F.xxhash64("doc_id"), salts=SALTS)
    # Equal hashes are no proof: the witness is the smallest id per text itself.
    candidates = cut_lineage(candidates.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts"))))
    witness = candidates.groupBy("hash", "text", "salts").agg(F.min("doc_id").alias("least"))
    witness = witness.select("hash", "text", "least", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1)).alias("salt"))
    c, w = candidates.alias("c"), witness.alias("w")
    same = (F.col("c.hash") == F.col("w.hash")) & (F.col("c.salt") == F.col("w.salt")) & (F.col("c.text") == F.col("w.text"))
    copies = c.join(w, same & (F.col("w.least") < F.col("c.doc_id")), "left_semi")
    return copies.select("doc_id", "part", "hash").distinct()


def failure_combinations(docs: DataFrame, labels: DataFrame, filters: dict[str, Condition] = FILTERS, part: str = "source") -> DataFrame:
    """part, bits and the documents (n), good and toxic ones among them; the last bit is that of exact copies."""
    rows = _texts(docs, part)
    single = condition_bits(rows, filters).withColumn("n", F.lit(1).cast("long"))
    copies = earlier_copies(rows).select("doc_id", "part", "hash", F.lit(1 << len(filters)).alias("bits"), F.lit(0).cast("long").alias("n"))
    failed = single.unionByName(copies).groupBy("doc_id", "part", "hash").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    # Rows without an id meet no label; their own hash spreads them.
    failed = failed.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.hex("hash")))
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    judged = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.concat(F.lit("="), F.col("doc_id").cast("string")).alias("key"))
    judged = judged.agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    of = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(c)
    return failed.join(judged, "key", "left").groupBy("part", "bits").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def order_effects(combinations: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the filters and step, from the counts of combinations alone.

    part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    """
    parts = combinations.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("cells"))
    orders = ",".join("".join(p) for p in itertools.permutations(letters))
    rows = parts.select("part", "cells", F.explode(F.split(F.lit(orders), ",")).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    bit = lambda place: F.expr(f"shiftleft(1, instr('{letters}', substr(filter_order, {place}, 1)) - 1)")
    before = F.lit(0)
    for i in range(1, len(letters)):
        before = before + F.when(F.col("step") > i, bit(i)).otherwise(F.lit(0))
    rows = rows.select("*", bit("step").alias("own"), before.alias("before"))
    own, earlier = F.col("own"), F.col("before")

    def total(where: Callable[[Column], Column], what: Callable[[Column], Column] = lambda c: c["n"]) -> Column:
        return F.aggregate(F.filter("cells", where), F.lit(0).cast("long"), lambda sum_, c: sum_ + what(c))

    fails = lambda c: c["bits"].bitwiseAND(own) != 0
    went = lambda c: c["bits"].bitwiseAND(earlier) != 0
    # A document that fails k filters is removed by each of them in one k-th of all orders.
    share = lambda c: c["n"] * F.lit(math.factorial(len(letters))) / F.bit_count(c["bits"])
    return rows.select(
        "part",
        "filter_order",
        "step",
        total(lambda c: c["bits"].bitwiseAND(own.bitwiseOR(earlier)) == 0).alias("kept"),
        total(lambda c: fails(c) & ~went(c)).alias("removed"),
        total(lambda c: fails(c) & went(c)).alias("redundant"),
        total(lambda c: c["bits"] == own).alias("unique_fails"),
        total(lambda c: fails(c) & ~went(c), lambda c: c["good"]).alias("good_lost"),
        total(lambda c: fails(c) & ~went(c), lambda c: c["toxic"]).alias("toxic_lost"),
        total(fails, lambda c: share(c).cast("long")).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Condition] = FILTERS, exact: str = "E", part: str = "source") -> DataFrame:
    """The audit of all orders of ``filters`` and the exact-copy filter; letters are single characters."""
    return order_effects(failure_combinations(docs, labels, filters, part), "".join(filters) + exact)


SQL = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
f as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    case when len(words) < 50 then 1 else 0 end as a,
    case when 100 * len(list_distinct(words)) < 65 * len(words) then 1 else 0 end as b,
    case when 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) then 1 else 0 end as c,
    case when regexp_matches(text, '[#$%&*|]') then 1 else 0 end as d,
    case when d.doc_id > min(d.doc_id) over (partition by text) then 1 else 0 end as e
  from d left join l using (doc_id)),
n as (select part, a + 2 * b + 4 * c + 8 * d + 16 * e as bits, a + b + c + d + e as fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by all),
x(x, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
p as (select x1.x || x2.x || x3.x || x4.x || x5.x as filter_order, [x1.bit, x2.bit, x3.bit, x4.bit, x5.bit] as bits
  from x x1, x x2, x x3, x x4, x x5 where x1.bit | x2.bit | x3.bit | x4.bit | x5.bit = 31),
s as (select filter_order, step, bits[step] as own, coalesce(list_sum(bits[1:step - 1]), 0)::integer as gone from p, (select unnest(range(1, 6)) as step))
select part, filter_order, step::integer as step,
  coalesce(sum(n) filter (bits & (own | gone) = 0), 0)::bigint as kept,
  coalesce(sum(n) filter (bits & own <> 0 and bits & gone = 0), 0)::bigint as removed,
  coalesce(sum(n) filter (bits & own <> 0 and bits & gone <> 0), 0)::bigint as redundant,
  coalesce(sum(n) filter (bits = own), 0)::bigint as unique_fails,
  coalesce(sum(good) filter (bits & own <> 0 and bits & gone = 0), 0)::bigint as good_lost,
  coalesce(sum(toxic) filter (bits & own <> 0 and bits & gone = 0), 0)::bigint as toxic_lost,
  coalesce(sum(n * 120 // greatest(fails, 1)) filter (bits & own <> 0), 0)::bigint as shapley
from n, s group by all
"""
