"""Order-dependent operators that stay balanced when one group holds most of the rows.

A plain ``Window.partitionBy(group)`` sends a whole group to one task. That is fine
for groups of bounded size, so group sizes are counted first (partial aggregation, key
columns only). Groups above ``hot_rows`` are range-partitioned by (group, order)
instead, which spreads each over many tasks. Work on them happens in two steps: inside each
(partition, group) piece, and over one small carry row per piece that continues a
group from an earlier partition. At most one such row exists per partition, so the
carry table is bounded by the partition count and safe to broadcast; so are the hot
keys, of which there are fewer than rows / ``hot_rows``.

The range-partitioned rows are checkpointed: partition ids must be the same in
both steps, also after an executor is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoloom.session import cut_lineage

_PID = "__pid"
HOT_ROWS = 1_000_000


def _range_pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int, hot_rows: int) -> DataFrame:
    # As many partitions as keep each within hot_rows, however many rows there are.
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // max(hot_rows, 10_000)))
    spread = df.repartitionByRange(n, *keys, *order)
    return cut_lineage(spread.withColumn(_PID, F.spark_partition_id()))


def _same_key(a: DataFrame, b: DataFrame, keys: Sequence[str], prefix: str) -> Column:
    # Null-safe equality: a null key is a group of its own, as in GROUP BY.
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[f"{prefix}{k}"])
    return cond


def _carried_over(pieces: DataFrame, keys: Sequence[str], summary: Column, combine: Callable[[Column], Column], name: str) -> DataFrame:
    """Per piece that continues a group of an earlier partition: the combined summary of those earlier pieces.

    Only the last group of a partition can go on in the next one. Those groups are
    found from one row per partition; the summary is then taken for them alone.
    """
    spans = pieces.groupBy(_PID).agg(
        F.min(F.struct(*keys)).alias("lo"), F.max(F.struct(*keys)).alias("hi")
    ) if keys else None
    if spans is None:
        open_rows = pieces
    else:
        following = F.lead("lo").over(Window.orderBy(_PID))
        open_keys = (
            spans.withColumn("next", following)
            .filter(F.col("hi").eqNullSafe(F.col("next")))
            .select(*[F.col(f"hi.{k}").alias(f"__o_{k}") for k in keys])
            .distinct()
        )
        open_rows = pieces.join(F.broadcast(open_keys), _same_key(pieces, open_keys, keys, "__o_"), "left_semi")
    before = Window.partitionBy(*keys).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    return (
        open_rows.groupBy(_PID, *keys)
        .agg(summary.alias("__s"))
        .withColumn(name, combine(F.col("__s")).over(before))
        .filter(F.col(name).isNotNull())
        .select(F.col(_PID).alias("__c_pid"), *[F.col(k).alias(f"__c_{k}") for k in keys], name)
    )


def _with_carry(pieces: DataFrame, keys: Sequence[str], carry: DataFrame) -> DataFrame:
    cond = (pieces[_PID] == carry["__c_pid"]) & _same_key(pieces, carry, keys, "__c_")
    return pieces.join(F.broadcast(carry), cond, "left").drop("__c_pid", *[f"__c_{k}" for k in keys])


def _by_heat(
    df: DataFrame,
    keys: list[str],
    plain: Callable[[DataFrame], DataFrame],
    spread: Callable[[DataFrame, int], DataFrame],
    hot_rows: int,
    measure: DataFrame | None,
) -> DataFrame:
    """Apply ``plain`` to groups of usual size and ``spread`` to hot ones; without keys all rows are one group."""
    counted = df if measure is None else measure
    if not keys:
        return spread(df, counted.count())
    sizes = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    hot = sizes.filter(F.col("__n") > hot_rows)
    rows = hot.agg(F.sum("__n").alias("n")).first()["n"]
    if rows is None:
        return plain(df)
    hot = cut_lineage(hot.select(*[F.col(k).alias(f"__h_{k}") for k in keys]))
    cond = _same_key(df, hot, keys, "__h_")
    cold, warm = df.join(F.broadcast(hot), cond, "left_anti"), df.join(F.broadcast(hot), cond, "left_semi")
    return plain(cold).unionByName(spread(warm, rows))


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "row_no",
    hot_rows: int = HOT_ROWS,
    measure: DataFrame | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in its group; (keys, order) must identify a row.

    ``measure`` may name a cheaper table with at least the same rows per group to count on.
    """
    keys = list(keys)

    def plain(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*order)
        return rows.withColumn(name, (F.row_number().over(w) - 1).cast("long"))

    def spread(rows: DataFrame, total: int) -> DataFrame:
        pieces = _range_pieces(rows, keys, order, total, hot_rows)
        carry = _carried_over(pieces, keys, F.count(F.lit(1)), F.sum, "__before")
        local = Window.partitionBy(_PID, *keys).orderBy(*order)
        numbered = pieces.withColumn("__local", F.row_number().over(local) - 1)
        return (
            _with_carry(numbered, keys, carry)
            .withColumn(name, F.col("__local") + F.coalesce("__before", F.lit(0)).cast("long"))
            .drop("__local", "__before", _PID)
        )

    return _by_heat(df, keys, plain, spread, hot_rows, measure)


def fill_forward(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    include_current: bool = True,
    hot_rows: int = HOT_ROWS,
    measure: DataFrame | None = None,
) -> DataFrame:
    """Add the most recent non-null ``value`` of the group, up to or strictly before each row."""
    keys = list(keys)
    end = 0 if include_current else -1

    def plain(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        return rows.withColumn(name, F.last("__v", ignorenulls=True).over(w)).drop("__v")

    def spread(rows: DataFrame, total: int) -> DataFrame:
        pieces = _range_pieces(rows, keys, order, total, hot_rows)
        at = F.when(F.col("__v").isNotNull(), F.struct(*order))
        carry = _carried_over(pieces, keys, F.max_by("__v", at), lambda c: F.last(c, ignorenulls=True), "__carry")
        local = Window.partitionBy(_PID, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        filled = pieces.withColumn("__near", F.last("__v", ignorenulls=True).over(local))
        return (
            _with_carry(filled, keys, carry)
            .withColumn(name, F.coalesce("__near", "__carry"))
            .drop("__near", "__carry", "__v", _PID)
        )

    return _by_heat(df.withColumn("__v", value), keys, plain, spread, hot_rows, measure)


def number_rows_by_id(df: DataFrame, keys: Sequence[str], id_col: str, name: str = "row_no", block: int = 1_000_000) -> DataFrame:
    """``number_rows`` for a unique integer id: blocks of ids replace range partitions, no checkpoint needed.

    A block of one group holds at most ``block`` rows whatever the skew, and the
    block is a pure function of the id, so recomputation cannot change it.
    """
    keys = list(keys)
    rows = df.withColumn("__blk", F.floor(F.col(id_col) / F.lit(block)))
    sizes = rows.groupBy(*keys, "__blk").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "__blk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    local = Window.partitionBy(*keys, "__blk").orderBy(id_col)
    numbered = rows.withColumn("__local", F.row_number().over(local) - 1)
    return (
        numbered.join(offsets, [*keys, "__blk"])
        .withColumn(name, F.col("__local") + F.col("__before"))
        .drop("__local", "__before", "__blk")
    )


def text_parts(
    df: DataFrame,
    keys: Sequence[str],
    position: Column,
    text: Column,
    order: Column,
    separator: str,
    part_rows: int,
    name: str = "text",
) -> DataFrame:
    """Concatenate ordered pieces of text into parts of at most ``part_rows`` rows.

    A group of normal size gives one part (``part_no`` 0) with its whole text; a
    huge group gives several, to be written one after the other. ``position``
    is a 0-based position (gaps allowed) that rises with ``order``.
    """
    rows = df.select(
        *keys,
        F.floor(position / F.lit(part_rows)).cast("long").alias("part_no"),
        order.alias("__o"),
        text.alias("__t"),
    )
    return rows.groupBy(*keys, "part_no").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("__o", "__t"))), lambda x: x["__t"]), separator
        ).alias(name)
    )
