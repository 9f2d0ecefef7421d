"""Small helpers that shape plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns through a one-row generator.

    Filters on such columns stay above them, and later columns read their value.
    As plain projections, the optimizer would copy a long pattern or parse
    expression into every filter it pushes below.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def spread_small(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by the keys when the input has fewer partitions than the session has cores.

    Few partitions mean a small input (a file split holds 128 MB at most by
    default), so the shuffle is cheap and CPU-heavy row work uses all cores.
    A large input already has more splits than cores and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def join_salted(
    big: DataFrame, small: DataFrame, keys: list[str], salt: Column, salts: int = 32, how: str = "inner"
) -> DataFrame:
    """Join wide rows to one narrow row per key; a key with most of the rows is spread over ``salts`` tasks.

    ``small`` is repeated ``salts`` times, so it should hold short rows.
    """
    left = big.withColumn("__salt", F.pmod(salt, F.lit(salts)).cast("int"))
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
