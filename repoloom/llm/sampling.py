"""Bounded samples of labelled rows, chosen by hash so that reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_bucket(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n))


def per_class(rows: DataFrame, label: str, key: str, bound: int) -> DataFrame:
    """About ``bound`` rows of each label (all, if fewer): one count per label, then a hash threshold, no sort.

    The number of distinct labels must be small; there is one literal per label in the plan.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    keep = F.lit(False)
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    for value, n in sorted(counts.items(), key=lambda x: str(x[0])):
        if value is not None:
            keep = keep | ((F.col(label) == F.lit(value)) & (place < F.lit(min(1.0, bound / n) if n else 1.0)))
    return rows.filter(keep)
