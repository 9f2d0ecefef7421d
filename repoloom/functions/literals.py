"""Literal lists and maps as one constant expression, and single evaluation of shared values."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_ITEM, _PAIR = "\x1f", "\x1d"


def literal_list(values: Iterable[str]) -> Column:
    """Array of strings; folded to a constant by the optimizer."""
    return F.split(F.lit(_ITEM.join(values)), _ITEM)


def literal_map(values: Mapping[str, str]) -> Column:
    """Map of strings; folded to a constant by the optimizer."""
    text = _ITEM.join(f"{k}{_PAIR}{v}" for k, v in values.items())
    return F.str_to_map(F.lit(text), F.lit(_ITEM), F.lit(_PAIR))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
