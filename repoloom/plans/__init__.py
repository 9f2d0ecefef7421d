"""Registered queries over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _load() -> None:
    from repoloom.plans import corpus, dialogs, code, exports, graph, search, strings, tokens, wikis  # noqa: F401


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    from repoloom.plans.catalog import QUERIES

    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    from repoloom.plans.catalog import ORACLES

    return dict(ORACLES)
