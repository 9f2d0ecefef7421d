"""Totals of a run, taken while its rows are written: no second pass over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from repoloom.functions import payloads as pl


def embedding_totals(vector: str = "vector", status: str = "embed_status") -> dict[str, Column]:
    """Measures of an embedding run: all rows, valid, empty and failed ones."""
    filled = F.coalesce(F.size(F.col(vector)), F.lit(0)) > 0
    return {
        "total": F.count(F.lit(1)),
        "valid": F.count_if(filled),
        "empty": F.count_if(~filled),
        "failed": F.count_if(F.col(status) == "error"),
    }


def file_totals(error: str = "error") -> dict[str, Column]:
    """Measures of a scan: all files, and those without an error."""
    return {"total_files": F.count(F.lit(1)), "processed_files": F.count_if(F.col(error).isNull())}


def usage_totals(body: str = "response") -> dict[str, Column]:
    """Measures of response records: their number and tokens."""
    used = pl.usage_totals(F.col(body))
    return {"responses": F.count(F.lit(1)), **{n: F.sum(used[n]) for n in ("prompt_tokens", "completion_tokens", "total_tokens")}}


def write_observed(rows: DataFrame, path: str, measures: dict[str, Column], mode: str = "errorifexists") -> dict:
    """Write the rows as Parquet and return the measures over what was written."""
    seen = Observation()
    rows.observe(seen, *[c.alias(n) for n, c in measures.items()]).write.mode(mode).parquet(path)
    return seen.get
