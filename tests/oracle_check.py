"""Compare registered queries with their SQL on the driver tables: python tests/oracle_check.py [sf_dir] [name ...]."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "\0null"
    if isinstance(v, bool):
        return f"b{v}"
    if isinstance(v, (int, float)):
        return f"{float(v):.6f}"
    return str(v)


def rows_of(table, names: list[str]) -> list[tuple]:
    cols = [table.column(n).to_pylist() for n in names]
    return sorted(tuple(_cell(v) for v in r) for r in zip(*cols))


def kinds(schema) -> dict[str, str]:
    import pyarrow.types as pt

    def kind(t):
        if pt.is_boolean(t):
            return "bool"
        if pt.is_integer(t):
            return f"int{t.bit_width}"
        if pt.is_floating(t):
            return "float"
        if pt.is_string(t) or pt.is_large_string(t):
            return "text"
        return str(t)

    return {f.name: kind(f.type) for f in schema}


def difference(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    ours = df.toArrow()
    theirs = con.execute(sql).to_arrow_table()
    a, b = sorted(ours.column_names), sorted(theirs.column_names)
    if a != b:
        return f"columns {a} vs {b}"
    ka, kb = kinds(ours.schema), kinds(theirs.schema)
    if ka != kb:
        return f"types { {c: (ka[c], kb[c]) for c in a if ka[c] != kb[c]} }"
    if ours.num_rows != theirs.num_rows:
        return f"rows {ours.num_rows} vs {theirs.num_rows}"
    x, y = rows_of(ours, a), rows_of(theirs, a)
    if x != y:
        bad = [(p, q) for p, q in zip(x, y) if p != q]
        return f"{len(bad)} of {len(x)} rows differ; columns {a}; first {str(bad[0][0])[:700]} vs {str(bad[0][1])[:700]}"
    if not x:
        return "empty result"
    return None


def main() -> int:
    from repoloom.session import local_session
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failed = connect(sf_dir), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if wanted and not any(name == w or name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = difference(fn(spark, sf_dir), con, oracles[name])
            else:
                problem = None if fn(spark, sf_dir).toArrow().num_rows else "empty result"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:900]}"
        failed += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name} {time.time() - start:.2f}s {'' if name in oracles else '(rows only)'} {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
