import random

import pytest
from pyspark.sql import functions as F

from repoloom.operators import ordered


def rows(seed=1, n=600):
    rnd = random.Random(seed)
    keys = ["hot"] * 6 + ["a", "b", None, "c"]
    return [(rnd.choice(keys), i, rnd.choice([None, None, f"v{i}"])) for i in range(n)]


@pytest.mark.parametrize("hot_rows", [0, 100, 10**6])
def test_number_rows(spark, hot_rows):
    data = rows()
    df = spark.createDataFrame(data, "k string, o long, v string").repartition(7)
    got = {(r.k, r.o): r.row_no for r in ordered.number_rows(df, ["k"], ["o"], hot_rows=hot_rows).collect()}
    seen, want = {}, {}
    for k, o, _ in data:
        want[(k, o)] = seen.get(k, 0)
        seen[k] = want[(k, o)] + 1
    assert got == want


def test_number_rows_of_everything(spark):
    df = spark.createDataFrame([(f"p{i:04d}",) for i in range(500)], "p string").repartition(5)
    got = ordered.number_rows(df, [], ["p"]).collect()
    assert {r.p: r.row_no for r in got} == {f"p{i:04d}": i for i in range(500)}


@pytest.mark.parametrize("include", [True, False])
@pytest.mark.parametrize("hot_rows", [0, 100, 10**6])
def test_fill_forward(spark, hot_rows, include):
    data = rows(2)
    df = spark.createDataFrame(data, "k string, o long, v string").repartition(7)
    out = ordered.fill_forward(df, ["k"], ["o"], F.col("v"), "f", include_current=include, hot_rows=hot_rows)
    last, want = {}, {}
    for k, o, v in data:
        before = last.get(k)
        last[k] = v or before
        want[(k, o)] = last[k] if include else before
    assert {(r.k, r.o): r.f for r in out.collect()} == want


def test_number_rows_by_id(spark):
    ids = sorted(random.Random(3).sample(range(10_000), 400))
    df = spark.createDataFrame([("h" if i % 5 else "x", i) for i in ids], "k string, id long")
    got = ordered.number_rows_by_id(df, ["k"], "id", "n", block=100).collect()
    want = {i: n for k in "hx" for n, i in enumerate(j for j in ids if ("h" if j % 5 else "x") == k)}
    assert {r.id: r.n for r in got} == want


def test_text_parts(spark):
    df = spark.createDataFrame([("k", i, f"t{i}") for i in range(10)], "k string, n long, t string").repartition(3)
    parts = ordered.text_parts(df, ["k"], F.col("n"), F.col("t"), F.col("n"), ",", 4).orderBy("part_no").collect()
    assert [p.text for p in parts] == ["t0,t1,t2,t3", "t4,t5,t6,t7", "t8,t9"]


def test_checkpoint_folder_is_the_sessions(spark):
    from repoloom.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    first = spark.sparkContext.getCheckpointDir()
    ensure_checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir() == first
