import pytest
from pyspark.sql import functions as F

from repoloom.operators import run_totals
from repoloom.operators.embedding import embedding_stats
from repoloom.operators.search import hit_texts
from repoloom.sources import store
from repoloom.streaming import pieces, refresh

KEY = {"repo_type": "github", "owner": "o", "repo": "my_repo", "language": "en"}


def wiki_rows(spark, repos, text):
    rows = [("github", "o", r, "en", f"p{i}", text) for r in repos for i in range(3)]
    return spark.createDataFrame(rows, "repo_type string, owner string, repo string, language string, page_id string, content string")


def test_wiki_store(spark, tmp_path):
    path = str(tmp_path / "wikis")
    store.save_wikis(wiki_rows(spark, ["my_repo", "other"], "v1"), path)
    store.save_wikis(wiki_rows(spark, ["my_repo"], "v2"), path)
    one = store.read_wiki(spark, path, {**KEY, "language": "??"})
    assert {r.content for r in one.collect()} == {"v2"} and one.count() == 3
    assert "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().executedPlan().toString()
    assert store.delete_wiki(spark, path, KEY) and not store.delete_wiki(spark, path, KEY)
    left = store.read_wikis(spark, path)
    assert {r.repo for r in left.collect()} == {"other"} and {r.content for r in left.collect()} == {"v1"}
    with pytest.raises(ValueError):
        store.delete_wiki(spark, path, {**KEY, "language": "??"})


def test_wiki_keys_stay_text(spark, tmp_path):
    path = str(tmp_path / "wikis")
    names = ["007", "12", "2024-01-01", "null", "a/b=c"]
    store.save_wikis(wiki_rows(spark, names, "v"), path)
    store.save_wikis(wiki_rows(spark, ["007"], "w"), path)
    assert sorted({r.repo for r in store.read_wikis(spark, path).collect()}) == sorted(names)
    assert {r.content for r in store.read_wiki(spark, path, {**KEY, "repo": "007"}).collect()} == {"w"}
    for n in names:
        assert store.delete_wiki(spark, path, {**KEY, "repo": n})


def test_damaged_and_half_written_stores_are_rebuilt(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(5).repartition(2)

    path = tmp_path / "db"
    assert store.load_or_build(spark, str(path), build).count() == 5
    part = next(p for p in path.iterdir() if p.name.startswith("part"))
    part.write_bytes(b"PAR1 broken")
    (path / f".{part.name}.crc").unlink()
    assert store.load_or_build(spark, str(path), build).count() == 5 and len(calls) == 2
    (path / "_SUCCESS").unlink()
    assert store.load_or_build(spark, str(path), build).count() == 5 and len(calls) == 3
    assert store.load_or_build(spark, str(path), build).count() == 5 and len(calls) == 3


def test_load_or_build_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([("r", "a.py", [1.0])], "repo string, path string, vector array<double>")

    path = str(tmp_path / "db")
    for _ in range(2):
        assert store.load_or_build(spark, path, build, ["repo"]).count() == 1
    assert len(calls) == 1
    spark.createDataFrame([], "repo string, path string, vector array<double>").write.mode("overwrite").parquet(path)
    assert store.load_or_build(spark, path, build).count() == 1 and len(calls) == 2


def test_stored_files_and_analysis(spark, tmp_path):
    for n in ("wiki_cache_github_o_r_en.json", "wiki_cache_x_en.json"):
        (tmp_path / n).write_text("{}")
    got = store.newest_first(store.project_catalogue(store.stored_files(spark, str(tmp_path)))).collect()
    assert [(r.name, r.language) for r in got] == [("o/r", "en")] and got[0].submitted_at > 10**12
    path = str(tmp_path / "analysis")
    store.write_analysis(spark.createDataFrame([("p", 1), ("q", 2)], "project string, n int"), path)
    assert {(r.project, r.n) for r in spark.read.json(path).collect()} == {("p", 1), ("q", 2)}
    projects = spark.createDataFrame([("p",), ("q",), ("z",)], "project string")
    records = spark.createDataFrame([("p", "{}{}"), ("q", "x" * 50)], "project string, record string")
    assert {tuple(r) for r in store.analysis_record(projects, records, 10).collect()} == {
        ("p", 0, "{}{}", None), ("z", 0, "{}", "missing"), *{("q", i, "xx", "in parts") for i in range(25)},
    }
    long = spark.createDataFrame([("q", "aé漢😀" * 1000)], "project string, record string")
    parts = store.analysis_record(projects, long, 100).filter("project = 'q'").orderBy("part_no").collect()
    assert "".join(r.record for r in parts) == "aé漢😀" * 1000 and all(len(r.record.encode()) <= 100 for r in parts)


def test_vector_store(spark, tmp_path):
    df = spark.createDataFrame([(1, "t", [1.0], {"a": "b"})], "vec_id long, text string, vector array<double>, meta map<string,string>")
    store.save_vectors(df, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).first().meta == {"a": "b"}


def test_refresh_only_builds_changes_and_drops_deleted(spark):
    built = []

    def build(df):
        built.extend(sorted(r.path for r in df.collect()))
        return df.select("path", "hash", "text")

    def listing(rows):
        return spark.createDataFrame(rows, "path string, text string").withColumn("hash", refresh.content_hash())

    first = build(listing([("a", "1"), ("b", "2"), ("c", "3")]))
    built.clear()
    second = refresh.refreshed(listing([("a", "1"), ("b", "new"), ("d", "4")]), first, build)
    assert {(r.path, r.text) for r in second.collect()} == {("a", "1"), ("b", "new"), ("d", "4")}
    assert built == ["b", "d"]


def test_refresh_stream_in_batches_equals_one_run(spark, tmp_path):
    schema = "path string, version long, text string"
    batches = [
        [("a", 1, "x"), ("b", 1, "y"), ("a", 2, "x2")],
        [("b", 0, "late"), ("c", 3, "z"), ("a", 5, "x2")],
        [("a", 4, "between"), ("b", 6, "y6")],
    ]
    src, one, two = tmp_path / "src", str(tmp_path / "s1"), str(tmp_path / "s2")
    build = lambda df: df.select("path", "hash", "version", F.explode(F.split("text", "")).alias("c"))
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
        refresh.refresh_stream(spark, stream, one, str(tmp_path / "c1"), build)
    stream = spark.readStream.schema(schema).parquet(str(src))
    refresh.refresh_stream(spark, stream, two, str(tmp_path / "c2"), build)

    def content(store_path):
        rows = refresh.stored_rows(spark, store_path).collect()
        return sorted((r.path, r.version, r.c) for r in rows)

    assert content(one) == content(two)
    assert {(p, v) for p, v, _ in content(one)} == {("a", 5), ("b", 6), ("c", 3)}


def test_refresh_survives_a_lost_checkpoint_and_emptied_files(spark, tmp_path):
    schema = "path string, version long, text string"
    build = lambda df: df.select("path", "hash", "version", F.explode(F.filter(F.split("text", " "), lambda x: x != "")).alias("w"))
    out = str(tmp_path / "s")

    def take(name, rows, checkpoint):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / name))
        refresh.refresh_stream(spark, stream, out, str(tmp_path / checkpoint), build)
        return sorted((r.path, r.version, r.w) for r in refresh.stored_rows(spark, out).collect())

    assert take("a", [("x", 5, "new words"), ("y", 1, "one")], "c1") == [("x", 5, "new"), ("x", 5, "words"), ("y", 1, "one")]
    # Emptied, then an older version comes late: it must not bring the old text back.
    assert take("a", [("x", 7, "")], "c1") == [("y", 1, "one")]
    assert take("a", [("x", 6, "old")], "c1") == [("y", 1, "one")]
    # The stream's checkpoint is lost and everything is read again, with something new.
    assert take("a", [("y", 2, "two")], "c2") == [("y", 2, "two")]


def test_late_and_repeated_pieces(spark, tmp_path):
    schema = "session string, seq long, piece string"
    batches = [[("s", 4, "e")], [("t", 0, "z")], [("s", 0, "a")], [("s", 0, "a"), ("s", 4, "E")], [("s", 100_000, "far")]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src"))
        # The third run begins with a new checkpoint, so all pieces come again.
        pieces.assembly_stream(spark, stream, str(tmp_path / "o"), str(tmp_path / f"c{i // 3}"))
    got = {(r.session, r.part_no): r.answer for r in pieces.stored_answers(spark, str(tmp_path / "o")).collect()}
    assert got == {("s", 0): "aE", ("s", 1): "far", ("t", 0): "z"}


def test_pieces_stream_equals_batch(spark, tmp_path):
    schema = "session string, seq long, piece string"
    rows = [("s", i, p) for i, p in enumerate(["<think>", "a", "model=x", "b</think>", "", "c"])] + [("t", 0, "z"), ("s", 1, "a")]
    df = spark.createDataFrame(rows, schema)
    src = str(tmp_path / "src")
    df.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    pieces.assembly_stream(spark, stream, str(tmp_path / "o"), str(tmp_path / "c"))
    batch = pieces.assembled(pieces.clean_pieces(df).dropDuplicates(["session", "seq"]))
    want = {"s": "abc", "t": "z"}
    assert {r.session: r.answer for r in batch.collect()} == want
    assert {r.session: r.answer for r in pieces.stored_answers(spark, str(tmp_path / "o")).collect()} == want


def test_totals_are_observed_while_rows_are_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0], "ok"), (2, [], "empty"), (3, None, "error"), (4, [2.0], "ok")], "vec_id long, vector array<double>, embed_status string")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    totals = run_totals.write_observed(rows.mapInArrow(count, rows.schema), str(tmp_path / "t"), run_totals.embedding_totals())
    assert totals == {"total": 4, "valid": 2, "empty": 2, "failed": 1} and seen.value == 4  # one pass
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    want = embedding_stats(rows.withColumn("k", F.lit(1)), ["k"]).drop("k").first().asDict()
    assert totals == want
    assert run_totals.write_observed(rows.filter("false"), str(tmp_path / "e"), run_totals.embedding_totals())["total"] == 0


def test_bucketed_rows_are_joined_where_they_lie(spark, tmp_path):
    rows = spark.range(2000).select(F.col("id").alias("vec_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    stored = store.save_bucketed(rows, "bucketed_test", str(tmp_path / "b"), "vec_id", 8)
    hits = spark.range(0, 2000, 7).select(F.col("id").alias("vec_id"), (F.col("id") % 3).alias("query_id"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = hit_texts(hits, stored)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        lines = plan.split("\n")
        scan = next(i for i, x in enumerate(lines) if "FileScan" in x)
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan and not any("Exchange" in x for x in lines[scan - 3 : scan]), plan
        assert joined.count() == hits.count() and joined.filter("text <> concat('text ', vec_id)").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE bucketed_test")
