"""The repository source and the sink of named files."""

import hashlib
import io
import json
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oracle_check import connect, difference
from repoloom.operators import wiki
from repoloom.operators.filters import classify, keep_path
from repoloom.plans import all_oracles, all_queries
from repoloom.sources import files as src
from repoloom.sources import repository, store, text_files
from test_corpus import TREE, make_tree

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_same_rows_as_the_distributed_scan(spark, tmp_path):
    make_tree(str(tmp_path))
    want = src.read_repositories(spark, {"demo": str(tmp_path)})
    rows = repository.load(spark, {"demo": str(tmp_path)}).filter(keep_path(F.col("path")))
    got = classify(repository.whole_files(rows))
    key = ["repo", "path", "size", "type", "is_code", "is_implementation", "title", "text", "error"]
    assert sorted(got.select(key).collect(), key=str) == sorted(want.select(key).collect(), key=str)


def test_filters_are_pushed(spark, tmp_path):
    make_tree(str(tmp_path))
    rows = repository.load(spark, {"demo": str(tmp_path), "other": str(tmp_path)}, hidden="true")
    for condition, wanted in [
        ("extension = '.py'", lambda p, n: p.endswith(".py")),
        ("path LIKE 'src/%' AND size > 6", lambda p, n: p.startswith("src/") and n > 6),
        ("path LIKE '%_util%'", lambda p, n: "_util" in p),
        ("extension IN ('.md', '.java') AND repo = 'demo' AND size >= 1", lambda p, n: p.endswith((".md", ".java")) and n),
        ("path LIKE '%.PY' AND size < 2 AND size <= 1", lambda p, n: p == "Upper.PY"),
    ]:
        got = rows.filter(condition)
        assert " Filter (" not in plan(got), condition
        repos = ("demo",) if "repo" in condition else ("demo", "other")
        assert sorted((r.repo, r.path) for r in got.collect()) == sorted((x, p) for x in repos for p, d in TREE.items() if wanted(p, len(d))), condition
    # What the source cannot judge stays with Spark.
    rest = rows.filter("length(text) = 5 AND repo = 'demo'")
    assert " Filter (" in plan(rest) and {r.path for r in rest.collect()} == {"README.md"}


def test_huge_files_take_many_tasks(spark, tmp_path):
    with open(tmp_path / "huge.txt", "wb") as f:
        f.truncate(1 << 30)
    (tmp_path / "mixed.txt").write_text("é漢😀 line\n" * 60_000)
    rows = repository.load(spark, {"demo": str(tmp_path)})
    assert rows.rdd.getNumPartitions() >= 16
    small = repository.load(spark, {"demo": str(tmp_path)}, rowBytes=10_007, partitionBytes=200_000).filter("path = 'mixed.txt'")
    assert small.rdd.getNumPartitions() > 4
    seen = small.agg(F.max(F.octet_length("text")), F.count("text"), F.max("n_parts"), F.count("error")).first()
    assert seen[0] <= 10_010 and seen[1] == seen[2] == -(-os.path.getsize(tmp_path / "mixed.txt") // 10_007) and seen[3] == 0
    text = repository.whole_files(small).first().text
    assert hashlib.md5(text.encode()).hexdigest() == hashlib.md5((tmp_path / "mixed.txt").read_bytes()).hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60), st.integers(4, 9))
def test_parts_cover_a_text_once(text, size):
    data = text.encode()
    n = max(1, -(-len(data) // size))
    parts = [repository.read_part(io.BytesIO(data), size, i, n) for i in range(n)]
    assert b"".join(parts) == data and "".join(p.decode() for p in parts) == text


def test_manifest_in_place_of_a_listing(spark, tmp_path):
    tree, stored = tmp_path / "tree", str(tmp_path / "manifest")
    make_tree(str(tree))
    (tree / "long.txt").write_text("x" * 50_000)
    repository.write_manifest(spark, {"demo": str(tree)}, stored, F.col("path") != "README.md", partition_bytes=100_000, row_bytes=1000)
    read = spark.read.format("repository").option("manifest", stored).option("rowBytes", 1000).load()
    listed = repository.load(spark, {"demo": str(tree)}, rowBytes=1000).filter("path <> 'README.md'")
    assert read.rdd.getNumPartitions() > 4
    assert sorted(map(str, read.collect())) == sorted(map(str, listed.collect()))
    assert read.filter("extension = '.java'").count() == 1
    with pytest.raises(Exception, match="write a manifest"):
        repository.load(spark, {"demo": str(tree)}, maxFiles=3).count()


def test_broken_and_missing_input(spark, tmp_path):
    make_tree(str(tmp_path))
    os.symlink(tmp_path / "nowhere", tmp_path / "lost.txt")
    rows = {r.path: r for r in repository.load(spark, {"demo": "file:" + str(tmp_path)}).collect()}
    assert rows["bad.py"].error == "invalid utf-8" and rows["bad.py"].text is None and rows["venv/x.py"].text == ""
    assert "lost.txt" not in rows or rows["lost.txt"].error
    assert repository.load(spark, {"none": str(tmp_path / "absent")}).count() == 0
    assert spark.read.format("repository").load(str(tmp_path)).first().repo == tmp_path.name


def named(spark, rows):
    return spark.createDataFrame(rows, "file string, n int, text string").repartition(5)


def test_files_are_written_whole_and_in_order(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = [("a.md", i, f"line {i}\n") for i in range(200)] + [("b.json", 1, ' 1}'), ("b.json", 0, '{"x":'), ("empty.txt", 0, None)]
    text_files.write_files(named(spark, rows), root, ["n"])
    assert sorted(os.listdir(root)) == ["a.md", "b.json", "empty.txt"]
    assert open(f"{root}/a.md").read() == "".join(f"line {i}\n" for i in range(200)) and json.load(open(f"{root}/b.json")) == {"x": 1}
    text_files.write_files(named(spark, [("a.md", 0, "new")]), root, ["n"])
    assert open(f"{root}/a.md").read() == "new" and len(os.listdir(root)) == 3
    text_files.write_files(named(spark, [("c.md", 0, "only")]), root, ["n"], overwrite=True)
    assert os.listdir(root) == ["c.md"]


@pytest.mark.parametrize("name", ["../up.md", "a/b.md", "", None, "_hidden", ".dot"])
def test_a_failed_job_leaves_nothing(spark, tmp_path, name):
    root = str(tmp_path / "out")
    text_files.write_files(named(spark, [("kept.md", 0, "old")]), root, ["n"])
    rows = [(f"f{i}.md", 0, "x") for i in range(50)] + [("kept.md", 0, "new"), (name, 0, "never")]
    with pytest.raises(Exception):  # noqa: B017
        text_files.write_files(named(spark, rows), root, ["n"])
    assert os.listdir(root) == ["kept.md"] and open(f"{root}/kept.md").read() == "old"


def test_commit_refuses_a_file_from_two_tasks(tmp_path):
    writer = text_files.TextFilesWriter(str(tmp_path), False)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"file": "a", "text": "1"}])
    done = [writer.write(iter([batch])), writer.write(iter([batch]))]
    with pytest.raises(ValueError, match="several tasks"):
        writer.commit(done)
    writer.abort(done)
    assert os.listdir(tmp_path) == []
    with pytest.raises(ValueError, match="follow"):
        writer.write(iter([pa.RecordBatch.from_pylist([{"file": f, "text": "1"} for f in "aba"])]))


def test_wikis_that_share_a_name(spark, tmp_path):
    pages = spark.createDataFrame([(w, f"p{i}", "T", f"text {w} {i}", ["f"], "high", [], i) for w in ("x/1", "y", "z") for i in range(3)],
                                  "wiki_id string, id string, title string, content string, file_paths array<string>, importance string, related_pages array<string>, pos int")
    url = F.when(F.col("wiki_id") == "z", "https://h/o/other").otherwise("https://h/o/same")
    store.export_wikis(wiki.json_parts(pages, url, F.lit("now"), 2), pages, url, F.lit("T0"), "json", str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == ["other_wiki_T0.json", "same_wiki_T0_x_1.json", "same_wiki_T0_y.json"]
    read = json.load(open(tmp_path / "same_wiki_T0_y.json"))
    assert [p["content"] for p in read["pages"]] == ["text y 0", "text y 1", "text y 2"] and read["metadata"]["page_count"] == 3


@pytest.mark.parametrize("name", ["a1_repository_format", "a13_exported_files", "a13_exported_json", "a8_exported_records"])
def test_queries_equal_sql(spark, name):
    assert difference(all_queries()[name](spark, SF), connect(SF), all_oracles()[name]) is None
