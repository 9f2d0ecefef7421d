"""Nearest vectors against brute force, the pipeline against its parts, and the registry."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from repoloom.llm import kmeans_tree, near_dups, queries

SF = "/root/testdata/sf0.001"


def brute(vectors, ask, k):
    out = {}
    for q in [i for i in sorted(vectors) if ask(i)]:
        d = sorted((float(np.sqrt(((np.array(v) - np.array(vectors[q])) ** 2).sum())), i) for i, v in vectors.items() if i != q)
        out[q] = d[:k]
    return out


def test_nearest_recall_and_exact_scores(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = {r.vec_id: [float(x) for x in r.embedding] for r in df.collect()}
    want = brute(vectors, lambda i: i % 100 == 0, 10)
    got = collections.defaultdict(list)
    for r in queries.QUERIES["op9_nearest_vectors"](spark, SF).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert set(got) == set(want) and all(len(x) == 10 for x in got.values()) and hits >= 0.9 * 10 * len(want)
    for q, found in got.items():
        assert found == sorted(found)
        for s, i in found:
            assert s == pytest.approx(np.linalg.norm(np.array(vectors[i]) - np.array(vectors[q])), rel=1e-12)


def test_nearest_in_blocks_with_hot_vectors(spark, monkeypatch):
    monkeypatch.setattr(kmeans_tree, "BLOCK", 16)
    rng = np.random.default_rng(2)
    vectors = {i: ([1.0, 2.0, 3.0] if i % 3 == 0 else rng.normal(size=3).round(3).tolist()) for i in range(300)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in kmeans_tree.nearest(df, F.col("vec_id") % 50 == 0, leaf_rows=20, target=1.0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    want = brute(vectors, lambda i: i % 50 == 0, 10)
    assert [i for _, i in got[0]] == [i for _, i in want[0]] == list(range(3, 33, 3))  # ties go to smaller ids
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_nearest_edges(spark):
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, [1.0, 0.5]), (8, [1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("v", "q", "leaf", "score", "rank", "b", "c")})
    got = [tuple(r) for r in kmeans_tree.nearest(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 8), (0, 2, 100), (100, 1, 8), (100, 2, 0)]
    assert kmeans_tree.nearest(df.filter("false"), F.lit(True)).count() == 0


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Output of each stage by name, each from what its predecessor wrote."""
    folder, docs, out = str(tmp_path_factory.mktemp("stages")), spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def test_stages_hand_documents_on(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_duplicates", "substring_dedup", "packing"]
    for n in names[:-1]:
        assert stages[n].columns == stages["documents"].columns
    counts = [stages[n].count() for n in ("documents", *names[:-1])]
    assert counts[0] > counts[1] == counts[2] > counts[3] == counts[4] > 0.5 * counts[0]
    # No stage leaves a document without text behind.
    had = {r.doc_id for r in stages["documents"].collect() if (r.text or "").strip()}
    for n in names[:-1]:
        assert not [r.doc_id for r in stages[n].collect() if r.doc_id in had and not r.text.strip()], n


def test_near_duplicate_stage_against_all_pairs(stages):
    from test_text_operators import components

    before = {r.doc_id: r.text for r in stages["line_dedup"].collect()}
    kept = {d for d, c in components(before, 5, 80)[0].items() if c == d}
    assert {r.doc_id for r in stages["near_duplicates"].collect()} == kept


def test_packed_tokens_are_the_documents(stages):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    got = collections.defaultdict(list)
    for r in stages["packing"].orderBy("doc_id", "start").collect():
        got[r.doc_id] += r.ids
    assert got == {r.doc_id: tok.encode(r.text, add_special_tokens=False).ids + [0] for r in stages["substring_dedup"].collect()}


def test_run_equals_the_stages(spark, stages):
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    ours, theirs = key(corpus_pipeline.run(spark, SF)), key(stages["packing"])
    assert sum(x[2] for x in ours) == sum(x[2] for x in theirs) and {x[0] for x in ours} == {x[0] for x in theirs}


def test_stages_on_odd_and_empty_rows(spark):
    rows = [(None, "orphan words " * 20, None, None, None, 1), (1, None, None, None, None, 2), (2, "", "en", "s", 0, 3), (3, "plain words only here", "en", "s", 9, 4), (3, "plain words only here", "en", "s", 9, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept int")
    for df, n in ((docs, 5), (docs.filter("false"), 0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, SF)
            assert df.columns == docs.columns
        assert df.count() == n
        packed = corpus_pipeline.STAGES[-1][1](spark, df, SF)
        assert packed.agg(F.sum("length")).first()[0] == (sum(r["doc_tokens"] for r in packed.filter("start = 0").collect()) if n else None)


def test_stages_beside_columns_of_their_results(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit("clash") for c in ("n_removed", "removed_chars", "kept_in", "score", "component_id")})
    df = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, SF)
        assert df.columns == docs.columns, name
    assert 0 < df.count() < docs.count() and df.filter("n_removed <> 'clash'").count() == 0


def test_registry():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(sum(q.startswith(f"op{n}_") for q in names) == 1 for n in range(1, 14))
    assert near_dups.SLOTS % near_dups.ROWS == 0
