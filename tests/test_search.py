import numpy as np
import pytest
from pyspark.sql import functions as F

from repoloom.operators import pruned_search as ps
from repoloom.operators import embedding as em
from repoloom.operators import search as se


def vectors(n, d, seed):
    return np.random.default_rng(seed).integers(-3, 4, (n, d)).astype("float64")


@pytest.mark.parametrize("limit", [10**9, 60])
def test_top_k_equals_brute_force(spark, limit):
    corpus, asked, k = vectors(300, 6, 1), vectors(11, 6, 2), 7  # small integers: many ties
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "vec_id long, vector array<double>").repartition(5)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, query_vector array<double>")
    got = se.top_k(c, q, k, max_broadcast_values=limit).orderBy("query_id", "rank").collect()
    for i, v in enumerate(asked):
        scores = corpus @ v
        best = sorted(range(len(corpus)), key=lambda j: (-scores[j], j))[:k]
        mine = [r for r in got if r.query_id == i]
        assert [r.vec_id for r in mine] == best
        assert [r.score for r in mine] == [scores[j] for j in best]


def test_top_k_beyond_corpus_size_gives_fewer_rows(spark):
    c = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, vector array<double>")
    q = spark.createDataFrame([(0, [1.0])], "query_id long, query_vector array<double>")
    assert [r.vec_id for r in se.top_k(c, q, 30).orderBy("rank").collect()] == [1, 0]


def test_failed_vectors_take_no_part(spark):
    c = spark.createDataFrame([(0, [1.0]), (1, None), (2, [])], "vec_id long, vector array<double>")
    q = spark.createDataFrame([(0, [1.0]), (1, []), (2, None)], "query_id long, query_vector array<double>")
    assert [(r.query_id, r.vec_id) for r in se.top_k(c, q, 5).collect()] == [(0, 0)]


def test_majority_size_and_ties(spark):
    def kept(sizes):
        rows = [(i, None if s is None else [1.0] * s) for i, s in enumerate(sizes)]
        df = spark.createDataFrame(rows, "vec_id long, vector array<float>")
        return sorted(r.vec_id for r in em.majority_size(df).collect())

    assert kept([4, 4, 2, 2, 0, None]) == [0, 1]
    assert kept([4, 2, 2, 4, 2]) == [1, 2, 4]
    assert kept([None, 0]) == []


def test_embedding_does_not_depend_on_partitions_and_survives_errors(spark):
    df = spark.createDataFrame([(i, f"a b{i} c{i % 3}") for i in range(40)], "id long, text string")
    one = em.embed_texts(df.repartition(1), lambda: em.hashing_embedder(32), batch=7)
    many = em.embed_texts(df.repartition(6), lambda: em.hashing_embedder(32), batch=3)
    assert {r.id: r.vector for r in one.collect()} == {r.id: r.vector for r in many.collect()}

    def fragile():
        def fn(texts):
            if any("b13" in t for t in texts):
                raise RuntimeError("no service")
            return [[1.0, 0.0]] * len(texts)

        return fn

    rows = em.embed_texts(df.coalesce(1), fragile, batch=5).withColumn("run", F.lit(1))
    stats = em.embedding_stats(rows, ["run"]).first()
    assert (stats.total, stats.valid, stats.empty, stats.failed) == (40, 35, 5, 5)


def test_context_block(spark):
    hits = spark.createDataFrame(
        [(1, 1, "b.py", "B1"), (1, 2, "a.py", "A"), (1, 3, "b.py", "B2")], "query_id long, rank int, file_path string, text string"
    )
    assert se.context_blocks(hits).first().context_text == (
        "\n\n----------## File Path: b.py\n\nB1\n\nB2\n\n## File Path: a.py\n\nA"
    )


def test_question_retrieval_equals_brute_force(spark):
    from repoloom.plans import all_queries
    from repoloom.operators.chunking import word_chunks
    from repoloom.plans.views import table

    sf = "/root/testdata/sf0.001"
    got = all_queries()["u1_question_retrieval"](spark, sf).toPandas()
    fn = em.hashing_embedder()
    chunks = word_chunks(table(spark, sf, "documents").select("doc_id", "text")).toPandas()
    ids = (chunks.doc_id * (chunks.chunk_no.max() + 1) + chunks.chunk_no).to_numpy()
    corpus = np.asarray(fn(list(chunks.text)), dtype="float32").astype("float64")
    asked = table(spark, sf, "benchmark").toPandas()
    queries = np.asarray(fn(list(asked.text)), dtype="float32").astype("float64")
    for i, v in zip(asked.item_id, queries):
        scores = np.round(corpus @ v, 6)
        best = sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j]))[:30]
        mine = got[got.query_id == i].sort_values("rank")
        assert list(mine.vec_id) == [ids[j] for j in best]


def test_embedding_cache(spark):
    def make():
        return em.hashing_embedder(8)

    empty = spark.createDataFrame([], "model string, text_hash string, vector array<float>")
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "id long, text string")
    rows, fresh = em.embed_cached(df, empty, "m", make)
    assert fresh.count() == 2 and rows.filter("vector IS NOT NULL").count() == 3
    again, none = em.embed_cached(df, fresh, "m", make)
    assert none.count() == 0 and {r.id: r.vector for r in again.collect()} == {r.id: r.vector for r in rows.collect()}
    assert em.embed_cached(df, fresh, "other", make)[1].count() == 2


def clustered(n, dims=8, groups=12, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims)) * 4
    return {i: (centres[i % groups] + rng.normal(size=dims) * 0.2).astype("float32").tolist() for i in range(n)}


def test_pruned_search_equals_the_full_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ps, "QUERY_ROWS", 16)
    monkeypatch.setattr(ps, "HELD_VALUES", 4000)
    vectors = clustered(3000)
    vectors |= {5000 + i: vectors[7] for i in range(500)}  # one vector many times: ties, and a pivot of its own
    rows = list(vectors.items()) + [(9000, None), (9001, [])]
    corpus = spark.createDataFrame(rows, "vec_id long, vector array<float>")
    queries = spark.createDataFrame([(i, vectors[i * 31]) for i in range(60)] + [(100, [0.0] * 8), (101, None), (102, [])], "query_id long, query_vector array<double>")
    ps.write_balls(corpus, str(tmp_path / "balls"), block_rows=40)
    stored = spark.read.parquet(str(tmp_path / "balls"))
    assert stored.select(F.max(F.size("ids")), F.sum(F.size("ids"))).first()[:] == (40, 3500)
    compared, pairs = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    key = lambda df: sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())
    got = key(ps.search(spark, str(tmp_path / "balls"), queries, 10, compared, pairs))
    assert got == key(se.top_k(corpus, queries, 10)) and len(got) == 610
    assert pairs.value == 61 * stored.count() and compared.value < 0.5 * pairs.value


def test_pruned_search_of_few_and_no_vectors(spark, tmp_path):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, vector array<float>")
    queries = spark.createDataFrame([(5, [1.0, 0.5])], "query_id long, query_vector array<double>")
    ps.write_balls(corpus, str(tmp_path / "a"))
    assert [(r.vec_id, r["rank"], r.score) for r in ps.search(spark, str(tmp_path / "a"), queries, 5).orderBy("rank").collect()] == [(1, 1, 1.0), (2, 2, 0.5)]
    assert ps.search(spark, str(tmp_path / "a"), queries.filter("false"), 5).count() == 0
    ps.write_balls(corpus.filter("false"), str(tmp_path / "b"))
    assert ps.search(spark, str(tmp_path / "b"), queries, 5).count() == 0


def test_bounds_leave_out_most_balls_of_clustered_vectors():
    vectors = np.array(list(clustered(4000, groups=40).values()), dtype="float64")
    order = np.argsort([i % 40 for i in range(4000)], kind="stable")
    balls = []
    for ids in np.array_split(order, 40):
        centre = vectors[ids].mean(0)
        balls.append((centre, float(np.sqrt(((vectors[ids] - centre) ** 2).sum(1).max())), ids, vectors[ids]))
    queries = vectors[::97]
    scores, ids, compared = ps.best_hits(queries, balls, 10)
    full = np.round(queries @ vectors.T, 6)
    for q in range(len(queries)):
        want = np.lexsort((np.arange(4000), -full[q]))[:10]
        assert ids[q].tolist() == want.tolist() and np.array_equal(scores[q], full[q][want])
    assert compared < 0.2 * len(queries) * len(balls)
