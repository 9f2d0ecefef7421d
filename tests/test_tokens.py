"""Byte-pair counts against a reference encoding and a plain merge loop."""

import base64
import random

import pytest
from pyspark.sql import functions as F

import public_tokenizers
from oracle_check import connect, difference
from repoloom.operators import filters
from repoloom.operators import tokens as tk
from repoloom.plans import all_oracles, all_queries

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "a", "x" * 5000, "ab" * 4000, "漢字 é😀\r\n\t  a'b we'll WE'LL 12345  　x", "\n\n  \n def f(x):\n\treturn x**2  ", "<|endoftext|>", "\x00\x01"]


@pytest.fixture(scope="module")
def ranks(spark):
    return tk.read_ranks(spark, "file://" + public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference(ranks):
    import tiktoken

    return tiktoken.Encoding("reference", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_of_all_documents(spark, reference):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.tokens for r in all_queries()["u4_vocabulary_counts"](spark, SF).collect()}
    assert got == {i: len(reference.encode_ordinary(t)) for i, t in texts.items()}


def test_ids_and_counts_of_odd_texts(spark, ranks, reference):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, None])], "i int, text string")
    rows = df.select("i", tk.token_ids(spark, ranks)(F.col("text")).alias("ids"), tk.token_counts(spark, ranks)(F.col("text")).alias("n")).collect()
    assert {r.i: r.ids for r in rows} == {i: reference.encode_ordinary(t or "") for i, t in enumerate([*ODD, None])}
    assert all(len(r.ids) == r.n for r in rows)


def test_merge_against_a_plain_loop():
    def plain(word, ranks):
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            least = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 30), i))
            if parts[least] + parts[least + 1] not in ranks:
                break
            parts[least : least + 2] = [parts[least] + parts[least + 1]]
        return parts

    rng = random.Random(4)
    for _ in range(300):
        pieces = {"".join(rng.choice("ab") for _ in range(rng.randint(2, 4))) for _ in range(8)}
        ranks = tk.byte_ranks(rng.sample(sorted(pieces), len(pieces)))
        word = "".join(rng.choice("abc") for _ in range(rng.randint(0, 30))).encode()
        assert tk.merge(word, ranks) == ([word] if word in ranks else plain(word, ranks))


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(tk, "REMEMBERED", 10)
    own = tk.BytePairs(tk.byte_ranks(["th", "he"]))
    assert own.count(" ".join(f"w{i}" for i in range(500)) + " " + "y" * 100) == len(own.ids(" ".join(f"w{i}" for i in range(500)) + " " + "y" * 100))
    assert len(own.counts) <= 10 and all(len(w) <= tk.LONGEST_REMEMBERED for w in own.counts)


def test_vocabulary_has_a_bound(spark, monkeypatch, tmp_path):
    (tmp_path / "v").write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" %d" % i for i in range(20)) + b"\n\n")
    assert tk.read_ranks(spark, f"file://{tmp_path}/v") == {bytes([i]): i for i in range(20)}
    monkeypatch.setattr(tk, "MAX_ENTRIES", 19)
    with pytest.raises(ValueError):
        tk.read_ranks(spark, f"file://{tmp_path}/v")


def test_size_gate_takes_exact_counts(spark, ranks, reference):
    files = spark.createDataFrame([("a.py", "def f(): pass"), ("b.py", "x = 1\n" * 40), ("c.md", "# note")], "path string, text string")
    gated = filters.size_gate(filters.classify(files), tk.token_counts(spark, ranks)(F.col("text")), 20, 20)
    assert {r.path: r.token_count for r in gated.collect()} == {"a.py": len(reference.encode_ordinary("def f(): pass")), "c.md": len(reference.encode_ordinary("# note"))}


@pytest.mark.parametrize("name", ["u4_byte_pair_counts", "b4_exact_size_gate", "b8_exact_oversize_questions"])
def test_queries_equal_sql(spark, name):
    assert difference(all_queries()[name](spark, SF), connect(SF), all_oracles()[name]) is None


def test_workers_take_texts_one_at_a_time(spark):
    """A batch stays in Arrow's form; as pandas objects a worker held every text of it twice."""
    import tracemalloc

    from pyspark.util import PythonEvalType

    from repoloom.operators import chunking, tokens

    ranks = tokens.byte_ranks(["an"])
    kinds = {tokens.token_counts(spark, ranks).evalType, tokens.token_ids(spark, ranks).evalType}
    assert kinds == {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}
    assert chunking.token_counter(list).evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF
    text = "word " * 400_000
    tracemalloc.start()
    assert sum(1 for _ in chunking.each_chunk(text)) > 1000
    assert tracemalloc.get_traced_memory()[1] < 1_000_000
    tracemalloc.stop()


def test_chunks_go_out_in_bounded_batches(spark, monkeypatch):
    from repoloom.operators import chunking

    monkeypatch.setattr(chunking, "OUTPUT_ROWS", 2)
    rows = [(i, f"s{i}", None if i % 5 == 0 else ("w%d " % i) * (i * 7)) for i in range(40)] + [(None, None, "a b c " * 30)]
    df = spark.createDataFrame(rows, "n long, s string, text string")
    plan = chunking.character_chunks(df, size=60, overlap=9)
    assert "MapInArrow" in plan._jdf.queryExecution().executedPlan().toString()
    want = [(n, s, i, c) for n, s, t in rows for i, c in enumerate(chunking.split_characters(t or "", 60, 9))]
    assert sorted(map(tuple, plan.collect()), key=str) == sorted(want, key=str) and len(want) > 100


def test_texts_reach_workers_in_bounded_slices(spark, monkeypatch):
    """Whole texts in rows made a batch as large as 10,000 texts or 64 MB, of which a worker held two."""
    from repoloom.operators import chunking

    rows = [(i, f"s{i}", ("é€😀w%d\n" % i) * (i * 40) + "x" * (i * 30)) for i in range(20)] + [(7, None, None), (None, "s", ""), (7, "a", "a b"), (8, "z", "é" * 250), (9, "z", "y" * 500)]
    df = spark.createDataFrame(rows, "n long, s string, text string")
    sent, real = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a, **k: sent.append(self) or real(self, *a, **k))
    want = sorted(((n, s, i, c) for n, s, t in rows for i, c in enumerate(chunking.split_characters(t or "", 60, 9))), key=str)
    for most in ("3", "10000"):  # texts that go over several batches, and batches of several texts
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        try:
            got = chunking.character_chunks(df, size=60, overlap=9).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted(map(tuple, got), key=str) == want and len(want) > 100
    held = [len(v.encode() if isinstance(v, str) else v) for r in sent[0].collect() for v in r if isinstance(v, str | bytes | bytearray)]
    assert max(held) <= 500 and max(len(t or "") for _, _, t in rows) > 5000
