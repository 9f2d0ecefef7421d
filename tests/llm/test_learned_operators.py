"""Language identification against a dictionary model, and the recall of a tree that is searched in part."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from repoloom.llm import kmeans_tree, queries

SF = "/root/testdata/sf0.001"
M32 = (1 << 32) - 1


def grams(text, buckets):
    """Buckets of all pairs and triples, one by one."""
    codes = [ord(c) for c in f" {text.lower()} "]
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        pair = (a * 0x9E3779B1 + b * 0x85EBCA77) & M32
        triple = (pair * 0xC2B2AE3D + c * 0x27D4EB2F + 0x165667B1) & M32
        yield (pair ^ pair >> 15) % buckets
        yield (triple ^ triple >> 15) % buckets


def test_language_id_against_a_dictionary_model(spark):
    buckets = 1 << 16
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in docs}
    counts, seen = collections.defaultdict(collections.Counter), collections.Counter()
    for i, text, lang in docs:
        if not held[i] and lang is not None and any(c.isalpha() for c in text or ""):
            counts[lang].update(grams(text, buckets))
            seen[lang] += 1
    sums = {x: sum(c.values()) + 0.5 * buckets for x, c in counts.items()}
    got = {r.doc_id: r for r in queries.QUERIES["op2_language_id"](spark, SF).collect()}
    assert set(got) == {i for i, _, _ in docs}
    for i, text, _ in docs:
        if not any(c.isalpha() for c in text or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        mine = collections.Counter(grams(text, buckets))
        total = {x: math.log(seen[x] / sum(seen.values())) + sum(n * math.log((c[g] + 0.5) / sums[x]) for g, n in mine.items()) for x, c in counts.items()}
        best = min(total, key=lambda x: (-total[x], x))
        assert got[i].lang_pred == best and got[i].held_out == held[i]
        assert got[i].score == pytest.approx(1 / sum(math.exp(t - total[best]) for t in total.values()), abs=1e-6)


def test_recall_of_a_tree_that_is_visited_in_part(spark, monkeypatch):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(60, 16)) * 3
    points = centres[rng.integers(0, 60, 20_000)] + rng.normal(size=(20_000, 16))
    visits = []
    monkeypatch.setattr(kmeans_tree.Tree, "visits_for", lambda self, *a, f=kmeans_tree.Tree.visits_for: visits.append((f(self, *a), self)) or visits[-1][0])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>").repartition(8)
    got = collections.defaultdict(list)
    for r in kmeans_tree.nearest(df, F.col("vec_id") % 100 == 0, leaf_rows=100).collect():
        got[r.query_id].append(r.vec_id)
    hits = 0
    for q in range(0, 20_000, 100):
        d = ((points - points[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(set(np.argsort(d, kind="stable")[:10].tolist()) & set(got[q]))
    leaves = visits[0][1].leaves
    print(f"recall {hits / 2000}, {visits[0][0]} of {leaves} leaves")
    assert hits >= 0.9 * 2000 and leaves > 100 and visits[0][0] < 0.5 * leaves
