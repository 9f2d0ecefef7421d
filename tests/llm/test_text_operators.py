"""Brute-force and edge-case tests of the operators on texts."""

import array
import collections
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle_check import connect, difference
from repoloom.llm import chunk_dedup, language, line_dedup, line_quality, near_dups, nbest, packing, preference, queries, toxicity
from repoloom.llm.words import words_of

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and extra columns with names the operators use."""
    rows = [(1, "some words here again and again to be kept as they are", "en", "a", 5), (None, "orphan text " * 30, "en", None, None), (2, None, None, "a", None)]
    rows += [(3, "", "de", None, 0), (4, " \n\t ", None, "a", 4), (5, "word " * 60_000, "en", "a", 300_000), (6, "x" * 70_000, "fr", "b", 70_000)]
    rows += [rows[0], rows[0], (7, "a'b  c\n\n d<|endoftext|>́ é漢字 😀\r\n", "es", "b", 9)]
    df = spark.createDataFrame(rows, DOC)
    for name in ("score", "kept", "key", "n", "words", "first", "place", "id", "comp", "node", "host", "lines"):
        df = df.withColumn(name, F.lit("clash"))
    return df


# ---------------------------------------------------------------- 1 preference formatting


def test_preference_equals_sql(spark):
    con = connect(SF)
    assert difference(queries.QUERIES["op1_preference_pairs"](spark, SF), con, queries.ORACLES["op1_preference_pairs"]) is None


def render(role, text):
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


@pytest.mark.parametrize("hot", [1000, 3])
def test_preference_by_hand(spark, monkeypatch, hot):
    monkeypatch.setattr(preference, "HOT_TURNS", hot)
    a = [("user", "hi"), ("assistant", "yes"), ("user", "more"), ("assistant", "good")]
    b = [("user", "hi"), ("assistant", "yes"), ("assistant", "bad"), (None, None)]
    rows = [(1, s, i, *t) for s, turns in (("chosen", a), ("rejected", b)) for i, t in enumerate(turns)]
    rows += [(2, s, i, "user", str(i)) for s in ("chosen", "rejected") for i in range(5)]  # equal sides
    rows += [(3, "rejected", 9, "assistant", "only"), (None, "chosen", 0, "user", "x"), (4, "chosen", None, "user", "x"), (5, "other", 0, "user", "x")]
    rows += [rows[0], rows[0]]
    df = spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string").withColumn("pos", F.lit("clash"))
    got = {(r.pair_id, r.segment, r.part_no): r for r in preference.format_pairs(df, part_turns=2).collect()}
    text = collections.defaultdict(str)
    for k in sorted(got):
        text[k[:2]] += got[k].text
    assert text[(1, "prompt")] == render(*a[0]) + render(*a[1])
    assert text[(1, "chosen")] == render(*a[2]) + render(*a[3]) and text[(1, "rejected")] == render(*b[2]) + render("unknown", "")
    assert text[(2, "prompt")] == "".join(render("user", str(i)) for i in range(5)) and (2, "chosen", 0) not in got and len([k for k in got if k[0] == 2]) == 3
    assert text[(3, "rejected")] == render("assistant", "only") and (3, "prompt") not in text
    assert {k[0] for k in got} == {1, 2, 3}
    trained = ["".join(r.text[x.start : x.end] for x in r.spans) for k, r in got.items() if k[:2] in ((1, "chosen"), (1, "rejected"), (1, "prompt"))]
    assert sorted(trained) == ["", "bad<|im_end|>\n", "good<|im_end|>\n"]
    assert preference.format_pairs(df.filter("false")).count() == 0


# ---------------------------------------------------------------- 2 language


def test_language_held_out_accuracy(spark, docs):
    got = queries.QUERIES["op2_language_id"](spark, SF).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)


def test_language_edges_and_slices(spark, docs, odd, monkeypatch):
    model = language.fit(docs)
    got = language.identify(odd, model, F.lit(None).cast("boolean")).collect()
    assert len(got) == odd.count()
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {2, 3, 4} and not any(r.held_out for r in got)
    texts = [r.text for r in docs.limit(40).collect()]
    whole = model.predict(texts)
    monkeypatch.setattr(language, "CHUNK", 50)  # many chunks give the same sums
    cut = model.predict(texts)
    assert whole[0] == cut[0] and np.allclose(whole[1], cut[1])
    assert whole[0] == [model.predict([t])[0][0] for t in texts]
    empty = language.fit(docs.filter("false"))
    assert empty.predict(["abc"]) == (["und"], [0.0]) and language.identify(docs.filter("false"), model, F.lit(True)).count() == 0


# ---------------------------------------------------------------- 3 chunks


def test_gear_hash_and_cuts_against_a_loop():
    rng = random.Random(3)
    text = " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(3000)).encode()
    h, hashes = 0, []
    for b in text:
        h = ((h << 1) + int(chunk_dedup.GEAR[b])) & 0xFFFFFFFF
        hashes.append(h)
    assert (chunk_dedup.gear_hashes(np.frombuffer(text, np.uint8)) == np.array(hashes, np.uint32)).all()
    want, last = [], 0
    for i, b in enumerate(text):
        if i + 1 - last >= 200 or (i + 1 - last >= 24 and b == 0x20 and hashes[i] >> 30 == 0):
            want.append(i + 1)
            last = i + 1
    if last < len(text):
        want.append(len(text))
    other = b"before " * 9
    assert chunk_dedup.chunk_ends([other, text, b"", text], 2, 24, 200)[1::2] == [want, want]


def test_passages_are_found_after_insertions(spark):
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(n))
    passage = words(60)
    rows = [(i, words(40) + " " + passage + " " + words(30 + i), None, None, None) for i in range(30)] + [(100 + i, words(80), None, None, None) for i in range(30)]
    df = spark.createDataFrame(rows, DOC)
    got = {r.doc_id: r for r in chunk_dedup.dedup_chunks(df).collect()}
    assert got[0].text == rows[0][1] and got[0].kept_in == []
    for i in range(1, 30):
        assert passage not in got[i].text and got[i].removed_chars > 150 and 0 in got[i].kept_in
        assert got[i].text.startswith(rows[i][1][:100]) and got[i].text.endswith(rows[i][1][-100:])
    assert all(got[100 + i].text == rows[30 + i][1] and not got[100 + i].n_removed for i in range(30))


def test_passages_without_white_space():
    rng = random.Random(5)
    for alphabet in ([chr(c) for c in range(0x4E00, 0x5200)], "abcdefgh(){};=", ["\u00e9", "t\u00a0", "n\u3000", "a", "b"]):
        made = lambda n: "".join(rng.choices(alphabet, k=n)).encode()
        passage = made(400)
        left, right = made(700) + passage + made(500), made(913) + passage + made(411)
        found = []
        for text in (left, right):
            ends = chunk_dedup.chunk_ends([b"some other text", text, b""], 2, 24, 1024)[1]
            found.append({text[a:b] for a, b in zip([0, *ends], ends)})
            assert b"".join(text[a:b] for a, b in zip([0, *ends], ends)) == text and all(text[a:b].decode() for a, b in zip([0, *ends], ends))
        assert sum(map(len, found[0] & found[1])) > 0.6 * len(passage)


def test_chunks_against_brute_force(spark, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    seen, want = {}, {}
    for d in sorted(texts):
        data, at, runs = texts[d].encode(), 0, []
        own = set()
        for e in chunk_dedup.chunk_ends([data], 2, 24, 1024)[0]:
            c = data[at:e]
            if c in seen or c in own:
                if runs and runs[-1][1] == at:
                    runs[-1][1] = e
                else:
                    runs.append([at, e])
            own.add(c)
            at = e
        for c in own:
            seen.setdefault(c, d)
        for a, b in reversed([r for r in runs if r[1] - r[0] >= 100]):
            data = data[:a] + data[b:]
        want[d] = data.decode()
    got = {r.doc_id: r.text for r in chunk_dedup.dedup_chunks(docs).collect()}
    assert got == want and sum(len(t) for t in got.values()) < sum(len(t) for t in texts.values())


def test_chunk_edges(spark, odd):
    got = chunk_dedup.dedup_chunks(odd).collect()
    assert len(got) == odd.count() and sum(r.doc_id == 1 and r.n_removed == 0 for r in got) == 3 and {r.score for r in got} == {"clash"}
    assert sum(r.text is None for r in got) == 1 and chunk_dedup.dedup_chunks(odd.filter("false")).count() == 0


def test_chunk_ends_lie_inside_their_text():
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789é漢"
    texts = ["".join(rng.choice(letters + " " * rng.choice([0, 0, 9])) for _ in range(rng.choice([1, 30, 250, 256, 300, 1000, 1024, 1056, 2080, 5000]))).encode() for _ in range(400)]
    for t, ends in zip(texts, chunk_dedup.chunk_ends(texts, 2, 24, 1024)):
        assert ends[-1] == len(t) and all(0 < b - a <= 1024 for a, b in zip([0, *ends], ends))
        b"".join(t[a:b].decode().encode() for a, b in zip([0, *ends], ends))


def test_chunk_results_beside_columns_of_their_names(spark):
    text = "A passage of more than one hundred bytes that two documents share, word by word, up to its very end, and even behind it."
    df = spark.createDataFrame([(1, text, 7, "x"), (2, text, 8, "y")], "doc_id long, text string, n_removed int, kept_in string")
    got = {r.doc_id: r for r in chunk_dedup.dedup_chunks(df).collect()}
    assert (got[2].n_removed, got[2].kept_in, got[2].n_removed_, got[2].kept_in_) == (8, "y", 1, [1]) and got[2].removed_chars > 0 and got[1].n_removed_ == 0


def test_lines_of_whole_copies_are_spared(spark):
    story = [" ".join(f"w{i}x{j}" for j in range(9)) for i in range(10)]
    rows = [(1, "\n".join(story)), (2, "\n".join(story)), (3, "\n".join([*story[:9], "An end of its own."])), (4, "\n".join([*story[:2], "Much more of its own than of others.", "And still more."])), (5, story[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df, spare=0.8).collect()}
    assert all(got[i] == texts[i] for i in (1, 2, 3, 5)) and got[4] == "\n".join(texts[4].split("\n")[2:])
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()} == {1: texts[1], 2: "", 3: "An end of its own.", 4: got[4], 5: ""}


# ---------------------------------------------------------------- 4 quality rules


@pytest.mark.filterwarnings("ignore")
def test_quality_equals_sql(spark):
    con = connect(SF)
    assert difference(queries.QUERIES["op4_line_quality"](spark, SF), con, queries.ORACLES["op4_line_quality"]) is None


def test_quality_rules_by_hand(spark, odd):
    rows = [(i, f"Accept all  cookies now\nstory {i} has its own words", None, "host", None) for i in range(12)]
    rows += [(50, "accept ALL cookies now\nshort end", None, "host", None), (51, "accept all cookies now " * 1, None, None, None)]
    rows += [(60, "a b c d e f g h i j a b c d e f g", None, "z", None)]
    got = {r.doc_id: r for r in line_quality.quality_rules(spark.createDataFrame(rows, DOC), min_docs=10, min_words=3, least_kept=0.5).collect()}
    assert all(got[i].removed_words == 4 and got[i].kept for i in range(12))
    assert got[50].removed_words == 4 and not got[50].kept and not got[50].base_failed and got[51].removed_words == 0
    assert got[60].n_repeat_words == 14 and got[60].base_failed
    more = line_quality.quality_rules(odd).collect()
    assert len(more) == odd.count() and all(r.base_failed for r in more if r.doc_id in (2, 3, 4))
    assert line_quality.quality_rules(odd.filter("false")).count() == 0


def test_quality_counts_documents_not_rows(spark):
    """A document given thirty times has no frequent lines; thirty documents with one line do."""
    alone = "\n".join(" ".join(f"w{i}x{j}" for j in range(10)) for i in range(8))
    rows = [(1, alone, None, "h", None)] * 30 + [(i, f"the same words open them all\nstory {i} goes on with words of its very own {i}", None, "h", None) for i in range(100, 130)]
    got = line_quality.quality_rules(spark.createDataFrame(rows, DOC)).collect()
    assert len(got) == 60 and all(r.removed_words == 0 and r.kept for r in got if r.doc_id == 1)
    assert all(r.removed_words == 6 for r in got if r.doc_id != 1)


# ---------------------------------------------------------------- 5 near duplicates


def test_super_min_hash_against_the_sequential_form():
    rng = np.random.default_rng(5)
    sets = [rng.integers(1, 2**63, n, dtype=np.uint64) for n in (1, 2, 7, 60, 400, 3000)]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    m, mask = 128, (1 << 64) - 1
    got = near_dups.super_min_hash(owner, np.concatenate(sets), len(sets), m)
    for d, s in enumerate(sets):
        best = [mask] * m
        for x in s:
            state = int(near_dups.mix(np.array([x ^ np.uint64(0x51ED270B27B4F3CF)]))[0])
            p = list(range(m))
            for step in range(m):
                if step:
                    state = int(near_dups.mix(np.array([(state + 0x9E3779B97F4A7C15) & mask], np.uint64))[0])
                k = step + ((state & 0xFFFFFFFF) * (m - step) >> 32)
                p[step], p[k] = p[k], p[step]
                best[p[step]] = min(best[p[step]], (step << 32) | (state >> 32))
                if max(best) >> 32 < step:
                    break
        assert got[d].tolist() == best


def components(texts, k, percent):
    sets = {d: {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set() for d, w in ((d, t.encode().lower().split() if t else []) for d, t in texts.items())}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}, {d: len(s) for d, s in sets.items()}


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates_against_all_pairs(spark, docs, k, percent):
    texts = {r.doc_id: r.text for r in docs.collect()}
    want, sizes = components(texts, k, percent)
    got = near_dups.near_duplicates(docs, k, percent).collect()
    assert {r.doc_id: r.component_id for r in got} == want and {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.component_id == r.doc_id) for r in got) and len(set(want.values())) < len(want)


def test_near_copies_in_one_large_bucket(spark):
    """Copies that differ in some words each: many pairs are not links, yet chains connect them; blocks are smaller than the bucket."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for d in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"x{rng.randrange(9)}"
        texts[d] = " ".join(w)
    near_dups.BLOCK, block = 900, near_dups.BLOCK
    try:
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(df, 3, 85).collect()}
    finally:
        near_dups.BLOCK = block
    assert got == components(texts, 3, 85)[0]


def test_near_duplicate_edges(spark, odd):
    got = near_dups.near_duplicates(odd).collect()
    assert len(got) == odd.count() and sum(r.doc_id == 1 and r.kept for r in got) == 3
    assert all(r.kept and r.n_shingles == 0 for r in got if r.doc_id in (2, 3, 4)) and [r.kept for r in got if r.doc_id is None] == [True]
    assert near_dups.keep_first(odd).count() == odd.count() and near_dups.near_duplicates(odd.filter("false")).count() == 0
    short = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "a b c"), (4, "b")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dups.near_duplicates(short, 3, 85).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


# ---------------------------------------------------------------- 6 lines


def brute_lines(texts, min_words):
    places = [(d, i, t.encode().lower().split()) for d, text in sorted(texts.items()) for i, t in enumerate(text.split("\n"))]
    places = [p for p in places if len(p[2]) >= min_words]
    first, distinct, near, out = {}, [], {}, {}
    for d, i, w in places:
        if tuple(w) not in first:
            first[tuple(w)] = (d, i)
            distinct.append((d, i, w))
    for n, (d, i, w) in enumerate(distinct):
        for e, j, v in distinct[:n]:
            if line_dedup.within_one(w, v):
                near[tuple(w)] = (e, j)
                break
    for d, i, w in places:
        by = near.get(tuple(w), first[tuple(w)])
        if by != (d, i):
            out[(d, i)] = by
    return out


def test_lines_against_brute_force(spark, docs):
    rng = random.Random(7)
    texts = {r.doc_id: r.text for r in docs.collect()}
    pool = [[f"v{rng.randrange(4)}" for _ in range(rng.randint(6, 11))] for _ in range(6)]
    for d in range(1000, 1040):  # many lines one edit apart, with ties
        made = []
        for _ in range(6):
            w = list(rng.choice(pool))
            if rng.random() < 0.8:
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = [f"v{rng.randrange(4)}"] * rng.randint(0, 1)
            made.append("  ".join(w))
        texts[d] = "\n".join(made)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no) for r in line_dedup.duplicate_lines(df, min_words=6).collect()}
    want = brute_lines(texts, 6)
    assert got == want and any(d >= 1000 for d, _ in want)
    left = {r.doc_id: r.text for r in line_dedup.dedup_lines(df, min_words=6).collect()}
    assert left == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in want) for d, t in texts.items()}


def test_line_edges(spark, odd):
    got = line_dedup.dedup_lines(odd).collect()
    assert len(got) == odd.count() and sum(r.doc_id == 1 and r.text.startswith("some words") for r in got) == 3 and {r.place for r in got} == {"clash"}
    assert line_dedup.duplicate_lines(odd.filter("false")).count() == 0
    exact = line_dedup.duplicate_lines(spark.createDataFrame([(1, "a b c\nA  b c\na b d")], "doc_id long, text string"), max_edits=0, min_words=2)
    assert [tuple(r) for r in exact.collect()] == [(1, 1, 1, 0, 0)]


def test_short_and_unspaced_lines(spark):
    eight = "one two three four five six seven eight"
    han = "\u6211\u4eec\u4eca\u5929\u53bb\u516c\u56ed\u73a9\u5427"  # nine characters, no space
    rows = [
        (1, f"And so.\n\nok\n{eight}\n{han}\nred green blue grey black white pink"),
        (2, f"and  SO.\n\nno\n{eight[:-6]}\n{han[:4]}x{han[5:]}\nred green blue grey black white teal"),
        (3, f"and so\n\nok\n{eight} nine\n{han[1:4]}"),
    ]
    got = line_dedup.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == [(2, 0, 1, 0, 0), (2, 3, 1, 3, 1), (2, 4, 1, 4, 1), (3, 2, 1, 2, 0), (3, 3, 1, 3, 1)]


def test_equal_lines_of_every_length(spark, docs):
    got = {(r.doc_id, r.line_no) for r in line_dedup.duplicate_lines(docs, max_edits=0).collect()}
    seen, want = set(), set()
    for r in docs.orderBy("doc_id").collect():
        for i, line in enumerate(r.text.split("\n")):
            w = tuple(line.encode().lower().split())
            if w in seen:
                want.add((r.doc_id, i))
            elif w:
                seen.add(w)
    assert got == want and want


# ---------------------------------------------------------------- 7 packing


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))


def test_units_encode_like_the_whole_text():
    tok, rng = tokenizer(), random.Random(5)
    pool = ["a", "b", "é", "ß", " ", "  ", "\n", "\n\n", "\t", "'s", "'", "don't", ".", ",", "<|endoftext|>", "<", "|", "1", "漢字", "я", " ", "́", "😀", "hello", "World", "_", "\r\n", "\x1c", "\x85", "!", "ª", "×", "١"]
    encode = packing.unit_encoder(lambda u: [e.ids for e in tok.encode_batch(u, add_special_tokens=False)], packing.word_model(tok.model), cache_size=3000)
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 25))) for _ in range(8000)]
    for lo in range(0, len(texts), 100):
        for text, raw in zip(texts[lo : lo + 100], encode(texts[lo : lo + 100])):
            assert array.array("I", raw).tolist() == tok.encode(text, add_special_tokens=False).ids, text
    long = " ".join(texts)
    assert "".join(packing.text_slices(long, 1000)) == long
    assert b"".join(encode(list(packing.text_slices(long, 1000)))) == encode([long])[0]


def test_whole_texts_get_the_tokenizers_ids():
    tok, rng = tokenizer(), random.Random(6)
    pool = ["a", "é", "ß", " ", "  ", "\n", "\n\n", "\t", "'s", "'", "don't", ".", "<|endoftext|>", "<", "|", "1", "123", "漢字", "я", "\u2003", "́", "😀", "hello", "World", "_", "\r\n", "\x1c", "\x85", "ª", "١", "'LL", "\u3000"]
    slow = lambda texts: [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    encode = packing.whole_text_encoder(queries.vocabulary("byte_bpe_50k.json"), slow)
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 30))) for _ in range(8000)] + [" " * 300_000 + "x", "x" * 3000, "<|endoftext|>" * 3, "\x00"]
    for text, raw in zip(texts, encode(texts)):
        assert array.array("I", raw).tolist() == tok.encode(text, add_special_tokens=False).ids, text[:80]
    assert encode([None, ""]) == [b"", b""]
    # Vocabularies whose merges are not in the order of their ids, or that are not byte-level, are left to their tokenizer.
    assert packing.whole_text_encoder(queries.vocabulary("word_bpe_49k.json"), slow) is None
    import json

    whole = json.load(open(queries.vocabulary("byte_bpe_50k.json"), encoding="utf-8"))
    assert packing.byte_level_ranks(whole) is not None
    whole["model"]["merges"][0], whole["model"]["merges"][9] = whole["model"]["merges"][9], whole["model"]["merges"][0]
    assert packing.byte_level_ranks(whole) is None


def test_packing_covers_every_id(spark, docs, odd):
    tok = tokenizer()
    for df in (docs, odd):
        rows = packing.pack(df, queries.vocabulary("byte_bpe_50k.json"), window=50).collect()
        texts = collections.Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
        want = collections.Counter()
        for (d, t), n in texts.items():
            ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
            want.update({(d, i, x): n for i, x in enumerate(ids)})
        got = collections.Counter()
        sequences = collections.defaultdict(list)
        for r in rows:
            assert r.length == len(r.ids) > 0 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            got.update((r.doc_id, r.start + i, x) for i, x in enumerate(r.ids))
            sequences[r.sequence_id].append((r.offset, r.length))
        assert got == want
        for pieces in sequences.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= 1024 and (at == 1024 or at & (at - 1) == 0)
    assert packing.pack(docs.filter("false"), queries.vocabulary("byte_bpe_50k.json")).count() == 0


def test_assignment_takes_the_cheapest_sequence():
    pieces, over = packing.assign([5, 4, 3, 3], [8, 8], 1.0, 0.1)
    assert pieces == [(0, 0, 5, 0), (1, 0, 4, 1), (2, 0, 3, 1), (3, 0, 3, 0)] and over == []
    pieces, over = packing.assign([5, 5, 5], [8, 7], 1.0, 0.0)
    assert sum(p[2] for p in pieces) == 15 and over == [] and max(p[3] for p in pieces) == 1


# ---------------------------------------------------------------- 8 segmentation


def all_segmentations(lattice, word):
    into = lattice.edges(word)

    def walk(at):
        if at == 0:
            yield 0.0, ()
        for a, s, ids in into[at]:
            for score, front in walk(a):
                yield score + s, front + ids

    return sorted(((s, ids) for s, ids in walk(len(word))), key=lambda x: -x[0])


def test_n_best_against_enumeration():
    rng = random.Random(8)
    pieces = {p: (300 + i, -rng.randint(1, 40) / 4) for i, p in enumerate(["▁", "a", "b", "▁a", "ab", "ba", "aba", "▁ab", "bb", "aab", "▁b"])}
    lattice = nbest.Lattice(pieces, list(range(256)), -50.0)
    for _ in range(150):
        text = "".join(rng.choices("aabbc é", k=rng.randint(0, 9)))
        units = nbest.UNITS.findall(nbest.normal_form(text))
        for u in units:
            every = all_segmentations(lattice, u)
            got = lattice.n_best(u, 6)
            assert np.allclose([s for s, _ in got], [s for s, _ in every[:6]]) and len({i for _, i in got}) == len(got) and {i for _, i in got} <= {i for _, i in every}
            score, ids, gap = lattice.best(u)
            assert np.isclose(score, every[0][0]) and (gap == np.inf if len(every) == 1 else np.isclose(gap, every[0][0] - every[1][0]))
        combined = sorted((sum(s for s, _ in c) for c in itertools.product(*[all_segmentations(lattice, u) for u in units])), reverse=True)
        got = list(nbest.Segmenter(lattice, 5).segment(text))
        assert np.allclose([s for s, _ in got], combined[:5]) and len({raw for _, raw in got}) == len(got)


def test_n_best_round_trip_and_edges(spark, docs, odd):
    model = queries.vocabulary("piece_bpe_32k.model")
    rows = nbest.encode_n_best(docs.unionByName(odd.select(docs.columns)), model, n=3)
    assert rows.filter("not round_trip").count() == 0
    assert nbest.encode_n_best(odd.filter("doc_id = 2 or doc_id is null and text is null"), model).count() == 0
    empty = nbest.encode_n_best(odd.filter("doc_id = 3"), model).collect()
    assert [(r.rank, r.n_pieces, r.score) for r in empty] == [(1, 0, 0.0)]
    back = nbest.decode(nbest.encode_n_best(docs, model, n=1).join(docs.select("doc_id", F.col("text").alias("own")), "doc_id"), model)
    assert back.filter("text <> own").count() == 0 and back.count() > 0
    assert nbest.encode_n_best(docs.filter("false"), model).count() == 0


# ---------------------------------------------------------------- 10 toxicity


def test_grammar_scores_clauses():
    s = toxicity.Scorer({"clown$": 0.9, "zeb": 0.9}, 0.01)
    plain, negated, reported, addressed = map(s.score, ("what a clown.", "he is not a clown.", 'they said "clown" today', "you clown"))
    assert plain >= 0.7 and addressed >= plain and negated < 0.7 and reported < 0.7
    assert s.score("not now. clown") >= 0.7  # the negation ends with its clause
    assert s.score("the frost may kill plants") < 0.7 <= s.score("i will find you and kill")
    assert s.score("clowns") < 0.7 <= s.score("ZEBAX") and s.score(None) == s.score("") == pytest.approx(0.01)


def test_composition_multiplies():
    step, factor = toxicity.compose(toxicity.window(toxicity.NEGATION, 1, 0.5), toxicity.until_end(toxicity.SPEECH, 0.1))
    at = step[step[0][toxicity.SPEECH]][toxicity.NEGATION]
    assert factor[at][toxicity.INSULT] == pytest.approx(0.05) and factor[step[at][toxicity.OTHER]][toxicity.INSULT] == pytest.approx(0.1)
    assert factor[step[at][toxicity.END]][toxicity.INSULT] == 1.0


def test_targets_on_both_sides_of_a_clause():
    s = toxicity.Scorer({"clown$": 0.6, "murder$": 0.9}, 0.01)
    for text in ("I will kill you", "kill yourself", "strangle all the people in that long street with you", "you, kill"):
        assert s.score(text) > 0.7, text
    assert s.score("the frost may kill plants. you know") == s.score("") and s.score("i will not kill you") < 0.7
    assert s.score("a clown, you") == s.score("you clown") > s.score("a clown")
    # A learned threat word weighs what was learned, with a target or without.
    assert s.score("murder all") > 0.85 and s.score("murder you") > s.score("kill you")


def test_a_clause_counts_once_and_phrases_match():
    s = toxicity.Scorer({"clown$": 0.5, "jester$": 0.6, "kill$": 0.5}, 0.0)
    assert s.score("a clown and a clown and a jester " * 50) == pytest.approx(0.6)
    assert s.score("a clown here. some more words. A clown here!") == pytest.approx(0.5)
    assert s.score("a clown here. a jester there.") == pytest.approx(1 - 0.5 * 0.4)
    assert s.score("what a piece of trash.") >= 0.7 > s.score("not a piece of trash") and s.score("a piece of cake and trash") == 0.0
    assert s.score("i break your neck") >= 0.7 and s.score("a piece of a piece of trash") >= 0.7 and s.score("a piece. of trash") == 0.0
    assert s.score("ich bring dich um") >= 0.7 > s.score("ich bring dich nicht um")
    states = {len(toxicity.grammar().step), len(toxicity.grammar().final)}
    assert len(states) == 1 and min(states) > 100


def test_learned_lexicon_on_held_out_rows(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=rng.randint(3, 8)))
    rows = []
    for i in range(900):
        w = [word() for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(60)] = "qrux" + word()[:3]
        rows.append((i, " ".join(w), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scorer = toxicity.fit(df.select("doc_id", "text"), df.filter("doc_id % 3 <> 1").select("doc_id", "toxic"))
    held = [(r.toxic, r.predicted) for r in toxicity.score(df, scorer, keep=("doc_id", "toxic")).filter("doc_id % 3 = 1").collect()]
    assert all(t == p for t, p in held) and sum(t for t, _ in held) > 30


def test_toxicity_edges(spark, odd):
    labels = spark.createDataFrame([(1, None), (None, 1), (1, 0), (1, 1), (5, 0), (99, 1)], "doc_id long, toxic int")
    scorer = toxicity.fit(odd, labels)
    got = toxicity.score(odd, scorer).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(odd.filter("false"), toxicity.fit(odd.filter("false"), labels.filter("false"))).count() == 0


def test_words_are_cut_at_ascii_space_only():
    owner, h = words_of(["a b c", "", "c\x0bd", " "] and ["a b c".encode(), b"", b"c\x0bd", b" "])
    assert owner.tolist() == [0, 0, 2, 2] and h[1] == h[2] and len(set(h.tolist())) == 3
