"""The filter audit, the license scan and the conversation repair against SQL, plain Python and brute force."""

import collections
import hashlib
import itertools
import random
import re
import sys
import zlib

import pytest
from pyspark.sql import functions as F

from oracle_check import connect, difference
from repoloom.llm import filter_audit, license_scan, queries, turn_repair

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("key", "part", "hash", "bits", "n", "salt", "place", "gram", "pos", "seg", "codes", "audit", "kind", "cost", "least", "words")


def clashing(df):
    for c in CLASHES:
        df = df.withColumn(c, F.lit("clash"))
    return df


# ---------------------------------------------------------------- 11 filter audit


def audit_by_hand(docs, labels):
    """docs: (doc_id, text, source); every order is run on the documents themselves."""
    texts = [(i, t or "", s or "") for i, t, s in docs]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    fails = []
    for i, t, s in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = set()
        failed |= {"A"} if len(words) < 50 else set()
        failed |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        failed |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else set()
        failed |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        failed |= {"E"} if i is not None and any(j is not None and j < i and u == t for j, u, _ in texts) else set()
        fails.append((i, s, failed))
    out, shapley = [], collections.Counter()
    for order in itertools.permutations("ABCDE"):
        for part in {s for _, s, _ in fails}:
            left = [(i, f) for i, s, f in fails if s == part]
            everyone = left
            for step, letter in enumerate(order, 1):
                gone = [i for i, f in left if letter in f]
                stay = [(i, f) for i, f in left if letter not in f]
                shapley[part, letter] += len(gone)
                failing = sum(letter in f for _, f in everyone)
                unique = sum(f == {letter} for _, f in everyone)
                out.append((part, "".join(order), step, len(stay), len(gone), failing - len(gone), unique, sum(i in good for i in gone), sum(i in toxic for i in gone)))
                left = stay
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_filter_audit_equals_sql(spark):
    assert difference(queries.QUERIES["op11_filter_audit"](spark, SF), connect(SF), queries.ORACLES["op11_filter_audit"]) is None


@pytest.mark.parametrize("group", [256, 2])
def test_filter_audit_by_hand(spark, monkeypatch, group):
    monkeypatch.setattr(filter_audit, "GROUP", group)
    long = " ".join(f"w{i}" for i in range(60))
    docs = [(i, long if i % 3 == 0 else f"{long} {i}", "hot") for i in range(20)]
    docs += [(30, "A B C", None), (31, "A B C", ""), (31, "A B C", ""), (32, None, "x"), (33, "", "x"), (29, "", "hot"), (34, "a " * 60, "x"), (35, "a$ " * 60, "x")]
    docs += [(None, long, "hot"), (None, "A B C", None), (36, "x" * 70_000, "y"), (37, long.upper(), "y"), (37, long.upper() + " ", "y")]
    labels = [(3, 1, 0), (3, 0, 1), (6, None, 1), (31, 1, None), (None, 1, 1), (99, 1, 1)]
    df = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in docs], DOC)
    judged = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("key", F.lit("clash"))
    got = sorted(tuple(r) for r in filter_audit.filter_audit(clashing(df), judged).collect())
    assert got == audit_by_hand(docs, labels)
    assert filter_audit.filter_audit(df.filter("false"), judged).count() == 0


def test_equal_hashes_are_no_copies(spark, monkeypatch):
    """With a hash that takes all texts for one, only the text decides."""
    monkeypatch.setattr(F, "md5", lambda c: F.lit("00"))
    rows = spark.createDataFrame([(1, "p", "a"), (2, "p", "b"), (3, "p", "a"), (4, "p", "b"), (0, "p", "c")], "doc_id long, part string, text string")
    assert sorted(r.doc_id for r in filter_audit.earlier_copies(rows).collect()) == [3, 4]


# ---------------------------------------------------------------- 12 license scan


def test_license_scan_equals_sql(spark):
    assert difference(queries.QUERIES["op12_license_scan"](spark, SF), connect(SF), queries.ORACLES["op12_license_scan"]) is None


def scan(spark, texts, **options):
    df = clashing(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOC))
    return {r.doc_id: r for r in license_scan.license_scan(df, **options).collect()}


def test_base_places(spark):
    texts = ["Released under the MIT License, MIT-license; mit\n\nLICENSE.", "cc by cc by-nc", "GNU General-Public License & Apache  License", "commit license", "mıt license", None, "", "mit", "mit license " * 5000]
    got = scan(spark, texts)
    places = lambda r: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)
    assert places(got[0]) == (9, 3, 3, 7, "mit") and places(got[1]) == (5, 2, 0, 2, "cc-by")
    assert places(got[2]) == (6, 2, 0, 4, "apache,gpl") and got[1].labels == "cc-by,cc-by-nc"
    for i in (3, 4, 5, 6, 7):
        assert got[i].n_base == 0 and got[i].first_word is None and got[i].base_labels == got[i].labels == "" and got[i].score == 0
    assert places(got[8]) == (10_000, 5000, 0, 9998, "mit")
    assert scan(spark, texts, block_grams=7) == got  # templates in many blocks


def test_edited_notices_share_a_span(spark):
    notice = next(t.text for t in license_scan.NOTICES if t.label == "apache").split()
    put_in, left_out = notice[:20] + ["truly"] + notice[20:], notice[:15] + notice[16:]
    half, shuffled = notice[: len(notice) // 2], notice[::-1]
    got = scan(spark, [" ".join(["x"] * 7 + w + ["y"] * 7) for w in (notice, put_in, left_out, half, shuffled)])
    assert [got[i].labels for i in range(5)] == ["apache", "apache", "apache", "", ""]
    assert got[0].score == 1.0 and 0.8 < got[1].score < 1 and 0.8 < got[2].score < 1 and 0.4 < got[3].score < 0.6 and got[4].score == 0
    assert got[0].n_base == 0 and got[1].n_spans == 1
    _, spans = license_scan.license_spans(spark.createDataFrame([(1, " ".join(["x"] * 7 + put_in))], "doc_id long, text string"))
    found = [r for r in spans.collect() if r.verified]
    assert [(r.start_word, r.end_word) for r in found] == [(7, 7 + len(license_scan.words_of_text(" ".join(put_in))))]


def test_license_scan_repeated_and_empty(spark):
    df = spark.createDataFrame([(1, "MIT License"), (1, "MIT License"), (1, "other"), (None, "cc by"), (None, "cc by"), (None, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_base, r.labels) for r in license_scan.license_scan(df).collect())
    assert got == [("1", 0, ""), ("1", 1, "mit"), ("1", 1, "mit"), ("None", 0, ""), ("None", 1, "cc-by"), ("None", 1, "cc-by")]
    assert license_scan.license_scan(df.filter("false")).count() == 0


# ---------------------------------------------------------------- 13 conversation repair


def cheapest(codes):
    """Least (cost, audit) by plain recursion over rows and grammar states; at most three inserts in a row."""
    memo = {}

    def go(i, state, inserts):
        if (i, state, inserts) not in memo:
            want = "a" if state == 2 else "u"
            to, found = 3 if want == "a" else 2, [(0, "")] if i == len(codes) and state in (0, 3) else []
            step = lambda cost, move, rest: (cost + rest[0], move + rest[1])
            if inserts < 3:
                found.append(step(3, "I", go(i, to, inserts + 1)))
            if i < len(codes):
                found.append(step(4, "D", go(i + 1, state, 0)))
                if codes[i] not in "bd":
                    more = 3 if codes[i].isupper() else 0
                    found.append(step(more, "K", go(i + 1, to, 0)) if codes[i].lower() == want else step(3 + more, "R", go(i + 1, to, 0)))
                    if state == 0 and codes[i].lower() == "s":
                        found.append(step(more, "K", go(i + 1, 1, 0)))
            memo[i, state, inserts] = min(found, default=(10**9, ""))
        return memo[i, state, inserts]

    return go(0, 0, 0)


def repaired_by_hand(rows):
    """rows: (conv_id, turn, role, text) after damage."""
    groups = collections.defaultdict(list)
    for c, turn, role, text in rows:
        groups[c].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for c, mine in groups.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        seen, codes = set(), ""
        for _, role, text in mine:
            bare = text.strip(" \t\n\x0b\x0c\r")
            code = role[:1] if role[:1] in ("s", "u", "a") else "o"
            codes += "b" if not bare else "d" if (role, text) in seen else code if bare[-1] in ".!?" else code.upper()
            seen.add((role, text))
        cost, audit = cheapest(codes)
        lines, at, last = [], 0, ""
        for move in audit:
            role, text = mine[at][1:] if move != "I" else ("", "")
            at += move != "I"
            if move != "D":
                want = "assistant" if last == "u" else "user"
                lines.append(f"{role if move == 'K' else want}:{text}")
                last = (role if move == "K" else want)[0]
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        counts = (gaps, codes.count("b"), codes.count("d"), sum(x.isupper() for x in codes), illegal, cost)
        assert at == len(mine)
        out[c] = (*counts, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def damage_by_hand(rows):
    out = []
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        harm = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        out += [(c, turn, "user" if harm == 4 else role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    return out


def test_repair_query_by_hand(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    want = repaired_by_hand(damage_by_hand(rows))
    nothing = (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())
    got = {r[0]: tuple(r)[1:] for r in queries.QUERIES["op13_turn_repair"](spark, SF).collect()}
    assert got == {c: want.get(c, nothing) for c in {r[0] for r in rows}}


@pytest.mark.parametrize("hot", [1_000_000, 20])
def test_repair_of_long_odd_and_repeated_turns(spark, monkeypatch, hot):
    """A hot conversation in many segments and three levels, odd roles, ties, nulls, repeated rows."""
    monkeypatch.setattr(turn_repair, "FAN", 4)
    monkeypatch.setattr(turn_repair, "number_rows", lambda *a: __import__("repoloom.operators.ordered", fromlist=["x"]).number_rows(*a, hot_rows=hot))
    sys.setrecursionlimit(20_000)
    rng = random.Random(5)
    say = lambda: rng.choice(["Yes.", "no", "Why?", "  ", f"text {rng.random()}.", f"open {rng.random()}"])
    rows = [(1, i, rng.choice(["user", "assistant", "assistant", "system", "tool"]) if i % 5 == 0 else ("user", "assistant")[i % 2], say()) for i in range(400)]
    rows += [(c, i, rng.choice(["system", "user", "assistant"]), say()) for c in range(2, 40) for i in range(rng.randint(15, 18) if c % 3 else rng.randint(1, 6))]
    rows += [(None, 1, "user", "a."), (None, None, None, None), (50, 3, "", "x."), (50, 3, "user", "x."), (50, 3, "user", "x."), (51, None, "Unicorn", "é" * 70_000), (52, 7, "user", None), (53, 1, "a", "漢字。"), (53, 9, "u", "ok.\n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r[0]: tuple(r)[1:] for r in turn_repair.repair(clashing(df)).collect()}
    assert got == repaired_by_hand(rows)
    assert turn_repair.repair(df.filter("false")).count() == 0


def test_bands_hold_every_cheapest_path():
    rng = random.Random(3)
    for _ in range(1500):
        codes = "".join(rng.choice("uaUAsSoObduaua") for _ in range(rng.randint(0, 9)))
        assert turn_repair.whole(codes) == cheapest(codes), codes


def test_registry_of_new_operators():
    assert all(sum(q.startswith(f"op{n}_") for q in queries.QUERIES) == 1 for n in (11, 12, 13))
