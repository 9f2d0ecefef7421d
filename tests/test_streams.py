"""Tables that are compacted while they are read, and the state of open answers."""

import math
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from repoloom.streaming import pieces, refresh, versioned

PIECE = "session string, seq long, piece string"


def newest(df):
    return df.groupBy("path").agg(F.max("version").alias("version"))


def content(table, version=None):
    return {r.path: r.version for r in newest(table.read(version)).collect()}


def test_fifty_appends_stay_few_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versioned, "FANOUT", 4)
    table, want, rng = versioned.VersionedTable(spark, str(tmp_path / "t"), "path", newest), {}, random.Random(1)
    reader = before = None
    for i in range(50):
        rows = [(f"p{rng.randrange(40)}", i) for _ in range(20)]
        want |= {p: max(v, want.get(p, 0)) for p, v in rows}
        table.append(spark.createDataFrame(rows, "path string, version int"), len(rows))
        table.compact()
        assert len(table.segments()) <= 3 * (1 + math.ceil(math.log(i + 2, 4)))
        if i == 5:
            reader, before = table.read(), dict(want)
    assert content(table) == want
    # Merged segments hold one row a key, so rows are bounded too.
    assert sum(s["rows"] for s in table.segments() if s["level"] > 1) <= 40 * 6
    # A reader of the sixth append still sees it; after a clean-up the newest versions do.
    assert {r.path: r.version for r in newest(reader).collect()} == before
    files = lambda: len(os.listdir(tmp_path / "t" / "data"))
    assert table.vacuum() == 0 and files() > 50
    assert table.vacuum(grace_seconds=0) > 40 and files() <= len(table.segments()) + 1
    assert content(table) == want and content(table, table.versions()[-2]) is not None and len(table.versions()) == 2


def test_a_compaction_that_dies_loses_nothing(spark, tmp_path, monkeypatch):
    table = versioned.VersionedTable(spark, str(tmp_path / "t"), "path", newest)
    for i in range(4):
        table.append(spark.createDataFrame([("a", i), (f"b{i}", i)], "path string, version int"), 2)
    want, segments = content(table), table.segments()
    monkeypatch.setattr(table, "_commit", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        table.compact(4)
    monkeypatch.undo()
    assert table.segments() == segments and content(table) == want
    # An append between reading and swapping stays; a second compaction of the same segments gives up.
    inner = table._commit
    def swap(added, removed):
        monkeypatch.undo()
        table.append(spark.createDataFrame([("a", 99)], "path string, version int"), 1)
        return inner(added, removed)
    monkeypatch.setattr(table, "_commit", swap)
    assert table.compact(4) == 1 and content(table) == {**want, "a": 99}
    assert not table._commit([], [segments[0]["name"]])


def test_two_writers_take_different_numbers(spark, tmp_path):
    path = str(tmp_path / "x" / "1.json")
    assert versioned.write_text(spark, path, "é1") and not versioned.write_text(spark, path, "2")
    assert versioned.read_text(spark, path) == "é1" and versioned.list_names(spark, str(tmp_path / "x")) == ["1.json"]


def test_find_by_literals_and_by_join(spark, tmp_path, monkeypatch):
    table = versioned.VersionedTable(spark, str(tmp_path / "t"), "path")
    assert table.find(spark.createDataFrame([("a",)], "path string")) is None
    for i in range(3):
        table.append(spark.createDataFrame([(f"k{j}", i) for j in range(100)], "path string, version int"), 100)
    keys = spark.createDataFrame([("k7",), ("k9",), ("none",), ("k7",)], "path string")
    few = table.find(keys)
    assert "In(path" in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(versioned, "MAX_LITERALS", 1)
    assert sorted(few.collect()) == sorted(table.find(keys).collect()) and few.count() == 6


def test_refresh_over_many_batches_with_compaction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versioned, "FANOUT", 3)
    schema, rng, want = "path string, version long, text string", random.Random(2), {}
    for i in range(14):
        rows = [(f"f{rng.randrange(12)}", rng.randrange(1000), rng.choice(["", "one", "one two", f"text {i}"])) for _ in range(6)]
        rows = list({(p, v): (p, v, t) for p, v, t in rows if (p, v) not in {(q, w) for q, (w, _) in want.items()}}.values())
        for p, v, t in rows:
            if p not in want or v > want[p][0]:
                want[p] = (v, t)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
        time.sleep(0.01)
    build = lambda df: df.select("path", "hash", "version", F.explode(F.filter(F.split("text", " "), lambda x: x != "")).alias("w"))
    store = str(tmp_path / "s")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src"))
    refresh.refresh_stream(spark, stream, store, str(tmp_path / "c"), build)
    got = sorted((r.path, r.version, r.w) for r in refresh.stored_rows(spark, store).collect())
    assert got == sorted((p, v, w) for p, (v, t) in want.items() for w in t.split())
    for table in (refresh.ledger(spark, store), refresh.rows_table(spark, store)):
        assert len(table.versions()) >= 14 and len(table.segments()) <= 6
    # What compaction has left holds no rows of replaced files beyond the last few batches.
    assert refresh.rows_table(spark, store).read().count() <= len(got) + 6 * 2 * 4
    assert refresh.vacuum(spark, store, grace_seconds=0) > 10
    assert sorted((r.path, r.version, r.w) for r in refresh.stored_rows(spark, store).collect()) == got


def test_sessions_leave_the_state_and_come_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versioned, "FANOUT", 2)
    rng, last = random.Random(6), {}
    src, store, checkpoint = str(tmp_path / "src"), str(tmp_path / "o"), str(tmp_path / "c")

    def feed(rows, idle):
        spark.createDataFrame(rows, PIECE).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(PIECE).option("maxFilesPerTrigger", 1).parquet(src)
        pieces.assembly_stream(spark, stream, store, checkpoint, part_rows=10, idle_seconds=idle)

    for i in range(6):
        # Shuffled, late and repeated: every batch brings pieces of old sessions with new texts.
        rows = list({(s, n): (s, n, f"{s}{n}v{i} ") for s, n in ((rng.choice("abcd"), rng.randrange(25)) for _ in range(15))}.values())
        last |= {(s, n): t for s, n, t in rows}
        feed(rows, 0 if i < 4 else 600)
        if i < 4:
            time.sleep(0.05)
    want = {}
    for (s, n), t in sorted(last.items()):
        want[s, n // 10] = want.get((s, n // 10), "") + t
    assert {(r.session, r.part_no): r.answer for r in pieces.stored_answers(spark, store).collect()} == want
    # Only what came in the last batches is open, and closed parts take one row each after compaction.
    assert pieces.open_pieces(spark, checkpoint).count() <= 2 * 15 + 15
    runs = pieces.closed_runs(spark, store)
    assert len(runs.segments()) <= 3 and runs.read().count() <= 2 * 4 * 3
    feed([("z", 0, "end")], 600)
    assert pieces.stored_answers(spark, store).filter("session = 'z'").first().answer == "end"


class _Cells:
    """A state variable in memory that counts its calls."""

    def __init__(self, calls):
        self.calls, self.rows = calls, []

    def _count(self):
        self.calls.append(1)

    def appendValue(self, row):  # noqa: N802
        self._count()
        self.rows.append(row)

    def updateValue(self, key, row):  # noqa: N802
        self._count()

    def update(self, row):
        self._count()
        self.rows = [row]

    def clear(self):
        self.rows = []


class _List(_Cells):
    def get(self):
        return iter(list(self.rows))


class _Value(_Cells):
    def get(self):
        return self.rows[0] if self.rows else None

    def exists(self):
        return bool(self.rows)


class _Handle:
    def __init__(self):
        self.calls, self.timers = [], set()

    def getListState(self, name, schema):  # noqa: N802
        return _List(self.calls)

    def getMapState(self, name, key, schema):  # noqa: N802
        return _Cells(self.calls)

    def getValueState(self, name, schema):  # noqa: N802
        return _Value(self.calls)

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)


class _Now:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.now


def test_state_calls_do_not_grow_with_pieces_and_late_parts_stay(monkeypatch):
    import pandas as pd

    handle, keeper = _Handle(), pieces.Assembler(8, "long")
    keeper.init(handle)
    monkeypatch.setattr(pieces, "LIST_PIECES", 3)
    frame = lambda rows: iter([pd.DataFrame(rows, columns=["session", "part_no", "seq", "piece"])])
    wide = [(s, 0, n, f"{n} ") for s in range(20) for n in range(50)]
    list(keeper.handleInputRows((3,), frame(wide), _Now(1000)))
    assert len(handle.calls) <= 3 and handle.timers == {9000}
    # The clock steps back: what comes later still counts as later. Of pieces that come together the greatest counts.
    list(keeper.handleInputRows((3,), frame([(7, 0, 1, "a"), (7, 0, 1, "b"), (7, 1, 60, "c")]), _Now(900)))
    handle.timers.clear()
    list(keeper.handleInputRows((3,), frame([(8, 0, 0, "late")]), _Now(8500)))
    out = pd.concat(keeper.handleExpiredTimer((3,), _Now(9001), None))
    got = {(s, p): dict(zip(n, t)) for s, p, n, t in out.itertuples(index=False)}
    assert len(got) == 20 and (8, 0) not in got and got[7, 0][1] == "b" and got[7, 1] == {60: "c"} and got[9, 0] == {n: f"{n} " for n in range(50)}
    # What stays open is written back and closed later, not before an eighth of the idle time.
    assert handle.timers == {16500} and all(len(r[1]) <= 3 for r in keeper.pieces.rows)
    out = pd.concat(keeper.handleExpiredTimer((3,), _Now(16500), None))
    assert [(s, p, n, t[0]) for s, p, n, t in out.itertuples(index=False)] == [(8, 0, list(range(50)), "late")] and keeper.pieces.rows == []
    # Pieces without a session, below 0.
    list(keeper.handleInputRows((-4,), frame([(0, 2, 5, "x")]), _Now(20000)))
    assert [r[1:] for r in keeper.pieces.rows] == [([None], [2], [5], ["x"])]


def test_pieces_without_a_session_stay_apart(spark, tmp_path):
    rows = [(s, n, f"{s}:{n} ") for n, s in enumerate([3, None, 2**60 + 1, 5, None, 3])]
    src, kind = str(tmp_path / "src"), "session long, seq long, piece string"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(src)
    pieces.assembly_stream(spark, spark.readStream.schema(kind).parquet(src), str(tmp_path / "o"), str(tmp_path / "c"))
    got = {r.session: r.answer for r in pieces.stored_answers(spark, str(tmp_path / "o")).collect()}
    assert got == {3: "3:0 3:5 ", None: "None:1 None:4 ", 2**60 + 1: f"{2**60 + 1}:2 ", 5: "5:3 "}
