"""Conversation structure repair: cheapest edits that give the roles a system turn at most, then user and assistant in turn.

The turns of a conversation are aligned (Wagner-Fischer) with the target ``s?(ua)+`` cut at each feasible length; the cost found so far
is the incumbent that leaves out lengths and bounds the band of cells around the diagonal (Ukkonen) for the next length.
A cell table holds costs to the end, so walking it from the start and taking the least of D < I < K < R among the cheapest moves
gives the least audit of that length; audits of equal cost are compared over all lengths.

A conversation of ``SEGMENT`` turns or more is cut into segments, aligned one by one for each state of the grammar before and after them:
nothing yet (0), after a system turn (1), after a user turn (2), after an assistant turn (3). Inserted turns belong to the segment of the
row behind them, so no audit of a segment starts another one, and of two ways through a row of segments the first segment in
which they differ decides. Costs and ranks of four by four states are therefore enough to join segments, ``FAN`` at a time,
in a tree over as many tasks as there are groups; on the way back every segment is told its states.

Scale: only one character a turn goes into the alignment. Texts are shuffled once, for the hash: SHA-256 reads a conversation from start to end
by definition, so its rows stream through one task, sorted on disk, with one byte a turn in memory (its audit).

Edge cases: a null role or text is one space, a null conv_id is a conversation, null turns come first. Rows with equal turns are ordered by role,
then by the MD5 of the text. A role that starts with none of s, u, a (an empty one too) is given a new role or deleted. Rows repeated in the
table are duplicates. An empty table gives no rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoloom.operators.columns import join_salted
from repoloom.operators.ordered import number_rows
from repoloom.session import cut_lineage

DELETE, INSERT, REROLE, OPEN_END = 4, 3, 3, 3
SEGMENT = 16
FAN = 1024
BLANKS = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
CLOSING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}

Option = tuple[int, int, int, str]  # state before, state after, cost, audit


# ---------------------------------------------------------------- alignment of one segment
# A turn is one character: its initial (o: another role), upper case where the text is truncated, b or d where it must be deleted.


def band(slack: int, shift: int) -> tuple[int, int]:
    """Least and greatest distance from the diagonal of a cell on a path within ``slack``, when the path ends ``shift`` beside it."""
    return -((slack - INSERT * shift) // (DELETE + INSERT)), (slack + DELETE * shift) // (DELETE + INSERT)


def align(codes: str, target: str, bound: int, closed: bool) -> tuple[int, str] | None:
    """Cost and least audit of turning ``codes`` into ``target`` for at most ``bound``; None where that is not possible.

    ``closed``: turns may be inserted behind the last row.
    """
    n, m = len(codes), len(target)
    must = [0]
    for c in codes:
        must.append(must[-1] + (c in "bd"))
    slack = bound - DELETE * must[n]
    near, far = band(slack, m - (n - must[n]))
    if slack < 0 or near > far:
        return None
    rest: list[dict[int, int]] = [{} for _ in range(n + 1)]
    for i in range(n, -1, -1):
        row, below = rest[i], rest[i + 1] if i < n else {}
        middle = i - must[i]
        for j in range(min(m, middle + far), max(0, middle + near) - 1, -1):
            best = min((cost for _, cost in _moves(codes, target, i, j, row, below, closed)), default=None)
            if i == n and j == m:
                best = 0
            if best is not None:
                row[j] = best
    if 0 not in rest[0] or rest[0][0] > bound:
        return None
    audit, i, j = [], 0, 0
    while (i, j) != (n, m):
        moves = dict(_moves(codes, target, i, j, rest[i], rest[i + 1] if i < n else {}, closed))
        move = min(x for x, cost in moves.items() if cost == rest[i][j])
        audit.append(move)
        i, j = i + (move != "I"), j + (move != "D")
    return rest[0][0], "".join(audit)


def _moves(codes: str, target: str, i: int, j: int, row: dict[int, int], below: dict[int, int], closed: bool) -> Iterator[tuple[str, int]]:
    n, m = len(codes), len(target)
    if i < n and j in below:
        yield "D", DELETE + below[j]
    if j < m and target[j] != "s" and (i < n or closed) and j + 1 in row:
        yield "I", INSERT + row[j + 1]
    if i < n and j < m and codes[i] not in "bd" and j + 1 in below:
        after = below[j + 1] + (OPEN_END if codes[i].isupper() else 0)
        if codes[i].lower() == target[j]:
            yield "K", after
        elif target[j] != "s":
            yield "R", REROLE + after


def targets(state: int, most: int) -> Iterator[str]:
    """Every string of at most ``most`` roles that the grammar allows behind ``state``."""
    turns = "au" if state == USER else "ua"
    yield ""
    for length in range(1, most + 1):
        yield (turns * length)[:length]
        if state == START:
            yield ("s" + "ua" * length)[:length]


def options(codes: str, state: int, closed: bool = False) -> list[Option]:
    """The best audit from ``state`` to each state that can be reached; ``closed``: to a complete conversation only."""
    able = len(codes) - sum(c in "bd" for c in codes)
    top = DELETE * len(codes) + 2 * INSERT + REROLE + OPEN_END  # no end state costs more, if it can be reached
    best: dict[int, tuple[int, str]] = {state: (DELETE * len(codes), "D" * len(codes))} if not closed or state == START else {}
    # Lengths next to the number of usable rows first: a low incumbent early leaves out most others.
    for target in sorted(targets(state, able + top // INSERT), key=lambda t: abs(len(t) - able)):
        end = STATE[target[-1]] if target else state
        if closed and (end not in (START, ASSISTANT) or target == "s"):
            continue
        end = START if closed else end
        bound = best[end][0] if end in best else top
        apart = len(target) - able
        if DELETE * (len(codes) - able) + (INSERT * apart if apart > 0 else -DELETE * apart) > bound:
            continue
        found = align(codes, target, bound, closed)
        if found is not None and (end not in best or found < best[end]):
            best[end] = found
    return [(state, end, *found) for end, found in sorted(best.items())]


@functools.lru_cache(1 << 16)
def whole(codes: str) -> tuple[int, str]:
    """Cost and audit of a conversation of one segment."""
    return options(codes, START, closed=True)[0][2:]


@functools.lru_cache(1 << 12)
def segment(codes: str, first: bool) -> list[Option]:
    """Options of a segment of a longer conversation for all states before it."""
    return [o for state in ((START,) if first else range(4)) for o in options(codes, state)]


# ---------------------------------------------------------------- joining segments

Cells = dict[tuple[int, int], tuple[int, int]]  # (state before, state after): (cost, rank of the audit among those of the same state before)


def ranked(found: list[Option]) -> list[tuple[int, int, int, int]]:
    order = sorted(found, key=lambda o: (o[0], o[3]))
    return [(s, t, cost, i) for i, (s, t, cost, _) in enumerate(order)]


def path(children: list[Cells], start: int, end: int) -> tuple[int, list[tuple[int, int]]] | None:
    """Cost and states of the best way through the segments from ``start`` to ``end``."""
    after: dict[int, int] = {end: 0}
    steps: list[dict[int, int]] = []
    for cells in reversed(children):
        best: dict[int, tuple[int, int, int]] = {}
        for (s, t), (cost, rank) in cells.items():
            if t in after and (s not in best or (cost + after[t], rank) < best[s][:2]):
                best[s] = (cost + after[t], rank, t)
        after = {s: b[0] for s, b in best.items()}
        steps.append({s: b[2] for s, b in best.items()})
    if start not in after:
        return None
    way, at = [], start
    for step in reversed(steps):
        way.append((at, step[at]))
        at = step[at]
    return after[start], way


def joined(children: list[Cells]) -> list[tuple[int, int, int, int]]:
    """The segments as one: (state before, state after, cost, rank)."""
    out = []
    for s in range(4):
        ways = {t: found for t in range(4) if (found := path(children, s, t)) is not None}
        # Two ways differ in the rank of the first segment that they leave in different states.
        key = lambda t: [children[i][step][1] for i, step in enumerate(ways[t][1])]  # noqa: E731, B023
        out += [(s, t, ways[t][0], rank) for rank, t in enumerate(sorted(ways, key=key))]
    return out


def _cells(rows: list[dict]) -> Cells:
    return {(r["s"], r["t"]): (r["cost"], r["rank"]) for r in rows}


_OPTIONS = "array<struct<s:int,t:int,cost:long,rank:int>>"


def _grouped(level: DataFrame) -> DataFrame:
    """Segments of a level under their group of the next one: at most FAN of them."""
    group = F.floor(F.col("seg") / FAN).cast("long").alias("parent")
    return level.groupBy("key", group).agg(F.array_sort(F.collect_list(F.struct("seg", "cells"))).alias("children"))


def _long_conversations(segments: DataFrame) -> DataFrame:
    """key, seg, cost, audit of the segments of conversations that have more than one, and a last row for turns inserted at the end."""

    def match(batches):
        import pyarrow as pa

        schema = pa.schema([("key", pa.string()), ("seg", pa.int64()), ("s", pa.int32()), ("t", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32()), ("audit", pa.string())])
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                found = segment(r["codes"], r["seg"] == 0)
                audits = {o[:2]: o[3] for o in found}
                rows += [{"key": r["key"], "seg": r["seg"], "s": s, "t": t, "cost": c, "rank": k, "audit": audits[s, t]} for s, t, c, k in ranked(found)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    def up(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("s", pa.int32()), ("t", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32())]))
        for batch in batches:
            made = [[dict(zip(("s", "t", "cost", "rank"), o)) for o in joined([_cells(c["cells"]) for c in x])] for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, kind)], ["key", "seg", "cells"])

    def down(batches):
        import pyarrow as pa

        schema = pa.schema([("key", pa.string()), ("seg", pa.int64()), ("s", pa.int32()), ("t", pa.int32())])
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                _, way = path([_cells(c["cells"]) for c in r["children"]], r["s"], r["t"])
                rows += [{"key": r["key"], "seg": c["seg"], "s": s, "t": t} for c, (s, t) in zip(r["children"], way)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    found = cut_lineage(segments.mapInArrow(match, "key string, seg long, s int, t int, cost long, rank int, audit string"))
    levels = [found.groupBy("key", "seg").agg(F.collect_list(F.struct("s", "t", "cost", "rank")).cast(_OPTIONS).alias("cells"))]
    last = found.agg(F.max("seg")).first()[0]
    while last is not None and (last > 0 or len(levels) == 1):
        groups = _grouped(levels[-1])
        levels.append(cut_lineage(groups.mapInArrow(up, f"key string, seg long, cells {_OPTIONS}")))
        last //= FAN
    closing = F.create_map(*[F.lit(x) for state, inserts in CLOSING.items() for x in (state, inserts)])
    ends = levels[-1].select("key", F.inline("cells")).filter(f"s = {START}").withColumn("audit", closing[F.col("t")])
    ends = ends.groupBy("key").agg(F.min_by(F.struct("s", "t", "audit"), F.struct(F.col("cost") + INSERT * F.length("audit"), F.col("rank"))).alias("e"))
    ends = ends.select("key", "e.s", "e.t", "e.audit")
    chosen = ends.select("key", F.lit(0).cast("long").alias("seg"), "s", "t")
    for level in reversed(levels[:-1]):
        groups = _grouped(level).withColumnRenamed("parent", "seg").join(chosen, ["key", "seg"])
        chosen = groups.select("key", "seg", "children", "s", "t").mapInArrow(down, "key string, seg long, s int, t int")
    closed = ends.select("key", F.lit((1 << 62)).cast("long").alias("seg"), (INSERT * F.length("audit")).cast("long").alias("cost"), "audit")
    return found.join(chosen, ["key", "seg", "s", "t"]).select("key", "seg", "cost", "audit").unionByName(closed)


# ---------------------------------------------------------------- conversations


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def _turns(rows: DataFrame) -> DataFrame:
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select(_key().alias("key"), "turn", space("role"), space("text")).withColumn("digest", F.unhex(F.md5("text")))


def turn_codes(turns: DataFrame) -> DataFrame:
    """key, seg, codes: the rows of each conversation in order, one character each, at most SEGMENT of them a row."""
    bare, initial = F.btrim("text", F.lit(BLANKS)), F.substring("role", 1, 1)
    light = turns.select(
        "key",
        "turn",
        "role",
        "digest",
        (bare == "").alias("blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("open"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
    )
    rows = cut_lineage(number_rows(light, ["key"], ["turn", "role", "digest"], "pos"))
    again = rows.groupBy("key", "role", "digest").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    rows = join_salted(rows, again, ["key", "role", "digest"], F.col("pos"), how="left")
    code = F.when(F.col("blank"), "b").when(F.col("pos") > F.col("first"), "d").when(F.col("open"), F.upper("initial")).otherwise(F.col("initial"))
    seg = F.floor(F.col("pos") / SEGMENT).cast("long").alias("seg")
    ordered = F.array_sort(F.collect_list(F.struct("pos", code.alias("code"))))
    return rows.groupBy("key", seg).agg(F.array_join(F.transform(ordered, lambda x: x["code"]), "").alias("codes"))


def audits(codes: DataFrame) -> DataFrame:
    """key, seg, cost, audit: the cheapest edits of every conversation, in segments."""

    def match(batches):
        import pyarrow as pa

        for batch in batches:
            found = [whole(c) for c in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())], ["key", "seg", "cost", "audit"])

    short = (F.col("seg") == 0) & (F.length("codes") < SEGMENT)
    one = codes.filter(short).select("key", "seg", "codes").mapInArrow(match, "key string, seg long, cost long, audit string")
    return one.unionByName(_long_conversations(codes.filter(~short).select("key", "seg", "codes")))


class _Repaired:
    """A conversation as its rows pass by."""

    def __init__(self) -> None:
        self.codes, self.audit, self.cost, self.conv = [], [], 0, None
        self.at = self.illegal = self.distinct = 0
        self.state, self.before, self.low, self.high = START, None, None, None
        self.sha, self.started = hashlib.sha256(), False

    def plan(self, codes: str | None, audit: str | None, cost: int | None) -> None:
        self.codes.append(codes or "")
        self.audit.append(audit or "")
        self.cost += cost or 0

    def emit(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.started else ''}{role}:{text}".encode())
        self.started = True

    def expected(self) -> str:
        self.state = ASSISTANT if self.state == USER else USER
        return "user" if self.state == USER else "assistant"

    def inserted(self, audit: str) -> None:
        while audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.emit(self.expected(), "")

    def row(self, audit: str, turn: int | None, role: str, text: str) -> None:
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        if turn is not None:
            self.distinct += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.inserted(audit)
        move = audit[self.at]
        self.at += 1
        if move == "K":
            self.state = STATE[role[:1]]
            self.emit(role, text)
        elif move == "R":
            self.emit(self.expected(), text)

    def result(self, audit: str) -> dict:
        self.inserted(audit)
        codes = "".join(self.codes)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        counts = {"gaps": gaps, "blank": codes.count("b"), "duplicate": codes.count("d"), "truncated": sum(c.isupper() for c in codes), "illegal": self.illegal}
        return {"conv_id": self.conv, **counts, "cost": self.cost, "audit": audit, "repaired_sha256": self.sha.hexdigest()}


def repair(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    ``turns`` has conv_id, turn, role and text. ``conversations`` may name more conv_id than those that have turns.
    """
    rows = _turns(turns)
    codes = cut_lineage(turn_codes(rows))
    ids = (turns if conversations is None else conversations).select(F.col("conv_id").cast("long")).distinct().select(_key().alias("key"), "conv_id")
    # One stream per conversation: its id, its plan, then its turns in order.
    none = lambda kind: F.lit(None).cast(kind)
    layout = {"key": "string", "kind": "int", "seg": "long", "turn": "long", "role": "string", "digest": "binary", "text": "string", "codes": "string", "audit": "string", "cost": "long", "conv_id": "long"}

    def lay(df: DataFrame, kind: int) -> DataFrame:
        have = df.withColumn("kind", F.lit(kind))
        return have.select(*[(F.col(c).cast(t) if c in have.columns else none(t)).alias(c) for c, t in layout.items()])

    stream = lay(ids, 0).unionByName(lay(codes, 1)).unionByName(lay(audits(codes), 2)).unionByName(lay(rows, 3))
    stream = stream.repartition("key").sortWithinPartitions("key", "kind", "seg", "turn", "role", "digest")

    def run(batches):
        import pyarrow as pa

        number = [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        schema = pa.schema([("conv_id", pa.int64()), *number, ("audit", pa.string()), ("repaired_sha256", pa.string())])
        key, now, audit = None, None, None
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if now is None or r["key"] != key:
                    if now is not None:
                        done.append(now.result(audit if audit is not None else "".join(now.audit)))
                    key, now, audit = r["key"], _Repaired(), None
                if r["kind"] == 0:
                    now.conv = r["conv_id"]
                elif r["kind"] < 3:
                    now.plan(r["codes"], r["audit"], r["cost"])
                else:
                    audit = "".join(now.audit) if audit is None else audit
                    now.row(audit, r["turn"], r["role"], r["text"])
            yield pa.RecordBatch.from_pylist(done, schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.result(audit if audit is not None else "".join(now.audit))], schema)

    names = ", ".join(f"{c} long" for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return stream.mapInArrow(run, f"{names}, audit string, repaired_sha256 string").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage that depends on crc32 of "conv_id:turn" modulo 20.

    0 drops the row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it a user's. Nulls are one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.pmod(F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")), F.lit(20))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), space("role").alias("role"), space("text").alias("text"), harm.alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.filter("harm <> 0").select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "harm")
    copies = F.sequence(F.lit(1), F.when(F.col("harm") == 3, 2).otherwise(1))
    return rows.withColumn("copy", F.explode(copies)).select("conv_id", "turn", "role", "text")
