"""Cleanup and assembly of streamed answer pieces (session, seq, piece)."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from repoloom.functions.text import clean_piece, is_metadata_piece
from repoloom.session import path_exists
from repoloom.streaming.versioned import VersionedTable, list_names, new_id, read_text, write_text


def clean_pieces(pieces: DataFrame) -> DataFrame:
    """Drop empty and metadata pieces and remove thinking tags; stateless, so batch and stream agree."""
    kept = pieces.filter((F.coalesce("piece", F.lit("")) != "") & ~is_metadata_piece(F.col("piece")))
    return kept.withColumn("piece", clean_piece(F.col("piece")))


PART_ROWS = 100_000
IDLE_SECONDS = 600
BUCKETS = 4096  # state keys; the pieces of one, as far as they are open, pass through memory
LIST_PIECES = 10_000
_ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _part(part_rows: int):
    return F.floor(F.col("seq") / part_rows).alias("part_no")


def assembled(pieces: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Answer text per session, in parts of at most ``part_rows`` pieces, however long a session grows."""
    rows = pieces.select("session", "seq", "piece", _part(part_rows))
    return rows.groupBy("session", "part_no").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("seq", "piece"))), lambda x: x["piece"]), ""
        ).alias("answer")
    )


class Assembler(StatefulProcessor):
    """Keeps the pieces of the open parts of a bucket of parts; gives out and forgets the parts for which none has come for a while.

    State: lists of pieces as they came, each with its time of arrival, and the times of the alarm and of the last arrival. A call to the state takes a whole
    list, so their number grows with the buckets, neither with the pieces nor with the parts. Of pieces with one number the last to arrive counts, of
    those that arrive together the greatest.

    An alarm reads the bucket once, and what stays open is written back with one piece a number. The next one comes when the first part may be closed, but
    not before an eighth of the idle time, so a piece is written back a bounded number of times, and a part is closed that much late at most.
    """

    def __init__(self, idle_seconds: float, session: str) -> None:
        self.idle = int(idle_seconds * 1000)
        self.session = session

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getListState("pieces", f"at long, sessions array<{self.session}>, parts array<long>, seqs array<long>, texts array<string>")
        self.alarm = handle.getValueState("alarm", "due long, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        due, last = self.alarm.get() or (None, None)
        at = now if last is None else max(now, last + 1)
        for pdf in rows:
            # Buckets below 0 hold the pieces without a session.
            sessions = pdf["session"].tolist() if key[0] >= 0 else [None] * len(pdf)
            self.pieces.appendValue((at, sessions, [int(x) for x in pdf["part_no"]], [int(x) for x in pdf["seq"]], pdf["piece"].tolist()))
        if due is None or due > now + self.idle:
            if due is not None:
                self.handle.deleteTimer(due)
            due = now + self.idle
            self.handle.registerTimer(due)
        self.alarm.update((due, at))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, last = timerValues.getCurrentProcessingTimeInMs(), self.alarm.get()[1]
        held: dict[tuple, dict[int, tuple[int, str]]] = {}
        for at, sessions, parts, seqs, texts in self.pieces.get():
            for session, part, seq, text in zip(sessions, parts, seqs, texts):
                mine = held.setdefault((session, part), {})
                mine[seq] = max(mine.get(seq, (at, text)), (at, text))
        closed, kept = [], []
        for part, mine in held.items():
            at = max(a for a, _ in mine.values())
            (closed if at + self.idle <= now else kept).append((at, part, mine))
        self.pieces.clear()
        self.alarm.clear()
        if kept:
            kept.sort(key=lambda x: x[0])
            due = max(kept[0][0] + self.idle, now + max(1, self.idle // 8))
            for at, group in itertools.groupby(kept, key=lambda x: x[0]):
                rows = ((part, seq, text) for _, part, mine in group for seq, (_, text) in mine.items())
                while some := list(itertools.islice(rows, LIST_PIECES)):
                    self.pieces.appendValue((at, [p[0] for p, _, _ in some], [p[1] for p, _, _ in some], [n for _, n, _ in some], [t for _, _, t in some]))
            self.handle.registerTimer(due)
            self.alarm.update((due, last))
        for i in range(0, len(closed), LIST_PIECES):
            out = [(part, sorted((n, t) for n, (_, t) in mine.items())) for _, part, mine in closed[i : i + LIST_PIECES]]
            yield pd.DataFrame(
                {
                    "session": [p[0] for p, _ in out], "part_no": [p[1] for p, _ in out],
                    "seqs": [[n for n, _ in rows] for _, rows in out], "texts": [[t for _, t in rows] for _, rows in out],
                }
            )

    def close(self) -> None:
        pass


def _last_pieces(runs: DataFrame) -> DataFrame:
    """session, part_no, seq, piece: the last to arrive of each number."""
    each = runs.select("session", "part_no", "run", F.explode(F.arrays_zip("seqs", "texts")).alias("p"))
    last = each.groupBy("session", "part_no", F.col("p.seqs").alias("seq")).agg(F.max(F.struct("run", "p.texts")).alias("l"))
    return last.select("session", "part_no", "seq", F.col("l.texts").alias("piece"), "l.run")


def _one_run(runs: DataFrame) -> DataFrame:
    """The runs of a part as one, under the name of the last."""
    piece = F.array_sort(F.collect_list(F.struct("seq", "piece")))
    rows = _last_pieces(runs).groupBy("session", "part_no").agg(F.max("run").alias("run"), piece.alias("p"))
    return rows.select("session", "part_no", F.col("p.seq").alias("seqs"), F.col("p.piece").alias("texts"), "run")


def stream_names(spark: SparkSession, store: str) -> dict[str, str]:
    """Checkpoint of every stream that has written to a store, by a name that rises with its start."""
    return {name: read_text(spark, f"{store}/streams/{name}") for name in list_names(spark, f"{store}/streams")}


def _stream_name(spark: SparkSession, store: str, checkpoint: str) -> str:
    for name, known in stream_names(spark, store).items():
        if known == checkpoint:
            return name
    name = new_id()
    write_text(spark, f"{store}/streams/{name}", checkpoint)
    return name


def closed_runs(spark: SparkSession, store: str) -> VersionedTable:
    """Pieces of parts that have been closed, one row each time; compaction joins the rows of a part."""
    return VersionedTable(spark, f"{store}/runs", "session", _one_run)


def assembly_stream(
    spark: SparkSession, pieces: DataFrame, store: str, checkpoint: str, part_rows: int = PART_ROWS, idle_seconds: float = IDLE_SECONDS
):
    """Assemble answers from pieces that may come late, repeatedly and in any order.

    Open parts are kept in the stream's state (RocksDB), in buckets by (session, part_no). A part without new pieces for ``idle_seconds`` is closed: its
    pieces go to the store, its state goes. A piece that comes later opens the part anew and joins the earlier ones when it is closed again, so
    none is ever lost; state and each batch are bounded by what is open. ``stored_answers`` reads both. Where a stream begins anew, with
    another checkpoint, what it reads again counts as arrived last.
    """
    name = _stream_name(spark, store, checkpoint)
    fresh = clean_pieces(pieces).select("session", _part(part_rows), "seq", "piece")
    kind = fresh.schema["session"].dataType
    out = T.StructType([T.StructField("session", kind), T.StructField("part_no", T.LongType()), T.StructField("seqs", T.ArrayType(T.LongType())), T.StructField("texts", T.ArrayType(T.StringType()))])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS_DB)
    # Alarms wait for the next pieces; else a run over what there is now would go on until the last alarm.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    # A null among integers would turn them into floats on their way; such rows have buckets of their own and any session instead.
    bucket = F.pmod(F.xxhash64("session", "part_no"), F.lit(BUCKETS)).cast("int")
    dealt = fresh.withColumn("bucket", F.when(F.col("session").isNull(), -1 - bucket).otherwise(bucket)).withColumn(
        "session", F.coalesce("session", F.lit("0").try_cast(kind))
    )
    closed = dealt.groupBy("bucket").transformWithStateInPandas(Assembler(idle_seconds, kind.simpleString()), out, "append", "ProcessingTime")
    table = closed_runs(spark, store)

    def batch(rows: DataFrame, epoch: int) -> None:
        kept = rows.withColumn("run", F.lit(f"{name}/{new_id()}")).persist()
        try:
            count = kept.count()
            if count:
                table.append(kept, count)
                table.compact()
        finally:
            kept.unpersist()

    query = closed.writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _open_arrivals(spark: SparkSession, checkpoint: str) -> DataFrame:
    """session, part_no, seq, piece, at: all that has come for the parts that a stream holds open."""
    state = spark.read.format("statestore").option("stateVarName", "pieces").load(checkpoint).select("list_element.*")
    each = state.select("at", F.explode(F.arrays_zip("sessions", "parts", "seqs", "texts")).alias("p"))
    return each.select(F.col("p.sessions").alias("session"), F.col("p.parts").alias("part_no"), F.col("p.seqs").alias("seq"), F.col("p.texts").alias("piece"), "at")


def open_pieces(spark: SparkSession, checkpoint: str) -> DataFrame:
    """session, part_no, seq, piece of the parts that a stream holds open, from its checkpoint."""
    last = F.max_by("piece", F.struct("at", "piece")).alias("piece")
    return _open_arrivals(spark, checkpoint).groupBy("session", "part_no", "seq").agg(last)


def stored_answers(spark: SparkSession, store: str) -> DataFrame:
    """Text of every (session, part_no) taken in so far, open or closed."""
    runs = closed_runs(spark, store).read()
    rows = [] if runs is None else [runs.select("session", "part_no", "run", F.explode(F.arrays_zip("seqs", "texts")).alias("p")).select("session", "part_no", F.col("p.seqs").alias("seq"), F.col("p.texts").alias("piece"), "run")]
    for name, checkpoint in stream_names(spark, store).items():
        if path_exists(spark, f"{checkpoint}/state"):
            # What a stream holds open has arrived behind all that it has closed.
            run = F.concat(F.lit(f"{name}/~"), F.lpad(F.col("at").cast("string"), 20, "0"))
            rows.append(_open_arrivals(spark, checkpoint).select("session", "part_no", "seq", "piece", run.alias("run")))
    every = functools.reduce(DataFrame.unionByName, rows)
    last = every.groupBy("session", "part_no", "seq").agg(F.max_by("piece", F.struct("run", "piece")).alias("piece"))
    pieces = F.array_sort(F.collect_list(F.struct("seq", "piece")))
    return last.groupBy("session", "part_no").agg(F.array_join(F.transform(pieces, lambda x: x["piece"]), "").alias("answer"))
