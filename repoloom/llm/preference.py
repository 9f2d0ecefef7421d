"""Preference formatting: one shared prompt and two masked completions for each pair of conversations.

Input rows are turns: ``pair_id``, ``side`` (chosen or rejected), ``turn``, ``role``, ``text``. The longest common turn prefix
of both sides is found without bringing a conversation together: turns are numbered in each side, both sides meet on
(pair_id, position) as digests, and the first position where they differ is one minimum per pair. The prefix is rendered once
as ``prompt``; what follows it on each side is rendered as ``chosen`` and ``rejected``. In completions the characters of
assistant turns, end mark included, are trained on; all else is masked.

A conversation may be of any length: every segment comes in parts of at most ``part_turns`` turns (``part_no`` from 0, one part
for usual lengths), to be read one after the other, so no task holds a whole hot conversation.

Edge cases: turns with a null pair_id or turn, and sides other than the two, are not used; a null role is ``unknown``, a null text is empty. Exact
repeats of a turn count once; turns with the same number are ordered by role and text. If a side has no turn, its completion has no
row and the prompt is empty, too. If both sides are equal, all is prompt. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoloom.operators.ordered import number_rows

HOT_TURNS = 1000
END = "<|im_end|>\n"


def _header(role: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"))


def first_difference(turns: DataFrame) -> DataFrame:
    """pair_id and the position of the first turn that differs or that one side lacks; no row for equal sides."""
    digest = F.md5(F.concat(F.col("role"), F.lit("\0"), F.col("text")))
    met = turns.groupBy("pair_id", "pos").agg(
        F.max(F.when(F.col("side") == "chosen", digest)).alias("a"), F.max(F.when(F.col("side") == "rejected", digest)).alias("b")
    )
    return met.filter(~F.col("a").eqNullSafe(F.col("b"))).groupBy("pair_id").agg(F.min("pos").alias("common"))


def format_pairs(turns: DataFrame, part_turns: int = 64, trained_role: str = "assistant") -> DataFrame:
    """pair_id, segment, part_no, n_turns, text, spans (trained characters of the part as start, end)."""
    rows = turns.select(
        "pair_id", "side", "turn", F.coalesce(F.col("role"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    ).filter(F.col("pair_id").isNotNull() & F.col("turn").isNotNull() & F.col("side").isin("chosen", "rejected"))
    numbered = number_rows(rows.distinct(), ["pair_id", "side"], ["turn", "role", "text"], "pos", hot_rows=HOT_TURNS)
    marked = numbered.join(first_difference(numbered), "pair_id", "left")
    shared = F.col("common").isNull() | (F.col("pos") < F.col("common"))
    pieces = (
        marked.filter(~shared | (F.col("side") == "chosen"))
        .select(
            "pair_id",
            F.when(shared, F.lit("prompt")).otherwise(F.col("side")).alias("segment"),
            F.when(shared, F.col("pos")).otherwise(F.col("pos") - F.col("common")).alias("at"),
            F.concat(_header(F.col("role")), "text", F.lit(END)).alias("piece"),
            F.length(_header(F.col("role"))).alias("head"),
            (~shared & (F.col("role") == trained_role)).alias("trained"),
        )
        .withColumn("part_no", F.floor(F.col("at") / part_turns))
    )
    parts = pieces.groupBy("pair_id", "segment", "part_no").agg(
        F.array_sort(F.collect_list(F.struct("at", "piece", "head", "trained"))).alias("list")
    )
    # Offsets of the turns inside the part: running length, over at most part_turns elements.
    offsets = F.transform(
        "list",
        lambda x, i: F.struct(
            F.aggregate(F.slice(F.col("list"), F.lit(1), i), F.lit(0), lambda a, y: a + F.length(y["piece"])).alias("base"),
            x["head"].alias("head"),
            F.length(x["piece"]).alias("size"),
            x["trained"].alias("trained"),
        ),
    )
    return parts.select(
        "pair_id",
        "segment",
        "part_no",
        F.size("list").cast("long").alias("n_turns"),
        F.array_join(F.transform("list", lambda x: x["piece"]), "").alias("text"),
        F.transform(
            F.filter(offsets, lambda x: x["trained"]),
            lambda x: F.struct((x["base"] + x["head"]).alias("start"), (x["base"] + x["size"]).alias("end")),
        ).alias("spans"),
    )


def pairs_from_conversations(conversations: DataFrame, reply: str = "assistant") -> DataFrame:
    """Turns of one pair per conversation with a reply: as it is, against its last reply cut after the first line.

    ``chosen`` runs to the end of the conversation, ``rejected`` ends with the cut reply. Rows without conv_id or turn are not used; of
    several rows with the number of the last reply all are cut.
    """
    rows = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text").filter("conv_id is not null and turn is not null")
    last = rows.filter(F.col("role") == reply).groupBy("pair_id").agg(F.max("turn").alias("last"))
    own = rows.join(last, "pair_id")
    sides = own.withColumn("side", F.explode(F.array(F.lit("chosen"), F.lit("rejected"))))
    cut = (F.col("side") == "rejected") & (F.col("turn") == F.col("last")) & (F.col("role") == reply)
    return sides.filter((F.col("side") == "chosen") | (F.col("turn") <= F.col("last"))).select(
        "pair_id", "side", "turn", "role", F.when(cut, F.substring_index("text", "\n", 1)).otherwise(F.col("text")).alias("text")
    )


SQL = f"""
with r as (select conv_id as pair_id, turn, role, text from conversations where conv_id is not null and turn is not null),
l as (select pair_id, max(turn) as last from r where role = 'assistant' group by pair_id),
t as (select distinct pair_id, side, turn, coalesce(role, 'unknown') as role,
        coalesce(case when side = 'rejected' and turn = last and role = 'assistant' then split_part(text, chr(10), 1) else text end, '') as text
      from r join l using (pair_id) cross join (values ('chosen'), ('rejected')) s(side)
      where side = 'chosen' or turn <= last),
n as (select *, row_number() over (partition by pair_id, side order by turn, role, text) - 1 as pos from t),
a as (select * from n where side = 'chosen'), b as (select * from n where side = 'rejected'),
d as (select coalesce(a.pair_id, b.pair_id) as pair_id, min(coalesce(a.pos, b.pos)) as common
      from a full join b on a.pair_id = b.pair_id and a.pos = b.pos
      where a.role is distinct from b.role or a.text is distinct from b.text group by 1),
p as (select n.pair_id, side, pos, role, common is null or pos < common as shared, coalesce(common, 0) as common,
        '<|im_start|>' || role || chr(10) as head, '<|im_start|>' || role || chr(10) || text || '{END.strip()}' || chr(10) as piece
      from n left join d on n.pair_id = d.pair_id),
q as (select pair_id, case when shared then 'prompt' else side end as segment, case when shared then pos else pos - common end as place, head, piece,
        not shared and role = 'assistant' as trained from p where not shared or side = 'chosen'),
o as (select *, place // 64 as part_no,
        coalesce(sum(length(piece)) over (partition by pair_id, segment, place // 64 order by place rows between unbounded preceding and 1 preceding), 0) as base from q)
select pair_id, segment, cast(part_no as bigint) as part_no, count(*) as n_turns, string_agg(piece, '' order by place) as text,
  coalesce(string_agg(cast(base + length(head) as bigint) || ':' || cast(base + length(piece) as bigint), ',' order by place) filter (where trained), '') as spans
from o group by 1, 2, 3
"""
