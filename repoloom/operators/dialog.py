"""Conversation operators over rows (conv_id, turn, role, text).

``turn`` is the 0-based position of a message in its conversation. Everything
here is an aggregate with partial aggregation (sorted where it takes a text with it) or a join on (conv_id, turn
number), so a conversation that holds most of the rows does not pile up in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoloom.functions import fixed
from repoloom.functions import text as tx
from repoloom.functions.paths import strip
from repoloom.operators.filters import question_too_large
from repoloom.operators.ordered import text_parts


def last_messages(messages: DataFrame) -> DataFrame:
    """Last message of each conversation."""
    return messages.groupBy("conv_id").agg(
        F.max_by(F.struct("role", "text"), "turn").alias("m"), F.max("turn").alias("last_turn")
    ).select("conv_id", "last_turn", F.col("m.role").alias("last_role"), F.col("m.text").alias("last_text"))


def valid_requests(messages: DataFrame) -> DataFrame:
    """Conversations whose last message comes from the user."""
    return last_messages(messages).filter(F.col("last_role") == "user")


# Transport of a question -> its token limit.
QUESTION_LIMITS = {"socket": fixed.SOCKET_QUESTION_TOKENS, "http": fixed.HTTP_QUESTION_TOKENS}


def size_flags(
    messages: DataFrame, limit: int = QUESTION_LIMITS["socket"], tokens: Callable[[Column], Column] = tx.token_estimate
) -> DataFrame:
    """Last message of each conversation with its tokens (an estimate, or exact counts) and the oversize flag."""
    counted = last_messages(messages).select("conv_id", tokens(F.col("last_text")).alias("tokens"))
    return counted.withColumn("input_too_large", question_too_large(F.col("tokens"), limit, lambda n: n))


def dialog_turns(messages: DataFrame) -> DataFrame:
    """Messages (0,1), (2,3), ... kept where a user message is followed by an assistant message."""
    pair = F.floor(F.col("turn") / 2).cast("long")
    even = F.col("turn") % 2 == 0
    return (
        messages.groupBy("conv_id", pair.alias("pair_no"))
        .agg(
            F.max(F.when(even, F.struct("role", "text"))).alias("a"),
            F.max(F.when(~even, F.struct("role", "text"))).alias("b"),
        )
        .filter((F.col("a.role") == "user") & (F.col("b.role") == "assistant"))
        .select(
            "conv_id",
            "pair_no",
            F.col("a.text").alias("user_query"),
            F.col("b.text").alias("assistant_response"),
        )
    )


def history_parts(messages: DataFrame, part_turns: int = 1000) -> DataFrame:
    """Conversation block of paired turns, in parts of at most ``part_turns`` turns."""
    turn = F.concat(
        F.lit("<turn>\n<user>"), F.col("user_query"), F.lit("</user>\n<assistant>"),
        F.col("assistant_response"), F.lit("</assistant>\n</turn>\n"),
    )
    return text_parts(
        dialog_turns(messages), ["conv_id"], F.col("pair_no"), turn, F.col("pair_no"), "", part_turns, "history"
    )


def research_state(messages: DataFrame) -> DataFrame:
    """Per conversation: research flag, iteration, stage prompt, continuation and the question to answer."""
    tagged = F.col("text").contains(fixed.RESEARCH_TAG)
    untagged = strip(F.replace(F.col("text"), F.lit(fixed.RESEARCH_TAG), F.lit("")))
    is_topic = (F.col("role") == "user") & ~F.lower(F.col("text")).contains("continue")
    per_conv = messages.groupBy("conv_id").agg(
        F.bool_or(F.coalesce(tagged, F.lit(False))).alias("is_research"),
        F.count_if(F.col("role") == "assistant").alias("assistant_messages"),
        F.max_by(F.col("text"), F.col("turn")).alias("last_raw"),
        # Only the last message loses its tag before the topic is looked up; the topic loses it anyway.
        F.min_by(F.when(is_topic, untagged), F.when(is_topic, F.col("turn"))).alias("topic"),
    )
    iteration = F.when(F.col("is_research"), F.col("assistant_messages") + 1).otherwise(F.lit(1))
    last = F.when(
        F.col("last_raw").contains(fixed.RESEARCH_TAG),
        strip(F.replace(F.col("last_raw"), F.lit(fixed.RESEARCH_TAG), F.lit(""))),
    ).otherwise(F.col("last_raw"))
    rows = per_conv.select("conv_id", "is_research", iteration.alias("iteration"), "topic", last.alias("last_text"))
    continues = (
        F.col("is_research")
        & F.lower(F.col("last_text")).contains("continue")
        & F.lower(F.col("last_text")).contains("research")
    )
    stage = (
        F.when(~F.col("is_research"), "chat")
        .when(F.col("iteration") == 1, "first")
        .when(F.col("iteration") >= fixed.FINAL_ITERATION, "final")
        .otherwise("intermediate")
    )
    return rows.select(
        "conv_id",
        "is_research",
        "iteration",
        stage.alias("stage"),
        F.coalesce(continues, F.lit(False)).alias("is_continuation"),
        F.when(continues & (F.coalesce("topic", F.lit("")) != ""), F.col("topic"))
        .otherwise(F.col("last_text"))
        .alias("question"),
    )


def latest_stages(answers: DataFrame, keys: list[str]) -> DataFrame:
    """Last stage per (keys, iteration, type) of research answers (keys, iteration, seq, text)."""
    rows = answers.withColumn("s", tx.research_stage(F.col("text"), F.col("iteration"))).filter("s IS NOT NULL")
    return rows.groupBy(*keys, "iteration", F.col("s.type").alias("type")).agg(
        F.max_by(F.struct(F.col("s.title").alias("title"), F.col("text").alias("content")), F.col("seq")).alias("v"),
    ).select(*keys, "iteration", "type", F.col("v.title").alias("title"), F.col("v.content").alias("content"))


def answer_parts(pieces: DataFrame, keys: list[str], part_rows: int = 100_000) -> DataFrame:
    """Stream pieces (keys, seq, piece) -> the answer text, in parts of at most ``part_rows`` pieces."""
    return text_parts(pieces, keys, F.col("seq"), F.col("piece"), F.col("seq"), "", part_rows, "answer")


# Short stand-ins for the system texts; callers pass their own.
SYSTEM_TEXTS = {
    "chat": "You answer questions about the {repo_type} repository {repo_url} ({repo_name}). Respond in {language}.",
    "first": "You plan a research on the {repo_type} repository {repo_url} ({repo_name}). Respond in {language}.",
    "intermediate": "You continue the research on {repo_url} ({repo_name}), iteration {iteration}. Respond in {language}.",
    "final": "You conclude the research on {repo_url} ({repo_name}), iteration {iteration}. Respond in {language}.",
}


def system_text(
    stage: Column, repo_type: Column, repo_url: Column, iteration: Column, language: Column,
    texts: dict[str, str] | None = None,
) -> Column:
    """System text of a stage with its placeholders filled in."""
    out = None
    for name, template in (texts or SYSTEM_TEXTS).items():
        out = F.when(stage == name, template) if out is None else out.when(stage == name, template)
    values = {
        "{repo_type}": repo_type,
        "{repo_url}": repo_url,
        "{repo_name}": F.substring_index(repo_url, "/", -1),
        "{iteration}": iteration.cast("string"),
        "{language}": language,
    }
    for mark, value in values.items():
        out = F.replace(out, F.lit(mark), value)
    return out


def prompt_sections(
    requests: DataFrame,
    messages: DataFrame,
    texts: dict[str, str] | None = None,
    with_summary: bool = False,
    part_turns: int = 1000,
) -> DataFrame:
    """Prompt of each request as ordered sections (conv_id, section_no, part_no, text).

    The prompt is the concatenation of the sections; a section without content is
    absent. requests: conv_id, repo_url, repo_type, language, stage, iteration,
    question, file_path, file_content, context_text and, with ``with_summary``,
    summary_text.
    """
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) != ""

    system = system_text(
        F.col("stage"), F.col("repo_type"), F.col("repo_url"), F.col("iteration"),
        tx.language_name(F.coalesce("language", F.lit(fixed.DEFAULT_LANGUAGE))), texts,
    )
    has_context = strip(F.coalesce("context_text", F.lit(""))) != ""
    start, end, note = fixed.CONTEXT_START, fixed.CONTEXT_END, fixed.NO_RETRIEVAL_NOTE + "\n\n"
    if with_summary:
        context = F.when(
            has_context,
            F.concat(F.lit(start + "\n"), F.col("context_text"), F.lit("\n"), F.col("summary_text"), F.lit(f"\n{end}\n\n")),
        ).otherwise(F.concat(F.lit(start + "\n"), F.col("summary_text"), F.lit(f"\n{end}\n\n{note}")))
    else:
        context = F.when(
            has_context, F.concat(F.lit(start + "\n"), F.col("context_text"), F.lit(f"\n{end}\n\n"))
        ).otherwise(F.lit(note))

    sections = F.array(
        F.struct(F.lit(10).alias("section_no"), F.concat(F.lit("/no_think "), system, F.lit("\n\n")).alias("text")),
        F.struct(
            F.lit(30).alias("section_no"),
            F.when(
                filled("file_content"),
                F.concat(
                    F.lit('<currentFileContent path="'), F.col("file_path"), F.lit('">\n'),
                    F.col("file_content"), F.lit("\n</currentFileContent>\n\n"),
                ),
            ).alias("text"),
        ),
        F.struct(F.lit(40).alias("section_no"), context.alias("text")),
        F.struct(
            F.lit(50).alias("section_no"),
            F.concat(F.lit("<query>\n"), F.col("question"), F.lit("\n</query>\n\nAssistant: ")).alias("text"),
        ),
    )
    fixed_part = (
        requests.select("conv_id", F.explode(sections).alias("s"))
        .select("conv_id", "s.section_no", F.lit(0).cast("long").alias("part_no"), "s.text")
        .filter("text IS NOT NULL")
    )
    history = history_parts(messages, part_turns).join(requests.select("conv_id"), "conv_id", "left_semi")
    turns = history.select("conv_id", F.lit(21).alias("section_no"), "part_no", F.col("history").alias("text"))
    marks = F.array(
        F.struct(F.lit(20).alias("n"), F.lit("<conversation_history>\n").alias("t")),
        F.struct(F.lit(22).alias("n"), F.lit("</conversation_history>\n\n").alias("t")),
    )
    # One mark pair per conversation with history, whatever its number of parts.
    with_history = dialog_turns(messages).select("conv_id").distinct().join(
        requests.select("conv_id"), "conv_id", "left_semi"
    )
    frame = with_history.select("conv_id", F.explode(marks).alias("m")).select(
        "conv_id", F.col("m.n").alias("section_no"), F.lit(0).cast("long").alias("part_no"), F.col("m.t").alias("text")
    )
    return fixed_part.unionByName(turns).unionByName(frame)


def with_repository_records(requests: DataFrame, summaries: DataFrame, chains: DataFrame) -> DataFrame:
    """Attach summary and call-chain records by repository key; missing ones become ``{}``."""
    empty = F.lit("{}")
    return (
        requests.join(summaries.select("repo_key", "summary_json"), "repo_key", "left")
        .join(chains.select("repo_key", "call_chain_json"), "repo_key", "left")
        .withColumn("summary_json", F.coalesce("summary_json", empty))
        .withColumn("call_chain_json", F.coalesce("call_chain_json", empty))
    )
