"""Queries of exact token counts: with a small vocabulary that SQL can follow, and with a public one."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from repoloom.operators import dialog, filters
from repoloom.operators import tokens as tk
from repoloom.plans.catalog import register
from repoloom.plans.corpus import _CLASSIFIED
from repoloom.plans.dialogs import _CHAT_SQL, chat
from repoloom.plans.views import FILES_SQL, files, table

# Shorter pieces first, so that merging by rank is the same as replacing piece by piece.
MERGES = ["an", "de", "en", "er", "in", "le", "on", "re", "th", "ti", "and", "der", "ent", "ing", "the", "tion", "ment"]
LETTERS = r"[A-Za-z]+|[^A-Za-z]"


def _count_sql(text: str) -> str:
    """Tokens of ``text``: every character is marked, known neighbours are joined, bytes beyond one per character are added."""
    marked = rf"regexp_replace(translate({text}, '<>', '..'), '([\s\S])', '<\1>', 'g')"
    known = set("abcdefghijklmnopqrstuvwxyz") | set(MERGES)
    for m in MERGES:
        for i in range(1, len(m)):
            if m[:i] in known and m[i:] in known:
                marked = f"replace({marked}, '<{m[:i]}><{m[i:]}>', '<{m}>')"
    marked = f"coalesce({marked}, '')"
    return f"(length({marked}) - length(replace({marked}, '<', '')) + coalesce(strlen({text}) - length({text}), 0))::BIGINT"


def _small(spark):
    return tk.token_counts(spark, tk.byte_ranks(MERGES), LETTERS)


@register("u4_byte_pair_counts", f"SELECT doc_id, {_count_sql('text')} AS tokens FROM documents")
def byte_pair_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", _small(spark)(F.col("text")).alias("tokens"))


@register("u4_vocabulary_counts")
def vocabulary_counts(spark, sf_dir):
    """Counts by a public vocabulary of 50,256 pieces; a test compares them with its reference encoding."""
    import public_tokenizers

    ranks = tk.read_ranks(spark, Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).as_uri())
    return table(spark, sf_dir, "documents").select("doc_id", tk.token_counts(spark, ranks)(F.col("text")).alias("tokens"))


@register(
    "b4_exact_size_gate",
    f"""WITH {FILES_SQL}, {_CLASSIFIED}, counted AS (SELECT file_no, is_code, {_count_sql('text')} AS token_count FROM classified)
    SELECT file_no, token_count FROM counted WHERE token_count <= CASE WHEN is_code THEN 900 ELSE 300 END""",
)
def exact_size_gate(spark, sf_dir):
    """The size gate on exact counts."""
    gated = filters.size_gate(filters.classify(files(spark, sf_dir)), _small(spark)(F.col("text")), 900, 300)
    return gated.select("file_no", "token_count")


@register(
    "b8_exact_oversize_questions",
    f"""WITH {_CHAT_SQL}, counted AS (SELECT conv_id, {_count_sql('last_text')} AS tokens FROM last)
    SELECT conv_id, tokens, tokens > 200 AS input_too_large FROM counted""",
)
def exact_oversize_questions(spark, sf_dir):
    """Oversize flags on exact counts."""
    return dialog.size_flags(chat(spark, sf_dir), 200, _small(spark))
