"""Conversation, research and prompt queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from repoloom.functions import fixed
from repoloom.operators import dialog
from repoloom.plans.catalog import register
from repoloom.plans.views import sql_text, table

NL = "chr(10)"

# Every fifth conversation is a research: its user messages are tagged, later ones ask to continue.
_CHAT_SQL = f"""chat AS (
  SELECT conv_id, turn, role, CASE WHEN conv_id % 5 = 0 AND role = 'user' AND turn > 1 THEN '[DEEP RESEARCH] Continue the research'
    WHEN conv_id % 5 = 0 AND role = 'user' THEN '[DEEP RESEARCH] ' || text
    WHEN conv_id % 5 = 0 AND role = 'assistant' AND turn = 1 THEN '## Research Plan' || {NL} || text
    WHEN conv_id % 5 = 0 AND role = 'assistant' THEN '## Research Update ' || ((turn + 1) // 2) || {NL} || text ELSE text END AS text
  FROM conversations),
last AS (SELECT conv_id, max(turn) AS last_turn, arg_max(role, turn) AS last_role, arg_max(text, turn) AS last_text FROM chat GROUP BY 1)"""


def chat(spark, sf_dir):
    c, t, role = F.col("conv_id"), F.col("turn"), F.col("role")
    research = c % 5 == 0
    n = F.floor((t + 1) / 2).cast("string")
    body = (
        F.when(research & (role == "user") & (t > 1), "[DEEP RESEARCH] Continue the research")
        .when(research & (role == "user"), F.concat(F.lit("[DEEP RESEARCH] "), "text"))
        .when(research & (role == "assistant") & (t == 1), F.concat(F.lit("## Research Plan\n"), "text"))
        .when(research & (role == "assistant"), F.concat(F.lit("## Research Update "), n, F.lit("\n"), "text"))
        .otherwise(F.col("text"))
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", body.alias("text"))


@register("b7_valid_requests", f"WITH {_CHAT_SQL} SELECT conv_id, last_turn, last_role, last_text FROM last WHERE last_role = 'user'")
def valid_requests(spark, sf_dir):
    return dialog.valid_requests(chat(spark, sf_dir))


@register(
    "b8_oversize_questions",
    f"WITH {_CHAT_SQL} SELECT conv_id, (length(last_text) // 4)::BIGINT AS tokens, length(last_text) // 4 > 60 AS input_too_large FROM last",
)
def oversize_questions(spark, sf_dir):
    return dialog.size_flags(chat(spark, sf_dir), 60)


_STATE_SQL = f"""{_CHAT_SQL},
trimmed AS (SELECT *, trim(replace(text, '[DEEP RESEARCH]', ''), ' ' || {NL} || chr(9)) AS bare FROM chat),
agg AS (SELECT conv_id, bool_or(contains(text, '[DEEP RESEARCH]')) AS is_research, count(*) FILTER (role = 'assistant') AS answers,
    arg_min(bare, turn) FILTER (role = 'user' AND NOT contains(lower(text), 'continue')) AS topic,
    arg_max(CASE WHEN contains(text, '[DEEP RESEARCH]') THEN bare ELSE text END, turn) AS last_text FROM trimmed GROUP BY 1),
state AS (SELECT conv_id, is_research, CASE WHEN is_research THEN answers + 1 ELSE 1 END AS iteration, topic, last_text,
    is_research AND contains(lower(last_text), 'continue') AND contains(lower(last_text), 'research') AS is_continuation FROM agg),
research AS (SELECT conv_id, is_research, iteration, CASE WHEN NOT is_research THEN 'chat' WHEN iteration = 1 THEN 'first'
    WHEN iteration >= 5 THEN 'final' ELSE 'intermediate' END AS stage, is_continuation,
    CASE WHEN is_continuation AND topic <> '' THEN topic ELSE last_text END AS question FROM state)"""


@register(
    "b12_d10_e4_research_state",
    f"WITH {_STATE_SQL} SELECT conv_id, is_research, iteration, stage, is_continuation, question FROM research",
)
def research_state(spark, sf_dir):
    return dialog.research_state(chat(spark, sf_dir))


@register(
    "d10_stage_counts",
    f"WITH {_STATE_SQL} SELECT stage, iteration, count(*) AS conversations FROM research GROUP BY ALL",
)
def stage_counts(spark, sf_dir):
    return dialog.research_state(chat(spark, sf_dir)).groupBy("stage", "iteration").agg(
        F.count(F.lit(1)).alias("conversations")
    )


_TURNS_SQL = f"""{_STATE_SQL},
turns AS (SELECT a.conv_id, a.turn // 2 AS pair_no, a.text AS user_query, b.text AS assistant_response
  FROM chat a JOIN chat b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
  WHERE a.turn % 2 = 0 AND a.role = 'user' AND b.role = 'assistant')"""


@register("e3_dialog_turns", f"WITH {_TURNS_SQL} SELECT conv_id, pair_no, user_query, assistant_response FROM turns")
def dialog_turns(spark, sf_dir):
    return dialog.dialog_turns(chat(spark, sf_dir))


_BLOCK = f"'<turn>' || {NL} || '<user>' || user_query || '</user>' || {NL} || '<assistant>' || assistant_response || '</assistant>' || {NL} || '</turn>' || {NL}"


@register(
    "h31_history",
    f"WITH {_TURNS_SQL} SELECT conv_id, pair_no // 2 AS part_no, string_agg({_BLOCK}, '' ORDER BY pair_no) AS history FROM turns GROUP BY 1, 2",
)
def history(spark, sf_dir):
    return dialog.history_parts(chat(spark, sf_dir), part_turns=2)


@register(
    "e11_latest_stages",
    f"""WITH {_CHAT_SQL}, answers AS (SELECT conv_id, (turn // 4 + 1) AS iteration, turn, text FROM chat WHERE role = 'assistant'),
    staged AS (SELECT *, CASE WHEN iteration = 1 AND contains(text, '## Research Plan') THEN 'plan'
      WHEN iteration BETWEEN 1 AND 4 AND contains(text, '## Research Update ' || iteration) THEN 'update' END AS type FROM answers)
    SELECT conv_id, iteration, type, CASE type WHEN 'plan' THEN 'Research Plan' ELSE 'Research Update ' || iteration END AS title,
      arg_max(text, turn) AS content FROM staged WHERE type IS NOT NULL GROUP BY 1, 2, 3, 4""",
)
def latest_stages(spark, sf_dir):
    answers = chat(spark, sf_dir).filter("role = 'assistant'").select(
        "conv_id", (F.floor(F.col("turn") / 4) + 1).alias("iteration"), F.col("turn").alias("seq"), "text"
    )
    return dialog.latest_stages(answers, ["conv_id"])


@register(
    "d13_answers",
    f"SELECT conv_id, turn // 3 AS part_no, string_agg(role || ':' || text, '' ORDER BY turn) AS answer FROM conversations GROUP BY 1, 2",
)
def answers(spark, sf_dir):
    pieces = table(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").alias("seq"), F.concat("role", F.lit(":"), "text").alias("piece")
    )
    return dialog.answer_parts(pieces, ["conv_id"], part_rows=3)


def _requests(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), "source", "lang", "text")
    state = dialog.research_state(chat(spark, sf_dir))
    url = F.concat(F.lit("https://github.com/"), F.coalesce("source", F.lit("none")), F.lit("/r"), F.col("conv_id").cast("string"))
    return state.join(docs, "conv_id", "left").select(
        "conv_id", url.alias("repo_url"), F.lit("github").alias("repo_type"), F.col("lang").alias("language"), "stage",
        "iteration", "question",
        F.when(F.col("conv_id") % 4 == 0, "a.py").alias("file_path"),
        F.when(F.col("conv_id") % 4 == 0, F.col("text")).alias("file_content"),
        F.when(F.col("conv_id") % 3 == 0, F.col("text")).otherwise("").alias("context_text"),
        F.concat(F.lit("#summary "), F.col("conv_id").cast("string")).alias("summary_text"),
    )


def _prompt_sql(with_summary: bool) -> str:
    stages = dialog.SYSTEM_TEXTS
    case = "CASE stage " + " ".join(f"WHEN '{k}' THEN {sql_text(v)}" for k, v in stages.items()) + " END"
    filled = case
    for mark, value in {
        "{repo_type}": "'github'", "{repo_url}": "repo_url", "{repo_name}": "'r' || conv_id",
        "{iteration}": "iteration::VARCHAR",
        "{language}": "CASE lang WHEN 'es' THEN 'Spanish (Español)' WHEN 'fr' THEN 'Français (French)' ELSE 'English' END",
    }.items():
        filled = f"replace({filled}, '{mark}', {value})"
    start, end = f"'{fixed.CONTEXT_START}' || {NL}", f"{NL} || '{fixed.CONTEXT_END}' || {NL} || {NL}"
    note = f"'{fixed.NO_RETRIEVAL_NOTE}' || {NL} || {NL}"
    has = "conv_id % 3 = 0 AND trim(coalesce(text, ''), ' ' || chr(10)) <> ''"
    if with_summary:
        summary = "'#summary ' || conv_id"
        context = f"CASE WHEN {has} THEN {start} || text || {NL} || {summary} || {end} ELSE {start} || {summary} || {end} || {note} END"
    else:
        context = f"CASE WHEN {has} THEN {start} || text || {end} ELSE {note} END"
    return f"""WITH {_TURNS_SQL}, req AS (
      SELECT r.*, d.lang, d.text, 'https://github.com/' || coalesce(d.source, 'none') || '/r' || conv_id AS repo_url
      FROM research r LEFT JOIN documents d ON d.doc_id = r.conv_id)
    SELECT conv_id, 10::BIGINT AS section_no, 0::BIGINT AS part_no, '/no_think ' || {filled} || {NL} || {NL} AS text FROM req
    UNION ALL SELECT conv_id, 20, 0, '<conversation_history>' || {NL} FROM turns GROUP BY conv_id
    UNION ALL SELECT conv_id, 21, 0, string_agg({_BLOCK}, '' ORDER BY pair_no) FROM turns GROUP BY conv_id
    UNION ALL SELECT conv_id, 22, 0, '</conversation_history>' || {NL} || {NL} FROM turns GROUP BY conv_id
    UNION ALL SELECT conv_id, 30, 0, '<currentFileContent path="a.py">' || {NL} || text || {NL} || '</currentFileContent>' || {NL} || {NL}
      FROM req WHERE conv_id % 4 = 0 AND text <> ''
    UNION ALL SELECT conv_id, 40, 0, {context} FROM req
    UNION ALL SELECT conv_id, 50, 0, '<query>' || {NL} || question || {NL} || '</query>' || {NL} || {NL} || 'Assistant: ' FROM req"""


@register("h32_prompts", _prompt_sql(False))
def prompts(spark, sf_dir):
    return dialog.prompt_sections(_requests(spark, sf_dir), chat(spark, sf_dir))


@register("h32_prompts_with_summary", _prompt_sql(True))
def prompts_with_summary(spark, sf_dir):
    return dialog.prompt_sections(_requests(spark, sf_dir), chat(spark, sf_dir), with_summary=True)


@register(
    "c11_repository_records",
    """SELECT c.conv_id, d.source || '_' || d.lang AS repo_key, coalesce(s.j, '{}') AS summary_json, coalesce(g.j, '{}') AS call_chain_json
    FROM (SELECT DISTINCT conv_id FROM conversations) c JOIN documents d ON d.doc_id = c.conv_id
    LEFT JOIN (SELECT source || '_en' AS k, '{"n":' || count(*) || '}' AS j FROM documents GROUP BY source) s ON s.k = d.source || '_' || d.lang
    LEFT JOIN (SELECT source || '_fr' AS k, '{"m":' || max(doc_id) || '}' AS j FROM documents GROUP BY source) g ON g.k = d.source || '_' || d.lang""",
)
def repository_records(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    asked = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    requests = asked.join(docs, "doc_id").select(
        F.col("doc_id").alias("conv_id"), F.concat("source", F.lit("_"), "lang").alias("repo_key")
    )
    per_source = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("m"))
    summaries = per_source.select(
        F.concat("source", F.lit("_en")).alias("repo_key"), F.to_json(F.struct("n")).alias("summary_json")
    )
    chains = per_source.select(
        F.concat("source", F.lit("_fr")).alias("repo_key"), F.to_json(F.struct("m")).alias("call_chain_json")
    )
    return dialog.with_repository_records(requests, summaries, chains)
