from repoloom.operators import dialog
from repoloom.functions import text as tx
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"
RESEARCH = [
    (1, 0, "user", "[DEEP RESEARCH] How does X work"),
    (1, 1, "assistant", "## Research Plan\nsteps"),
    (1, 2, "user", "[DEEP RESEARCH] Continue the research"),
]


def test_research_conversation(spark):
    df = spark.createDataFrame(RESEARCH, SCHEMA)
    r = dialog.research_state(df).first()
    assert (r.iteration, r.stage, r.question, r.is_continuation) == (2, "intermediate", "How does X work", True)
    assert dialog.dialog_turns(df).count() == 1


def test_odd_orders_give_no_pairs(spark):
    roles = ["user", "user", "assistant", "user"]
    df = spark.createDataFrame([(2, i, r, "t") for i, r in enumerate(roles)], SCHEMA)
    assert dialog.dialog_turns(df).count() == 0
    assert dialog.valid_requests(df).count() == 1


def test_prompt_text(spark):
    df = spark.createDataFrame(RESEARCH, SCHEMA)
    state = dialog.research_state(df).select("conv_id", "stage", "iteration", "question")
    req = (
        state.withColumn("repo_url", F.lit("https://github.com/o/r")).withColumn("repo_type", F.lit("github"))
        .withColumn("language", F.lit("xx")).withColumn("file_path", F.lit("a.py")).withColumn("file_content", F.lit("x=1"))
        .withColumn("context_text", F.lit(" \n"))
    )
    rows = dialog.prompt_sections(req, df, texts={"intermediate": "S {repo_name} {iteration} {language}"}).orderBy(
        "section_no", "part_no"
    ).collect()
    assert "".join(r.text for r in rows) == (
        "/no_think S r 2 English\n\n<conversation_history>\n<turn>\n<user>[DEEP RESEARCH] How does X work</user>\n<assistant>"
        "## Research Plan\nsteps</assistant>\n</turn>\n</conversation_history>\n\n"
        '<currentFileContent path="a.py">\nx=1\n</currentFileContent>\n\n'
        "<note>Answering without retrieval augmentation.</note>\n\n<query>\nHow does X work\n</query>\n\nAssistant: "
    )


def test_first_paragraph_and_contents(spark):
    rows = [("# T\n\nOne line.\n\nMore", "One line."), ("# T\nno gap", "No summary available"), ("# T\n\nends", "ends")]
    df = spark.createDataFrame(rows, "t string, want string")
    for r in df.select("*", tx.first_paragraph(F.col("t")).alias("got")).collect():
        assert r.got == r.want
    df = spark.createDataFrame([("# T\nintro\n## A b!\nx\n## C\n",), ("# T\n## Contents\n## A",), ("no heads",)], "t string")
    got = [r.g for r in df.select(tx.insert_contents(F.col("t")).alias("g")).collect()]
    assert got[0] == "# T\nintro\n## Table of Contents\n\n- [A b!](#a-b)\n- [C](#c)\n\n## A b!\nx\n## C\n"
    assert got[1:] == ["# T\n## Contents\n## A", "no heads"]
