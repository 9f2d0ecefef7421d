from pyspark.sql import functions as F

from repoloom.operators import wiki

PAGE = (
    "<pages><page id=\"p1\"><title>A</title><relevant_files><file_path>a.py</file_path></relevant_files>"
    "<related_pages><related>p2</related><related>gone</related></related_pages></page>"
    "<page id=\"\"><title>B &amp; C</title><importance>urgent</importance></page></pages>"
)
SECTIONS = (
    "<sections><section id=\"s1\"><title>One</title><pages><page_ref>p1</page_ref></pages><subsections><section_ref>s2</section_ref>"
    "</subsections></section><section id=\"s2\"><title>Two</title></section><section id=\"s3\"><title>Three</title></section></sections>"
)
RESPONSES = {
    "good": f"<wiki_structure><title>T</title><description>D</description>{SECTIONS}{PAGE}</wiki_structure>",
    "amp": "<wiki_structure><title>R & D</title><pages><page id=\"p1\"><title>x & y</title></page></pages></wiki_structure>",
    "broken": "<wiki_structure><title>T</title><pages><page id=\"p1\"><title>A</title><importance>high</importance></page><page id=\"p2\"></wiki_structure>",
    "fenced": f"Sure!\n```xml\n<wiki_structure><title>T</title>{PAGE}</wiki_structure>\n``` done",
    "none": "no structure",
}


def parsed(spark):
    df = spark.createDataFrame(list(RESPONSES.items()), "wiki_id string, response string")
    return wiki.parse_structures(df)


def test_pages(spark):
    s = parsed(spark)
    rows = {(r.wiki_id, r.pos): r for r in wiki.structure_pages(s).collect()}
    a, b = rows[("good", 0)], rows[("good", 1)]
    assert (a.id, a.importance, a.file_paths, a.related_pages) == ("p1", "medium", ["a.py"], ["p2", "gone"])
    assert (b.id, b.title, b.importance, b.file_paths) == ("page-2", "B & C", "low", [])
    assert rows[("amp", 0)].title == "x & y"
    assert (rows[("broken", 0)].title, rows[("broken", 0)].importance) == ("A", "high")
    assert ("fenced", 1) in rows and not [k for k in rows if k[0] == "none"]
    assert {r.wiki_id: r.title for r in wiki.wiki_heads(s).collect()} == {"good": "T", "amp": "R & D", "broken": "T", "fenced": "T"}


def test_sections_and_roots(spark):
    sections = wiki.structure_sections(parsed(spark)).filter("wiki_id = 'good'")
    refs = wiki.section_refs(sections)
    assert sorted(r.id for r in wiki.root_sections(sections, refs).collect()) == ["s1", "s3"]
    tree = wiki.section_tree(sections, refs).orderBy("order_path").collect()
    assert [(r.id, r.level) for r in tree] == [("s1", 0), ("s2", 1), ("s3", 0)]


def test_section_cycles_end(spark):
    sections = spark.createDataFrame([("w", i, x, x) for i, x in enumerate("rab")], "wiki_id string, pos long, id string, title string")
    refs = spark.createDataFrame(
        [("w", "r", 0, "a"), ("w", "a", 0, "b"), ("w", "b", 0, "a")], "wiki_id string, parent_id string, n int, id string"
    )
    assert sorted((r.id, r.level) for r in wiki.section_tree(sections, refs).collect()) == [("a", 1), ("b", 2), ("r", 0)]


PAGES = [
    ("w", 0, "p1", "Intro", "text1", "high", ["a.py"], ["p2", "zz"]),
    ("w", 1, "p2", "Next", "text2", "low", [], ["zz"]),
    ("w", 2, "p3", "Last", "text3", None, [], []),
]
PAGE_SCHEMA = (
    "wiki_id string, pos long, id string, title string, content string, importance string, file_paths array<string>, "
    "related_pages array<string>"
)


def test_markdown_document(spark):
    df = spark.createDataFrame(PAGES, PAGE_SCHEMA)
    want = (
        "# Wiki Documentation for U\n\nGenerated on: NOW\n\n## Table of Contents\n\n- [Intro](#p1)\n- [Next](#p2)\n- [Last](#p3)\n\n"
        "<a id='p1'></a>\n\n## Intro\n\n### Related Pages\n\nRelated topics: [Next](#p2)\n\ntext1\n\n---\n\n"
        "<a id='p2'></a>\n\n## Next\n\n### Related Pages\n\ntext2\n\n---\n\n<a id='p3'></a>\n\n## Last\n\ntext3\n\n---\n\n"
    )
    for size in (1, 2, 1000):
        rows = wiki.markdown_parts(df, F.lit("U"), F.lit("NOW"), size).orderBy("section_no", "part_no").collect()
        assert "".join(r.text for r in rows) == want


def test_export_files(spark, tmp_path):
    import glob
    import json

    from repoloom.sources import store

    df = spark.createDataFrame(PAGES, PAGE_SCHEMA)
    parts = wiki.markdown_parts(df, F.lit("U"), F.lit("NOW"), 1)
    store.write_markdown(parts, str(tmp_path / "md"))
    files = sorted(glob.glob(str(tmp_path / "md" / "wiki_id=w" / "*.txt")))
    text = "".join(open(f, newline="").read() for f in files)
    assert text == "".join(r.text for r in parts.orderBy("section_no", "part_no").collect())
    store.write_json_export(wiki.json_parts(df, F.lit("U"), F.lit("NOW"), 2), str(tmp_path / "js"))
    lines = [x for f in sorted(glob.glob(str(tmp_path / "js" / "wiki_id=w" / "*.txt"))) for x in open(f)]
    assert len(lines) == 2 and len(json.loads("".join(lines))["pages"]) == 3


def test_large_wiki_is_one_json_document(spark):
    import json

    pages = spark.range(2500).select(
        F.lit("w").alias("wiki_id"), F.col("id").alias("pos"), F.concat(F.lit("p"), "id").alias("id"), F.lit('T "x"').alias("title"),
        F.lit("a\nb").alias("content"), F.array(F.lit("f")).alias("file_paths"), F.lit("high").alias("importance"), F.array().cast("array<string>").alias("related_pages"),
    )
    parts = wiki.json_parts(pages, F.lit("U"), F.lit("NOW")).orderBy("part_no").collect()
    doc = json.loads("".join(r.json for r in parts))
    assert len(parts) == 3 and doc["metadata"]["page_count"] == 2500
    assert [p["id"] for p in doc["pages"]] == [f"p{i}" for i in range(2500)]


def test_deep_section_tree(spark):
    n = 150
    sections = spark.range(n).select(F.lit("w").alias("wiki_id"), F.concat(F.lit("s"), "id").alias("id"), F.col("id").cast("int").alias("pos"), F.lit("t").alias("title"))
    refs = spark.range(n - 1).select(
        F.lit("w").alias("wiki_id"), F.concat(F.lit("s"), "id").alias("parent_id"), F.concat(F.lit("s"), F.col("id") + 1).alias("id"), F.lit(0).alias("n")
    )
    assert wiki.section_tree(sections, refs).agg(F.max("level")).first()[0] == n - 1


def test_json_document(spark):
    import json

    df = spark.createDataFrame(PAGES, PAGE_SCHEMA)
    doc = json.loads(wiki.json_parts(df, F.lit("U"), F.lit("NOW")).first().json)
    assert doc["metadata"] == {"repository": "U", "generated_at": "NOW", "page_count": 3}
    assert [p["id"] for p in doc["pages"]] == ["p1", "p2", "p3"] and doc["pages"][0]["relatedPages"] == ["p2", "zz"]


def brute_budget(pages, budget):
    import re

    text, used = "", 0
    high = [p for p in pages if p[5] == "high"]
    for p in high:
        if p[4]:
            c = f"## {p[3]}\n{p[4]}\n\n"
            text, used = text + c, used + len(c)
            if used > budget:
                break
    if used < budget:
        for p in pages:
            if p[5] == "high" or not p[4]:
                continue
            c = f"## {p[3]}\n{p[4]}\n\n"
            if used + len(c) > budget:
                m = re.search(r"# .*?\n\n(.*?)(\n\n|\Z)", p[4])
                c = f"## {p[3]}\n{m.group(1).strip() if m else 'No summary available'}\n\n"
            text, used = text + c, used + len(c)
            if used > budget:
                break
    return text, used


def test_budget_context_against_brute_force(spark):
    import random

    rnd = random.Random(7)
    wikis = {}
    for w in range(30):
        wikis[f"w{w}"] = [
            (f"w{w}", i, f"p{i}", "t" * rnd.randrange(4), rnd.choice(["", "x" * rnd.randrange(1, 90), "# h\n\nshort\n\n" + "y" * rnd.randrange(60)]),
             rnd.choice(["high", "low", None]), [], [])
            for i in range(rnd.randrange(1, 40))
        ]
    df = spark.createDataFrame([p for ps in wikis.values() for p in ps], PAGE_SCHEMA).repartition(4)
    for budget in (0, 40, 100, 400):
        got = {r.wiki_id: (r.context, r.used) for r in wiki.budget_context(df, budget).collect()}
        for w, ps in wikis.items():
            if any(p[4] for p in ps):
                assert got[w] == brute_budget(ps, budget), (w, budget)


def test_budget_plan_moves_chosen_contents_only(spark, monkeypatch):
    pages = [("hot", i, f"p{i}", "t", "word " * 50, "high" if i % 3 else "low", [], []) for i in range(3000)] + [(None, 0, "p", "t", "alone", "low", [], [])]
    df = spark.createDataFrame(pages, PAGE_SCHEMA).repartition(4)
    got = {r.wiki_id: r for r in wiki.budget_context(df, 1000).collect()}
    assert got[None].context == "## t\nalone\n\n" and len(got["hot"].context) == got["hot"].used <= 1300
    plan = wiki.budget_context(df, 1000)._jdf.queryExecution().executedPlan().toString()
    # Chosen pages travel to the pages; the other join is that of wikis with their finished contexts.
    assert "BroadcastHashJoin" in plan and "Window" not in plan and plan.count("SortMergeJoin") <= 1
    monkeypatch.setattr(wiki, "MAX_CHOSEN", 0)
    assert {r.wiki_id: r for r in wiki.budget_context(df, 1000).collect()} == got


def test_savable_needs_every_content(spark):
    pages = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("c", "1")], "wiki_id string, id string")
    made = spark.createDataFrame(
        [("a", "1", "x"), ("a", "2", "y"), ("b", "1", "Loading..."), ("d", "1", "x")], "wiki_id string, id string, content string"
    )
    assert [tuple(r) for r in wiki.savable_wikis(pages, made).collect()] == [("a", 2, 2)]


def test_root_sections_parse_each_response_once(spark, tmp_path):
    from repoloom.plans import all_queries

    rows = [(i, f"a b{i}\nc d\ne & f") for i in (0, 1, 2, 2)] + [(None, "x\ny")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    roots = all_queries()["h27_structure_roots"](spark, str(tmp_path))
    plan = roots._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "xml" not in plan and plan.count("logicalrdd") == 2
    # Copies of a document stay copies.
    assert sorted(map(tuple, roots.filter("wiki_id IS NOT NULL").collect())) == sorted((i, s) for i in (0, 1, 2, 2) for s in ("s1", "s3"))
