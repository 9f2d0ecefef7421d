"""Plan checks: what reaches the scan, what is shuffled, what is broadcast."""

import pytest
from repoloom.operators import call_graph, chunking, dialog
from repoloom.plans import all_queries, views

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_shuffles_hits_only(spark):
    p = plan(all_queries()["c7_e5_top_k_search"](spark, SF))
    assert "MapInArrow" in p and p.count("Exchange hashpartitioning") == 1 and "WindowGroupLimit" in p
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_chunking_adds_no_shuffle(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert "Exchange" not in plan(chunking.word_chunks(docs))


def test_scan_reads_needed_columns_only(spark):
    p = plan(all_queries()["b2_url_inclusion"](spark, SF))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in p
    p = plan(spark.read.parquet(f"{SF}/conversations.parquet").filter("role = 'user'").transform(dialog.last_messages))
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,user)]" in p


def test_history_needs_no_global_order(spark):
    p = plan(dialog.history_parts(spark.read.parquet(f"{SF}/conversations.parquet")))
    assert "SinglePartition" not in p and "Window" not in p


# Global order questions answered for a whole table in one task would not survive growth.
@pytest.mark.parametrize(
    "name", [n for n in ("a1_read_documents", "c2_related_titles", "d12_title_sections", "h28_a13_markdown_export", "p2_p3_imports")]
)
def test_no_cross_join_and_no_single_task(spark, name):
    p = plan(all_queries()[name](spark, SF))
    assert "NestedLoop" not in p and "Cartesian" not in p and "SinglePartition" not in p


def test_hot_groups_leave_the_plain_window(spark):
    facts = views.call_facts(spark, SF)
    assert "RangePartitioning" not in plan(call_graph.resolved_calls(facts))
    cold = call_graph.resolved_calls(facts)
    hot = call_graph.resolved_calls(facts, hot_rows=5)
    assert sorted(map(tuple, cold.collect())) == sorted(map(tuple, hot.collect()))


def test_grid_equals_scan(spark):
    q = all_queries()
    a = q["c7_e5_top_k_search"](spark, SF).filter("rank <= 20").collect()
    b = q["e5_store_top_k_grid"](spark, SF).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
