"""Registered queries against their SQL; all of them with REPOLOOM_ALL=1, one per area otherwise."""

import os
import re

import pytest

import __spark_entry__ as entry
from oracle_check import connect, difference

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "a1_read_documents", "a2_repository_tree", "b1_exclusion_filter", "c9_j1_resolved_calls", "d1_majority_size", "d3_type_rollup",
    "e3_dialog_turns", "e6_word_chunks", "e9_budget_context", "h14_contents_list", "h17_slide_items", "h24_h26_structure_pages",
    "h32_prompts", "j5_simple_paths", "j7_section_tree", "k2_stream_assembly", "p2_p3_imports", "p10_go_facts",
    "a6_wiki_files", "a10_json_texts", "b14_size_route", "d4_file_statistics", "d12_importance_sections", "e5_store_top_k_grid",
    "e8_annotated_workshops", "e10_first_classes", "h11_fences", "h29_json_export", "h33_key_info", "k1_stream_refresh", "p16_signatures", "u2_normalise",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


# The training-data queries have tests of their own, which go with their subpackage.
OWN = {n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n)}


@pytest.mark.parametrize("name", sorted(OWN & set(entry.oracle_sql())) if os.environ.get("REPOLOOM_ALL") else SAMPLE)
def test_equals_sql(spark, con, name):
    assert difference(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) is None


def test_registry():
    names, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(names)
    assert OWN - set(oracles) == {"u3_character_chunks", "u4_vocabulary_counts", "u5_java_call_facts"}


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "vec_id", "score", "rank"] and df.count() > 0
