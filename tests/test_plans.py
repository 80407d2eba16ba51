"""What the physical plans have to look like."""

import pytest

from folio.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["c1_hybrid_retrieve", "k2_lexical_top_k", "j10_rank_fusion", "j1_enrichment", "j17_need_coverage", "s7_upsert", "w8_page_siblings", "c2_similar_missions", "x31_repeated_8grams", "u2_append_missing"])
def test_no_product_of_tables(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["p25_since_filter"](spark, FOLDER))
    assert "GreaterThanOrEqual(ts" in text and "props" not in text.split("ReadSchema")[1]
    text = plan(QUERIES["a5_projects_by_type"](spark, FOLDER))
    assert "ReadSchema: struct<p_type:string>" in text
    assert text.count("HashAggregate") == 2  # combined before the shuffle


@pytest.mark.parametrize("name", ["x1_fold", "x7_terms", "x16_cleaned", "x21_intent", "x52_plain_text", "x26_numeric_facts", "x8_lexemes"])
def test_scalars_stay_in_the_jvm(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "Python" not in text and "Arrow" not in text and "Exchange" not in text


def test_page_window_is_cut_before_the_shuffle(spark):
    text = plan(QUERIES["w1_page_window"](spark, FOLDER))
    assert "WindowGroupLimit" in text
