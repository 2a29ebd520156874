"""The physical plans have the shape that scales."""

import pytest

from vecloom.plans.catalog import all_queries

SF = "/root/testdata/sf0.001"


def plan_of(spark, name):
    return all_queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["top_words", "top_providers", "key_themes", "cluster_samples", "cluster_random_sample", "term_weights"]
)
def test_top_n_is_limited_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan_of(spark, name)


@pytest.mark.parametrize("name", sorted(all_queries().keys() - {"layout_3d", "stream_assign"}))
def test_no_cross_product_and_no_python_in_relational_plans(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan  # no row-at-a-time Python


def test_scans_read_only_needed_columns(spark):
    plan = plan_of(spark, "cluster_distribution")
    assert "ReadSchema: struct<label:int>" in plan
    assert "embedding" not in plan_of(spark, "cluster_summary").split("ReadSchema")[1].split("\n")[0]


def test_search_filter_reaches_the_scan(spark):
    assert "EqualTo(source,src3)" in plan_of(spark, "item_search")
