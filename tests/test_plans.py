"""Plans that matter at scale: what reaches the scan, and what doesn't happen."""

import pytest

from lattica.plans import catalogue

SF_DIR = "/root/testdata/sf0.001"


def plan(spark, name):
    return catalogue.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("name", "pushed"), [("having_group", "LessThanOrEqual(l_shipdate"), ("flashback_as_of", "LessThanOrEqual(o_orderdate"), ("exists_semi_join", "GreaterThan(o_totalprice,250000.0)"), ("connect_by_filtered", "")])
def test_filters_reach_the_scan(spark, name, pushed):
    assert pushed in plan(spark, name)


def test_columns_are_pruned(spark):
    text = plan(spark, "exists_semi_join")
    assert "ReadSchema: struct<c_custkey:bigint>" in text and "o_orderstatus" not in text


def test_top_n_does_not_sort_everything(spark):
    text = plan(spark, "top_n_offset")
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - {"cross_theta_join"}))
def test_no_cartesian_products(spark, name):
    assert "CartesianProduct" not in plan(spark, name)


def test_semi_joins_stay_semi_joins(spark):
    assert "LeftSemi" in plan(spark, "exists_semi_join") and "LeftAnti" in plan(spark, "not_exists_anti_join")
