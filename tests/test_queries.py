"""Every query with an oracle gives the oracle's rows; every other query runs."""

import os

import pytest

from lattica.plans import catalogue
from tests.oracles import connect, difference

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, con, name):
    assert difference(catalogue.QUERIES[name](spark, SF_DIR), con, catalogue.ORACLES[name]) == ""


@pytest.mark.parametrize("name", ["top_n_offset", "order_nulls", "distinct_order", "set_then_top_n", "found_rows_of_a_page"])
def test_order(spark, con, name):
    assert difference(catalogue.QUERIES[name](spark, SF_DIR), con, catalogue.ORACLES[name], ordered=True) == ""


def test_order_of_siblings(spark, con):
    """Depth first, siblings by name: the order of the paths, as the names hold no separator."""
    got = [r.path.split("/") for r in catalogue.QUERIES["connect_by_levels"](spark, SF_DIR).collect()]
    assert got == sorted(got) and len(got) == len(con.execute(catalogue.ORACLES["connect_by_levels"]).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF_DIR).count() >= 0
