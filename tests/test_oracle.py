"""Every registered query against its SQL on the same tables."""

import os

import pytest

import __spark_entry__ as contract
import compare
from aislelens.functions import order_statistics, timeline
from aislelens.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
QUERIES = {name: query for name, query in contract.queries().items() if name in catalog.JOBS}
SQL = {name: sql for name, sql in contract.oracle_sql().items() if name in catalog.JOBS}


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(SF):
        pytest.skip("dataset absent")
    return compare.database(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, db, name):
    assert compare.differences(QUERIES[name](spark, SF), db, SQL[name]) == []


SLICED = """next_product_symmetry next_category_propensity next_category_demand next_product_value
triple_repeat_product same_product_gap product_reorder_gap late_penalty churn_after_delivery
revenue_leakage delay_vs_next_value recovered_delivery_pct churn_after_bad_review
dup_feedback_customer area_product_rank""".split()


@pytest.mark.parametrize("name", SLICED)
def test_same_as_sql_when_every_repeated_key_is_hot(spark, db, name, monkeypatch):
    monkeypatch.setattr(timeline, "MIN_ROWS", 1)
    assert compare.differences(QUERIES[name](spark, SF), db, SQL[name]) == []


@pytest.mark.parametrize("name", ["rfm_ntile_segments", "iqr_inliers", "describe_numeric", "describe_delivery", "iqr_inliers_orders"])
def test_same_as_sql_when_ranks_are_found_in_steps(spark, db, name, monkeypatch):
    monkeypatch.setattr(order_statistics, "SMALL_BYTES", 0)
    assert compare.differences(QUERIES[name](spark, SF), db, SQL[name]) == []


def test_entry_runs(spark):
    result = contract.entry(spark)
    assert result.columns == ["month_number", "avg_retention_rate"]
    assert result.count() > 0
