"""Registered queries against their SQL. A spread of them at sf0.001 by default;
all of them, at sf0.01, with AISLEBROOK_ALL_QUERIES=1."""

import os

import pytest

import __spark_entry__ as entry
from catalog.registry import QUERIES, SQL
from check_oracle import compare, connect

ALL = os.environ.get("AISLEBROOK_ALL_QUERIES") == "1"
SF = "/root/testdata/sf0.01" if ALL else "/root/testdata/sf0.001"
SPREAD = [
    "d05_velocity_wma_final", "r01_store_priority", "r19_allocate_base", "r22_final_filter", "r31_replen_by_store",
    "e01_style_metrics", "e11_pctrank_efficiency", "b03_association_rules", "b05_common_pairs", "m03_reason_flags",
    "m09_style_daily", "m10_weekly_forecast", "v06_store_performance", "q06_store_mapping", "c06_clean_sales",
    "w09_largest_remainder", "x06_array_set_operations",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES) if ALL else SPREAD)
def test_query_matches_sql(spark, con, name):
    ok, text = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert ok, text


def test_entry_returns_a_plan(spark):
    assert entry.entry(spark).where("FINAL_REPLEN_QTY > 0").count() > 0


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


def test_names_do_not_repeat_columns(spark):
    df = entry.queries()["r19_allocate_base"](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
