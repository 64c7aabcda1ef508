"""Every registered query against its SQL, and the shape of some plans."""

import sys

import pytest

import oracle
from conftest import ROOT, SMALL

sys.path.insert(0, ROOT)
import __spark_entry__ as entry_module  # noqa: E402

from rowgrain.queries import ORACLES, QUERIES  # noqa: E402


def test_all_are_registered():
    assert QUERIES.keys() <= entry_module.queries().keys() and ORACLES.keys() <= entry_module.oracle_sql().keys()


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    if name in ORACLES:
        assert oracle.differences(df, duck, ORACLES[name]) is None
    else:
        df.count()


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["o_custkey", "n_orders", "total_price", "total_qty"] and df.count() > 0


def plan(spark, name):
    return QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "p1_filter")
    assert "PushedFilters: [IsNotNull(o_orderstatus), IsNotNull(o_totalprice), EqualTo(o_orderstatus,F)" in text
    assert "o_orderpriority" not in text
    report = plan(spark, "sales_report_safe")
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in report


def test_no_python_and_no_products_in_any_plan(spark):
    for name in QUERIES:
        text = plan(spark, name)
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups"):
            assert bad not in text, (name, bad)
