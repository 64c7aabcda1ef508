"""Figures known for the given tables at scale 0.01."""

import pytest
from pyspark.sql import functions as F

from rowgrain.functions.columns import money
from rowgrain.operators import traps
from rowgrain.operators import verify as vf

MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def t(spark):
    return lambda name: spark.read.parquet(f"{MIDDLE}/{name}.parquet")


@pytest.mark.parametrize("cols,distinct", [
    ("l_orderkey l_linenumber", 45832), ("l_orderkey l_linenumber l_partkey", 59993), ("l_orderkey l_partkey", 59945),
    ("l_orderkey l_linenumber l_partkey l_suppkey", 60000), ("l_orderkey l_partkey l_suppkey", 60000),
])
def test_item_keys(t, cols, distinct):
    got = vf.uniqueness(t("lineitem"), cols.split()).first()
    assert (got.n_rows, got.n_keys, got.has_duplicates) == (60000, distinct, distinct < 60000)


def test_line_number_can_go(t):
    assert vf.removable_columns(t("lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]) == ["l_linenumber"]


def test_fan_and_chasm(t):
    orders, items = t("orders"), t("lineitem")
    got = traps.inflation(orders, items, [("o_orderkey", "l_orderkey")], money("o_totalprice")).first()
    assert (float(got.total_before), float(got.total_after)) == (3758439620.06, 14971172164.46)
    loss = traps.chain_loss([
        ("orders", orders, items, [("o_orderkey", "l_orderkey")]), ("documents", t("documents"), t("labels"), "doc_id"),
    ])
    assert {r.link: (r.n_rows, r.n_unmatched) for r in loss.collect()} == {"orders": (15000, 257), "documents": (1000, 601)}


def test_events_have_three_keys(t):
    events = t("events")
    assert all(vf.is_key(events, k) for k in (["event_id"], ["ts"])) and vf.is_superkey(events, ["user_id", "ts"])
    assert not vf.is_superkey(t("orders"), ["o_custkey", "o_orderdate"])
    assert t("orders").agg(F.count_distinct(F.struct("o_custkey", "o_orderdate"))).first()[0] == 14968
