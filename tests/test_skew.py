"""Joins where one key holds a third of the rows: Spark has to be able to split it."""

import pytest
from pyspark.sql import functions as F

from rowgrain import source
from rowgrain.operators import aggregates as ag
from rowgrain.operators import joins as jn

# Thresholds low enough for small tables to count as skewed.
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture(scope="module")
def tables(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    # Several input splits, so that a hot shuffle partition has pieces to be split into.
    facts = spark.range(0, 60_000, 1, 12).select(
        "id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 2000).alias("k"), (F.col("id") % 11).cast("double").alias("m")
    )
    dims = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("d"))
    yield source(facts, "id", measures=["m"]), source(dims, "k")
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def is_split(df, n):
    rows, plan = final_plan(df)
    assert len(rows) == n
    return "isSkewJoin=true" in plan or "skew=true" in plan or "(skew" in plan


def test_many_to_one(tables):
    facts, dims = tables
    assert is_split(facts.join(dims, "k").df, 60_000)


def test_against_a_side_grouped_by_the_key(tables):
    facts, _ = tables
    per_key = facts.aggregate("k", total=ag.total("m"))
    assert is_split(facts.join(per_key, "k").df, 60_000)
    assert is_split(facts.join(per_key, "k", "left").df, 60_000)
    plain = jn.equi_join(facts.df, per_key.df, "k")
    assert not is_split(plain, 60_000)  # what the companion key is for


def test_existence(tables):
    facts, dims = tables
    n = facts.df.filter("k < 1000").count()
    some = dims.where("d < 2000")
    assert is_split(facts.semi_join(some, "k").df, n)
    assert is_split(facts.semi_join(facts.where("k < 1000"), "k").df, n)  # frequent on both sides
    assert is_split(jn.anti_join(facts.df, dims.df.filter("d >= 2000"), "k"), n)


def test_left_join_with_the_frequent_key_on_the_right(tables):
    facts, dims = tables
    joined = dims.join(facts, "k", "left")
    unmatched = dims.df.join(facts.df, "k", "left_anti").count()
    assert is_split(joined.df, 60_000 + unmatched)


def test_one_to_one_joins_keep_the_partitioning(tables):
    facts, dims = tables
    per_key = facts.aggregate("k", total=ag.total("m"))
    other = facts.aggregate("k", n=ag.rows())
    text = per_key.join(other, "k").df._jdf.queryExecution().sparkPlan().toString()
    assert jn.COMPANION not in text
