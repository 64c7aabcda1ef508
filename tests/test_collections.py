"""Laws of collections keyed by grain, on random small collections."""

import random

import pytest
from pyspark.sql import functions as F

from rowgrain.operators import collections as co

SCHEMA = "k int, v string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def as_dict(df):
    got = df.collect()
    d = {r.k: r.v for r in got}
    assert len(d) == len(got), "a key occurs twice"
    return d


def make(spark, rng, agree=False):
    keys = rng.sample([*range(11), None], rng.randint(0, 8))
    data = [(k, f"{'x' if agree else rng.choice('pqr')}{k}") for k in keys]
    return dict(data), spark.createDataFrame(data, SCHEMA)


@pytest.mark.parametrize("seed", range(4))
def test_keyed_operations_against_dicts(spark, seed):
    rng = random.Random(seed)
    (a, adf), (b, bdf) = make(spark, rng), make(spark, rng)
    k = ["k"]
    assert as_dict(co.union(adf, bdf, k)) == {**a, **b}  # the right row stays
    assert as_dict(co.intersection(adf, bdf, k)) == {x: a[x] for x in a if x in b}
    assert as_dict(co.difference(adf, bdf, k)) == {x: a[x] for x in a if x not in b}
    assert as_dict(co.insert(adf, bdf, k, ["v"])) == {**b, **a}  # a present row stays
    assert as_dict(co.upsert(adf, bdf, k, ["v"])) == {**a, **b}
    assert as_dict(co.delete(adf, bdf, k)) == {x: a[x] for x in a if x not in b}
    assert {r.k for r in co.conflicts(adf, bdf, k).collect()} == {x for x in a if x in b and a[x] != b[x]}
    assert {r.k: r.is_member for r in co.contains(adf, bdf, k).collect()} == {x: a.get(x) == b[x] for x in b}
    got = co.compare_rows(adf, bdf).first()
    sa, sb = set(a.items()), set(b.items())
    assert (got.equal, got.subset, got.proper_subset) == (sa == sb, sa <= sb, sa < sb)
    keys = co.compare_keys(adf, bdf, k, k).first()
    assert (keys.equal, keys.subset, keys.only_left, keys.only_right) == (set(a) == set(b), set(a) <= set(b), len(set(a) - set(b)), len(set(b) - set(a)))
    assert co.same_count(adf, bdf).first().same_count == (len(a) == len(b))


@pytest.mark.parametrize("seed", range(2))
def test_laws(spark, seed):
    rng = random.Random(100 + seed)
    (_, a), (_, b) = make(spark, rng), make(spark, rng)
    k = ["k"]
    assert rows(co.union(a, a, k)) == rows(a) == rows(co.intersection(a, a, k))  # idempotent
    assert rows(co.difference(a, a, k)) == []
    assert rows(co.insert(co.insert(a, b, k, ["v"]), b, k, ["v"])) == rows(co.insert(a, b, k, ["v"]))
    assert rows(co.delete(co.delete(a, b, k), b, k)) == rows(co.delete(a, b, k))
    assert rows(co.union(co.intersection(a, b, k), co.difference(a, b, k), k)) == rows(a)  # the two parts give it back
    (_, c), (_, d) = make(spark, rng, agree=True), make(spark, rng, agree=True)
    assert rows(co.union(c, d, k)) == rows(co.union(d, c, k))  # commutes when rows agree
    assert rows(co.intersection(c, d, k)) == rows(co.intersection(d, c, k))


def test_equality_implies_the_weaker_relations(spark):
    rng = random.Random(7)
    for _ in range(3):
        (_, a), (_, b) = make(spark, rng, agree=True), make(spark, rng, agree=True)
        r, g = co.compare_rows(a, b).first(), co.compare_keys(a, b, ["k"], ["k"]).first()
        assert not r.equal or g.equal
        assert not r.subset or g.subset


def test_small_collections(spark):
    schema = spark.createDataFrame([], SCHEMA).schema
    none, one = co.empty(spark, schema), co.singleton(spark, {"k": 1, "v": "a"}, schema)
    assert co.is_empty(none) and not co.is_empty(one)
    assert rows(co.lookup(one, ["k"], {"k": 1})) == [(1, "a")] and rows(co.lookup(one, ["k"], {"k": 2})) == []
    assert rows(co.union(none, one, ["k"])) == rows(one)
    three = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], SCHEMA)
    assert rows(co.some_element(three, ["k"])) == [(1, "a")]
    assert rows(co.lookup_many(three, ["k"], one)) == [(1, "a")]
    assert rows(co.filter_rows(three, F.col("k") > 1)) == [(2, "b"), (3, "c")]


def test_dedup_and_multiplicity(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (2, "c")], SCHEMA)
    assert rows(co.dedup(df, ["k"], ["v"])) == [(1, "a"), (2, "c")]
    once = df.distinct()
    got = co.compare_rows(once, df).first()
    assert (got.equal, got.proper_subset, got.only_right) == (False, True, 1)


def test_partition(spark):
    whole = spark.range(10).withColumnRenamed("id", "k")
    low, high = whole.filter("k < 5"), whole.filter("k >= 5")
    check = lambda *parts: co.partition_check(whole, list(parts), ["k"]).first()
    assert check(low, high).is_partition
    assert check(low).n_missing == 5
    overlap = check(low, whole.filter("k >= 4"))  # the counts add up to one more
    assert overlap.n_overlapping == 1 and not overlap.is_partition
    swapped = check(low, whole.filter("k in (4, 6, 7, 8, 9)"))  # the counts add up, still wrong
    assert (swapped.n_missing, swapped.n_overlapping) == (1, 1)
    assert check(low, high, spark.createDataFrame([(99,)], "k bigint")).n_foreign == 1


def test_null_is_a_key_like_any_other(spark):
    a = spark.createDataFrame([(None, "p"), (1, "q")], SCHEMA)
    b = spark.createDataFrame([(None, "r"), (2, "s")], SCHEMA)
    k = ["k"]
    assert as_dict(co.union(a, b, k)) == {None: "r", 1: "q", 2: "s"}
    assert as_dict(co.insert(a, b, k, ["v"])) == {None: "p", 1: "q", 2: "s"}
    assert as_dict(co.upsert(a, b, k, ["v"])) == {None: "r", 1: "q", 2: "s"}
    assert as_dict(co.difference(a, b, k)) == {1: "q"} and as_dict(co.intersection(a, b, k)) == {None: "p"}
    assert rows(co.conflicts(a, b, k).select("k", "left_row.v", "right_row.v").toDF("k", "l", "r")) == [(None, "p", "r")]
    assert {r.k: r.is_member for r in co.contains(a, a, k).collect()} == {None: True, 1: True}
    assert {r.k: r.is_member for r in co.contains(a, b, k).collect()} == {None: False, 2: False}
    assert rows(co.lookup(a, k, {"k": None})) == [(None, "p")] == rows(co.lookup_many(a, k, b))
    assert co.lookup(a.unionByName(a), k, {"k": 1}).count() == 2, "not a key after all"
