"""Order inside a key, with and without a key that holds a third of all rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rowgrain.operators import aggregates as ag
from rowgrain.operators import ordered as od
from rowgrain.operators import slices


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(11)
    data, seen = [], set()
    while len(data) < 600:
        k = 0 if rng.random() < 0.35 else rng.randrange(1, 40)
        t = int(rng.expovariate(0.001)) if k == 0 else rng.randrange(5000)  # uneven in time for the hot key
        if (k, t) not in seen:
            seen.add((k, t))
            data.append((k, t, rng.choice(["a", "b", None])))
    return data, spark.createDataFrame(data, "k int, t int, v string").repartition(7)


@pytest.mark.parametrize("hot_rows", [5, 40, 10_000])
@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("backwards", [False, True])
def test_carry_equals_one_window(table, hot_rows, inclusive, backwards):
    _, df = table
    order = F.col("t").desc() if backwards else F.col("t")
    w = Window.partitionBy("k").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = df.withColumn("x", F.last("v", ignorenulls=True).over(w))
    got = od.carry(df, ["k"], ["t"], F.col("v"), "x", inclusive=inclusive, backwards=backwards, hot_rows=hot_rows)
    assert rows(got) == rows(want)


def test_a_burst_is_cut_again(spark):
    """Most rows of the hot key fall into one per cent of its time."""
    df = spark.range(4000).select(
        F.lit(1).alias("k"), F.when(F.col("id") < 100, F.col("id") * 1000.0).otherwise(5000 + F.col("id") / 4).alias("t")
    )
    hot = od.slices_of_hot_keys(df, ["k"], "t", 50)
    once = od.in_slices(df, hot, ["k"], "t", "part", "inner")
    biggest = lambda d, *c: d.groupBy(*c).count().agg(F.max("count")).first()[0]
    assert biggest(once, "part") > 3000
    hotter = od.slices_of_hot_keys(once, ["k", "part"], "t", 50)
    twice = od.in_slices(once, hotter, ["k", "part"], "t", "finer", "left")
    assert biggest(twice, "part", "finer") < 120
    got = od.carry(df.withColumn("v", F.col("t")), ["k"], ["t"], F.col("v"), "x", hot_rows=50)
    want = df.withColumn("v", F.col("t")).withColumn("x", F.lag("v").over(Window.partitionBy("k").orderBy("t")))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "int", "decimal(10,2)"])
def test_every_kind_of_order_column_can_be_sliced(spark, kind):
    source = "id" if kind in ("int", "decimal(10,2)") else "timestamp_ntz'2024-03-30 22:00:00' + make_dt_interval(0, 0, 7 * cast(id as int))"
    if kind == "date":
        source = "date_add(date'2024-01-01', cast(id as int))"
    df = spark.range(60).selectExpr("1 AS k", f"cast({source} AS {kind}) AS t", "id AS v")
    got = od.carry(df, ["k"], ["t"], F.col("v"), "x", hot_rows=7)
    assert {r.v: r.x for r in got.collect()} == {i: i - 1 if i else None for i in range(60)}


def test_slices_do_not_depend_on_the_time_zone(spark):
    """Local times that a clock change skips still come in order."""
    df = spark.range(48).selectExpr("1 AS k", "timestamp_ntz'2024-03-31 00:00:00' + make_dt_interval(0, 0, 10 * cast(id as int)) AS t", "id AS v")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        got = od.carry(df, ["k"], ["t"], F.col("v"), "x", hot_rows=3).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert {r.v: r.x for r in got} == {i: i - 1 if i else None for i in range(48)}


def test_carry_over_text_order(spark):
    df = spark.createDataFrame([("k", "a", 1), ("k", "b", None), ("k", "c", 3)], "k string, t string, v int")
    assert rows(od.carry(df, ["k"], ["t"], F.col("v"), "x")) == [("k", "a", 1, None), ("k", "b", None, 1), ("k", "c", 3, 1)]


@pytest.mark.parametrize("hot_rows", [4, 10_000])
def test_as_of_against_brute_force(spark, table, hot_rows):
    data, df = table
    rng = random.Random(12)
    asks = [(i, rng.choice([0, 0, rng.randrange(45)]), rng.randrange(-10, 9000)) for i in range(200)]
    lookups = spark.createDataFrame(asks, "id int, k int, at int")
    versions = df.withColumnsRenamed({"t": "since"})
    want = []
    for i, k, at in asks:
        past = [(t, v) for kk, t, v in data if kk == k and t <= at]
        since, v = max(past, key=lambda x: x[0]) if past else (None, None)
        want.append((i, k, at, since, v))
    got = od.as_of(lookups, versions, ["k"], "at", "since", ["v"], hot_rows=hot_rows)
    assert rows(got) == sorted(want, key=repr)


@pytest.mark.parametrize("hot_rows", [1, 10_000])
def test_as_of_picks_one_of_several_versions_with_one_start(spark, hot_rows):
    versions = spark.createDataFrame([(1, 5, "x", 2), (1, 5, "y", 1), (1, 7, "z", 0)], "k int, since int, v string, no int")
    lookups = spark.createDataFrame([(1, 5), (1, 6), (1, 9), (1, 4)], "k int, at int")
    ask = lambda **kw: {r.at: r.v for r in od.as_of(lookups, versions, ["k"], "at", "since", ["v"], hot_rows=hot_rows, **kw).collect()}
    assert ask() == {4: None, 5: "y", 6: "y", 9: "z"}
    assert ask(tie=["no"]) == {4: None, 5: "x", 6: "x", 9: "z"}


def test_latest_and_first(table):
    data, df = table
    best = {}
    for k, t, v in data:
        if k not in best or t > best[k][1]:
            best[k] = (k, t, v)
    assert rows(od.latest_per_key(df, ["k"], ["t"])) == sorted(best.values(), key=repr)
    assert rows(od.first_per_key(df, ["k"], [F.col("t").desc()])) == sorted(best.values(), key=repr)
    plan = od.first_per_key(df, ["k"], ["t"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # rows are limited on each task before the shuffle


def test_collect_groups_in_pieces(table):
    data, df = table
    pieces = ag.collect_groups(df, ["k"], ["t"], piece_rows=20)
    got = pieces.collect()
    assert sum(len(r.members) for r in got) == len(data)
    assert sorted((r.k, m.t, m.v) for r in got for m in r.members if m.v) == sorted(d for d in data if d[2])
    assert all([m.t for m in r.members] == sorted(m.t for m in r.members) for r in got)
    assert len([r for r in got if r.k == 0]) > 1 and max(len(r.members) for r in got) < 60


@pytest.mark.parametrize("piece_rows", [7, 10_000])
def test_ordered_fold_is_independent_of_slices(table, piece_rows, monkeypatch):
    monkeypatch.setattr(ag, "RUN", 3)
    data, df = table
    text = F.coalesce(F.col("v"), F.lit("-"))
    got = ag.ordered_fold(df, ["k"], ["t"], text, F.lit(""), lambda a, x: F.concat(a, x), lambda a, b: F.concat(a, b), piece_rows=piece_rows)
    want = {}
    for k, t, v in sorted(data, key=lambda d: d[:2]):
        want[k] = want.get(k, "") + (v or "-")
    assert {r.k: r.folded for r in got.collect()} == want


def test_distinct_tuples_with_nulls(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (None, None), (None, None)], "a int, b int")
    assert ag.distinct_count(df, ["a", "b"]).first()[0] == 3


def test_a_null_key_is_cut_like_any_other(table):
    _, df = table
    hot = df.withColumn("k", F.when(F.col("k") != 0, F.col("k")))
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    want = hot.withColumn("x", F.last("v", ignorenulls=True).over(w))
    assert rows(od.carry(hot, ["k"], ["t"], F.col("v"), "x", hot_rows=10)) == rows(want)
    slices = od.slices_of_hot_keys(hot.select("k", F.col("t").alias("p")), ["k"], "p", 100)
    cut = od.in_slices(hot.withColumn("p", F.col("t")), slices, ["k"], "p", "part", "left")
    assert cut.filter("k is null").select("part").distinct().count() > 1
    pieces = ag.collect_groups(hot, ["k"], ["t"], piece_rows=20).filter("k is null")
    assert pieces.count() > 5 and pieces.agg(F.sum(F.size("members"))).first()[0] == hot.filter("k is null").count()


@pytest.mark.parametrize("piece_rows", [1, 9, 100, 10_000])
def test_pieces_are_consecutive_whatever_their_size(spark, piece_rows):
    """A burst at one time, ties, NULLs and text order, for one key with most rows."""
    rng = random.Random(9)
    data = [("hot", rng.choice([None, "", "b", "m", "m", "m", "z"]), i) for i in range(300)] + [(f"k{i % 7}", "x", i) for i in range(40)]
    df = spark.createDataFrame(data, "k string, t string, v int").repartition(5)
    got = ag.collect_groups(df, ["k"], ["t", "v"], piece_rows=piece_rows).collect()
    for k in {d[0] for d in data}:
        own = sorted((r for r in got if r.k == k), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert all(len(r.members) == piece_rows for r in own[:-1]) and len(own[-1].members) <= piece_rows
        members = [(m.t, m.v) for r in own for m in r.members]
        assert members == sorted(((t, v) for kk, t, v in data if kk == k), key=lambda m: (m[0] is not None, m[0] or "", m[1]))
    text = F.concat_ws("", F.col("v").cast("string"))
    folded = ag.ordered_fold(df, ["k"], ["t", "v"], text, F.lit(""), lambda a, x: F.concat(a, x), lambda a, b: F.concat(a, b), piece_rows=piece_rows)
    want = {k: "".join(str(v) for _, v in sorted(((t, v) for kk, t, v in data if kk == k), key=lambda m: (m[0] is not None, m[0] or "", m[1]))) for k in {d[0] for d in data}}
    assert {r.k: r.folded for r in folded.collect()} == want


def test_slices_of_equal_order_values_keep_their_size(spark):
    """All rows of the key at one time: a cut by time would leave one slice."""
    df = spark.range(500).select(F.lit(1).alias("k"), F.lit(7).alias("t"), F.col("id").alias("v"))
    cut = slices.pieces(df, ["k"], ["t"], 60, "piece")
    assert sorted(r["count"] for r in cut.groupBy("piece").count().collect()) == [20, *[60] * 8]
    same = slices.pieces(df.withColumn("v", F.lit(1)), ["k"], ["t"], 60, "piece")  # rows that nothing tells apart
    assert sorted(r["count"] for r in same.groupBy("piece").count().collect()) == [20, *[60] * 8]


def test_carry_over_text_order_in_slices(spark):
    rows_in = [("k", f"{i:03d}", i if i % 3 else None) for i in range(90)] + [("k", None, 500)]
    df = spark.createDataFrame(rows_in, "k string, t string, v int")
    for back in (False, True):
        w = Window.partitionBy("k").orderBy(F.col("t").desc() if back else F.col("t")).rowsBetween(Window.unboundedPreceding, -1)
        want = df.withColumn("x", F.last("v", ignorenulls=True).over(w))
        assert rows(od.carry(df, ["k"], ["t"], F.col("v"), "x", backwards=back, hot_rows=8)) == rows(want)
