"""The grained frame: inferred grains, refusals before any job, right totals."""

import pytest
from pyspark.sql import functions as F

from rowgrain import (
    FanTrap, GrainedFrame, GrainError, GrainLost, GrainMismatch, MissingColumns, requires_grain, safe_join_aggregate, source,
)
from rowgrain.operators import aggregates as ag
from rowgrain.operators import joins as jn
from rowgrain.operators import sets as st
from rowgrain.plans import reports
from rowgrain.spec import GrainSpec


@pytest.fixture(scope="module")
def orders(spark):
    df = spark.createDataFrame([(1, 7, 10.0), (2, 7, 20.0), (3, 8, 5.0), (4, 9, 1.0)], "o_orderkey int, o_custkey int, o_totalprice double")
    return source(df, "o_orderkey", entity_key="o_orderkey", measures=["o_totalprice"])


@pytest.fixture(scope="module")
def items(spark):
    df = spark.createDataFrame(
        [(1, 1, 2.0), (1, 2, 3.0), (2, 1, 4.0), (3, 1, 6.0)], "l_orderkey int, l_linenumber int, l_quantity double"
    )
    return source(df, ["l_orderkey", "l_linenumber"], measures=["l_quantity"])


@pytest.fixture(scope="module")
def customers(spark):
    df = spark.createDataFrame([(7, "x", 100.0), (8, "y", 200.0), (9, "z", 300.0)], "c_custkey int, name string, balance double")
    return source(df, "c_custkey", entity_key="c_custkey", measures=["balance"])


def rows(frame):
    df = frame.df if isinstance(frame, GrainedFrame) else frame
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_grains_without_a_job(no_jobs, orders, items, customers):
    assert orders.where("o_totalprice > 3").grain == {"o_orderkey"}
    assert orders.select("o_orderkey").grain == {"o_orderkey"}
    assert orders.extend(x=F.lit(1)).grain == {"o_orderkey"}
    assert orders.rename({"o_orderkey": "k"}).grain == {"k"}
    assert orders.rename({"o_orderkey": "k"}).entity_key == {"k"}
    assert orders.project_distinct("o_custkey").grain == {"o_custkey"}
    assert items.join(orders, [("l_orderkey", "o_orderkey")]).grain == {"l_orderkey", "l_linenumber"}
    assert orders.join(items, [("o_orderkey", "l_orderkey")]).grain == {"o_orderkey", "l_linenumber"}
    assert orders.join(customers, [("o_custkey", "c_custkey")]).grain == {"o_orderkey"}
    assert orders.product(customers).grain == {"o_orderkey", "c_custkey"}
    assert orders.semi_join(items, [("o_orderkey", "l_orderkey")]).grain == {"o_orderkey"}
    assert orders.aggregate([], n=ag.rows()).grain == frozenset()
    assert repr(orders).startswith("GrainedFrame(")


def test_all_refusals_without_a_job(no_jobs, orders, items, customers):
    with pytest.raises(GrainLost):
        orders.select("o_custkey")
    with pytest.raises(GrainLost):
        orders.extend(o_orderkey=F.lit(1))
    with pytest.raises(MissingColumns):
        source(orders.df, "nope")
    with pytest.raises(GrainError):
        orders.natural_join(items)
    with pytest.raises(GrainError):
        orders.join(items, [])
    with pytest.raises(GrainError):
        orders.rename({"o_orderkey": "o_custkey"})
    with pytest.raises(GrainMismatch):
        reports.joined_only(orders, items)
    with pytest.raises(FanTrap):
        reports.joined_then_grouped(orders, items)
    with pytest.raises(GrainMismatch):
        items.aggregate_to(["l_shipmode"])
    with pytest.raises(AttributeError):
        orders.df = None


def test_safe_report_totals(orders, items):
    got = {r.o_custkey: (r.n_orders, float(r.total_price), r.total_qty and float(r.total_qty)) for r in reports.grouped_then_joined(orders, items).df.collect()}
    assert got == {7: (2, 30.0, 9.0), 8: (1, 5.0, 6.0), 9: (1, 1.0, None)}


def test_fan_trap_depends_on_the_measure(orders, items, customers):
    joined = orders.join(items, [("o_orderkey", "l_orderkey")])
    joined.aggregate("o_custkey", qty=ag.total("l_quantity"))  # its own grain
    joined.aggregate("o_custkey", top=ag.greatest("o_totalprice"), n=ag.different("o_orderkey"))  # repeats do not matter
    for bad in (ag.total("o_totalprice"), ag.mean("o_totalprice"), ag.filled("o_totalprice")):
        with pytest.raises(FanTrap):
            joined.aggregate("o_custkey", x=bad)
    with pytest.raises(FanTrap):
        orders.join(customers, [("o_custkey", "c_custkey")]).aggregate("name", x=ag.total("balance"))


def test_fan_trap_survives_projection_rename_and_latest(orders, items):
    joined = orders.join(items, [("o_orderkey", "l_orderkey")])
    renamed = joined.rename({"o_totalprice": "price", "o_orderkey": "k"}).select("k", "l_linenumber", "price", "o_custkey")
    with pytest.raises(FanTrap):
        renamed.aggregate("o_custkey", x=ag.total("price"))
    per_line = joined.first_per(["l_linenumber", "o_custkey"], ["o_orderkey"])
    with pytest.raises(FanTrap):  # one order can be there under several line numbers
        per_line.select("l_linenumber", "o_custkey", "o_totalprice").aggregate([], x=ag.total("o_totalprice"))
    once = joined.first_per(["o_custkey"], ["o_orderkey", "l_linenumber"])
    assert rows(once.aggregate([], x=ag.total("o_totalprice"))) == [(15.0,)]  # no order can be there twice


def test_one_to_one_join_keeps_measures_usable(orders, items):
    per_order = items.aggregate("l_orderkey", qty=ag.total("l_quantity"))
    one = orders.join(per_order, [("o_orderkey", "l_orderkey")], "left")
    assert one.grain == {"o_orderkey"}
    total = one.aggregate([], price=ag.total("o_totalprice"), qty=ag.total("qty"))
    assert rows(total) == [(36.0, 15.0)]


def test_join_names_and_suffixes(spark):
    a = source(spark.createDataFrame([(1, 2, 3)], "k int, g int, v int"), ["k", "g"])
    b = source(spark.createDataFrame([(1, 5, 6)], "k int, g int, v int"), ["k", "g"])
    j = a.join(b, "k")
    assert set(j.columns) == {"k", "g_r1", "v_r1", "g_r2", "v_r2"}
    assert j.grain == {"k", "g_r1", "g_r2"}
    assert j.df.collect()[0].asDict() == {"k": 1, "g_r1": 2, "v_r1": 3, "g_r2": 5, "v_r2": 6}
    self_join = a.join(a, "k")
    assert self_join.grain == {"k", "g_r1", "g_r2"}
    renamed = a.join(source(spark.createDataFrame([(2, 9)], "id int, k int"), "id"), [("g", "id")])
    assert renamed.df.collect()[0].asDict() == {"g": 2, "k_r1": 1, "v": 3, "k_r2": 9} or renamed.df.collect()[0].asDict()["k_r2"] == 9


def test_same_grain_join_needs_the_whole_grain(spark):
    a = source(spark.createDataFrame([(1, 1, 5), (1, 2, 6)], "c int, d int, x int"), ["c", "d"])
    b = source(spark.createDataFrame([(1, 1, 7), (1, 2, 8)], "c int, d int, y int"), ["c", "d"])
    assert a.join_same_grain(b, ["c", "d"]).count() == 2
    with pytest.raises(FanTrap):
        a.join_same_grain(b, ["c"])
    with pytest.raises(GrainMismatch):
        a.join_same_grain(b.aggregate("c", n=ag.rows()), ["c"])


def test_full_join_of_totals(spark):
    a = source(spark.createDataFrame([(1, 10), (2, 20)], "k int, x int"), "k", measures=["x"])
    b = source(spark.createDataFrame([(2, 5), (3, 6)], "k int, y int"), "k", measures=["y"])
    assert rows(a.full_join_totals(b, ["k"])) == [(1, 10, 0), (2, 20, 5), (3, 0, 6)]


@pytest.mark.parametrize("how", ["left", "right", "full"])
def test_outer_joins_in_parts_equal_native_ones(spark, how):
    data = lambda n, m: [(i, None if i % 11 == 0 else 0 if i % 3 == 0 else i % m, i * 2) for i in range(n)]
    a = source(spark.createDataFrame(data(40, 9), "id int, k int, v int"), "id")
    b = source(spark.createDataFrame(data(30, 13), "no int, key int, v int"), "no")
    got = a.join(b, [("k", "key")], how)
    native = jn.equi_join(a.df, b.df, [("k", "key")], how)
    assert "Union" in got.df._jdf.queryExecution().optimizedPlan().toString()
    assert rows(got.df.select(*sorted(got.columns))) == rows(native.select(*sorted(native.columns)))
    with pytest.raises(ValueError):
        a.join(b, [("k", "key")], "left_semi")


def test_safe_join_aggregate(orders, items):
    owned = items.join(orders.select("o_orderkey", "o_custkey"), [("l_orderkey", "o_orderkey")])
    out = safe_join_aggregate(
        [(orders, {"price": ag.total("o_totalprice")}), (owned, {"qty": ag.total("l_quantity")})], ["o_custkey"]
    )
    assert rows(out) == [(7, 30.0, 9.0), (8, 5.0, 6.0), (9, 1.0, 0.0)]


def test_incomparable_join_has_two_keys(spark):
    a = source(spark.createDataFrame([(1, 1, 1)], "a int, b int, c int"), ["a", "b"])
    b = source(spark.createDataFrame([(1, 1, 1)], "b int, c int, d int"), ["c", "d"])
    j = a.natural_join(b)
    assert j.grain == {"a", "b", "d"} and j.spec.alternatives == (frozenset("acd"),)
    assert j.expect_grain("a", "c", "d") is j


def test_product_and_theta_join_against_brute_force(spark):
    a = source(spark.range(23).selectExpr("id as x", "id % 5 as p"), "x")
    b = source(spark.range(17).selectExpr("id as y", "id % 7 as p"), "y")
    every = a.product(b, grid=(3, 4))
    assert rows(every.df.select("x", "y")) == sorted(((x, y) for x in range(23) for y in range(17)), key=repr)
    less = a.theta_join(b, F.col("x") + F.col("p_r1") < F.col("y"))
    assert rows(less.df.select("x", "y")) == sorted(((x, y) for x in range(23) for y in range(17) if x + x % 5 < y), key=repr)
    assert less.grain == {"x", "y"}
    from rowgrain.operators.joins import balanced_grid

    assert balanced_grid(a.df, b.df, 16) == (5, 3) and balanced_grid(a.df, b.df.limit(1), 16) == (16, 1)
    assert a.product(b).count() == 23 * 17


def test_semi_and_anti(orders, items):
    assert rows(orders.semi_join(items, [("o_orderkey", "l_orderkey")]).select("o_orderkey")) == [(1,), (2,), (3,)]
    assert rows(orders.anti_join(items, [("o_orderkey", "l_orderkey")]).select("o_orderkey")) == [(4,)]


def test_map_rows_keeps_the_first(orders):
    m = orders.map_rows({"c": F.col("o_custkey"), "first": F.col("o_orderkey")}, grain=["c"], order=["o_orderkey"])
    assert rows(m) == [(7, 1), (8, 3), (9, 4)] and m.grain == {"c"}


def test_entities_and_factor(orders, customers):
    wide = orders.join(customers, [("o_custkey", "c_custkey")])
    rest, dim = wide.factor(["o_custkey"], ["name", "balance"])
    again = rest.join(dim, "o_custkey")
    assert rows(again.df.select(*sorted(wide.columns))) == rows(wide.df.select(*sorted(wide.columns)))
    versions = source(wide.df, ["o_custkey", "o_orderkey"], entity_key="o_custkey", fds=[("o_custkey", "name")])
    assert rows(versions.entities("name")) == [(7, "x"), (8, "y"), (9, "z")]
    with pytest.raises(GrainError):
        versions.entities("o_totalprice")


def test_latest_takes_the_whole_row(spark):
    v = spark.createDataFrame([(1, 1, "old"), (1, 3, "new"), (1, 2, "mid"), (2, 9, "only")], "k int, t int, name string")
    f = source(v, ["k", "t"], entity_key="k")
    assert rows(f.latest(["t"])) == [(1, 3, "new"), (2, 9, "only")]
    assert f.latest(["t"]).grain == {"k"}


def test_windows(spark):
    v = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (2, 9, "c")], "k int, t int, name string")
    f = source(v, ["k", "t"], entity_key="k")
    got = {(r.k, r.t): r.previous and r.previous.name for r in f.previous(["t"], ["name"]).df.collect()}
    assert got == {(1, 1): None, (1, 3): "a", (2, 9): None}
    got = {(r.k, r.t): r.following and r.following.name for r in f.following(["t"], ["name"]).df.collect()}
    assert got == {(1, 1): "b", (1, 3): None, (2, 9): None}


def test_set_operations(spark):
    a = source(spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), "k")
    b = source(spark.createDataFrame([(2, "y"), (3, "z")], "k int, v string"), "k")
    assert st.union_rows(a, b).grain == {"k", "v"}
    assert st.union_rows(a, b, rows_agree=True).grain == {"k"}
    assert rows(st.union_rows(a, b)) == [(1, "x"), (2, "y"), (3, "z")]
    assert rows(st.intersect_rows(a, b)) == [(2, "y")]
    assert rows(st.subtract_rows(a, b)) == [(1, "x")]
    t = st.tagged_union("side", left=a, right=b.rename({"k": "id"}))
    assert t.grain == {"side", "k", "id"} and t.count() == 4


# Five misuses that a grain contract stops ------------------------------------

@requires_grain("customer_id")
def entity_report(frame):
    return frame


@requires_grain("customer_id", "effective_from", kind="version")
def version_report(frame):
    return frame


@requires_grain("customer_id", "created_on", "event_type", entity_key=["customer_id"])
def event_report(frame):
    return frame


@pytest.fixture(scope="module")
def kinds(spark):
    entity = source(spark.createDataFrame([(1, "n", "m")], "customer_id int, name string, email string"), "customer_id", kind="entity")
    version = source(
        spark.createDataFrame([(1, "2024", "n")], "customer_id int, effective_from string, name string"),
        ["customer_id", "effective_from"], entity_key="customer_id", kind="version",
    )
    event = source(
        spark.createDataFrame([(1, "2024", "t")], "customer_id int, created_on string, event_type string"),
        ["customer_id", "created_on", "event_type"], entity_key="customer_id", kind="event",
    )
    return entity, version, event


def test_contracts_accept_the_right_kind(kinds):
    entity, version, event = kinds
    assert entity_report(entity) is entity and version_report(version) is version and event_report(event) is event
    assert entity_report(version.latest(["effective_from"])).grain == {"customer_id"}


def test_contracts_refuse_misuse(no_jobs, kinds):
    entity, version, event = kinds
    with pytest.raises(GrainMismatch):
        entity_report(version)  # versions where entities are needed
    with pytest.raises(GrainMismatch):
        version_report(version.aggregate("customer_id", n=ag.rows()))  # grouped too far
    with pytest.raises(GrainMismatch):
        entity.join_same_grain(event, "customer_id")  # two kinds joined as one
    with pytest.raises(GrainMismatch):
        event_report(entity)  # entities where events are needed
    with pytest.raises(GrainLost):
        version.select("customer_id", "name")  # grain column lost on the way
    with pytest.raises(TypeError):
        entity_report(entity.df)


def test_a_measure_stays_guarded_under_another_name(spark, no_jobs):
    orders = source(spark.createDataFrame([(1, 10.0, 3)], "o long, p double, other int"), "o", measures=["p"])
    items = source(spark.createDataFrame([(1, 1, 2), (1, 2, 5)], "o long, line int, qty int"), ["o", "line"])
    joined = orders.join(items, "o")
    for made in (F.col("p") * 1, F.lit(2) + F.col("p"), F.col("other") + F.col("p"), F.coalesce("p", "qty") * 0 + F.col("p")):
        if "qty" not in str(made):
            with pytest.raises(FanTrap):
                joined.extend(p2=made).aggregate([], s=ag.total("p2"))
    with pytest.raises(FanTrap):
        joined.extend(p=F.col("p") + 0).aggregate([], s=ag.total("p"))  # overwritten
    with pytest.raises(FanTrap):
        joined.aggregate([], s=ag.total("other"))  # never declared
    with pytest.raises(FanTrap):
        joined.extend(a=F.col("other") + 1).extend(b=F.col("a") + 1).rename({"b": "c"}).aggregate([], s=ag.total("c"))
    joined.extend(q2=F.col("qty") * 2).aggregate([], s=ag.total("q2"))
    joined.extend(value=F.col("qty") * F.col("p")).aggregate("o", s=ag.total("value"))  # one fact per item
    joined.extend(one=F.lit(1)).aggregate([], s=ag.total("one"))
    orders.extend(p2=F.col("p") * 2).aggregate([], s=ag.total("p2"))
    joined.aggregate(["o"], s=ag.total("qty")).aggregate([], t=ag.total("s"))


def test_many_to_many_join_is_grouped_by_its_key_without_its_pairs(spark):
    a = spark.createDataFrame([(1, 1, None), (2, 1, 5.0), (3, 1, 5.0), (4, 2, 1.0), (5, None, 2.0), (5, None, 2.0)], "a int, k int, x double")
    b = spark.createDataFrame([(1, 1, "p"), (2, 1, None), (2, 1, None), (3, 3, "q"), (4, None, "r")], "b int, j int, y string")
    joined = GrainedFrame(a, GrainSpec(frozenset({"a"}))).join(GrainedFrame(b, GrainSpec(frozenset({"b"}))), [("k", "j")])
    aggs = dict(n=ag.rows(), da=ag.different("a"), dx=ag.different("x"), lo=ag.least("y"), hi=ag.greatest("x"), k2=ag.greatest("k"))
    plain = joined.df.groupBy("k").agg(*[x.expression().alias(n) for n, x in aggs.items()])
    got = joined.aggregate("k", **aggs).df
    assert got.columns == plain.columns and got.dtypes == plain.dtypes
    assert got.collect() == plain.collect() == [(1, 9, 3, 1, "p", 5.0, 1)]
    million = spark.range(1_000_000)
    left = GrainedFrame(million.selectExpr("id as a", "id % 2 as k"), GrainSpec(frozenset({"a"})))
    right = GrainedFrame(million.selectExpr("id as b", "id % 2 as k"), GrainSpec(frozenset({"b"})))
    pairs = left.join(right, "k").aggregate("k", n=ag.rows(), d=ag.different("a")).df.collect()
    assert sorted(map(tuple, pairs)) == [(0, 250_000_000_000, 500_000), (1, 250_000_000_000, 500_000)]
