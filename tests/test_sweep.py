"""Configurations, generated rows, and the published outcomes of the sweeps."""

import random

import pytest
from pyspark.sql import functions as F

from rowgrain.functions import grainsets as gs
from rowgrain.plans import examples as ex
from rowgrain.plans import sweep as sw
from rowgrain.plans.registry import audit_expected, audit_joins, audit_rollups, declared_joins, registry, table_grain
from rowgrain.sources import generate as gen
from rowgrain.spec import GrainSpec, MissingColumns, compare_grains, join_grain

# Configurations per class with at most five columns per table.
CLASS_COUNTS = {
    ("equal", False, False): 1980, ("equal", False, True): 376, ("equal", True, False): 376, ("equal", True, True): 227,
    ("incomparable", False, False): 640, ("incomparable", False, True): 524, ("incomparable", True, False): 524,
    ("incomparable", True, True): 1204, ("proper_subset", False, False): 1650, ("proper_subset", False, True): 708,
    ("proper_subset", True, False): 332, ("proper_subset", True, True): 520, ("proper_superset", False, False): 1650,
    ("proper_superset", False, True): 332, ("proper_superset", True, False): 708, ("proper_superset", True, True): 520,
}


def test_enumeration(spark):
    assert sw.count_configs(3) == 270 and sw.count_configs(5) == 12271
    configs = sw.derive(sw.all_configs(spark, 5))
    got = {(r.jk_rel, r.g1e, r.g2e): r["count"] for r in configs.groupBy("jk_rel", "g1e", "g2e").count().collect()}
    assert got == CLASS_COUNTS
    ids = configs.agg(F.count_distinct("config_id"), F.min("config_id"), F.max("config_id")).first()
    assert tuple(ids) == (12271, 0, 12270)


def test_derived_sets_equal_the_rules(spark):
    for r in sw.derive(sw.all_configs(spark, 3)).collect():
        assert r.g1 and r.g2 and set(r.jk) <= set(r.r1_fields) & set(r.r2_fields)
        assert set(r.g1) <= set(r.r1_fields) and set(r.g2) <= set(r.r2_fields)
        want = join_grain(r.g1, r.g2, r.jk)
        assert (set(r.f1), set(r.f2), set(r.convention), r.jk_rel) == (want.f1, want.f2, want.grain, want.relation)


def test_set_columns_equal_python_sets(spark):
    rng = random.Random(4)
    pick = lambda: rng.sample("abcde", rng.randint(0, 4))
    data = [(pick(), pick()) for _ in range(60)]
    df = spark.createDataFrame(data, "a array<string>, b array<string>")
    out = df.select(
        "a", "b", gs.union("a", "b").alias("u"), gs.intersection("a", "b").alias("i"), gs.difference("a", "b").alias("d"),
        gs.symmetric_difference("a", "b").alias("s"), gs.disjoint("a", "b").alias("x"), gs.compare("a", "b").alias("c"),
        gs.same_set("a", "b").alias("e"), gs.as_set(F.concat("a", "b")).alias("n"), gs.without_each("a").alias("w"),
    )
    for r in out.collect():
        a, b = set(r.a), set(r.b)
        assert (r.u, r.i, r.d, r.s) == tuple(map(sorted, (a | b, a & b, a - b, a ^ b)))
        assert (r.x, r.e, r.n) == (not a & b, a == b, sorted(a | b))
        assert r.c == compare_grains(a, b)
        assert {w.dropped: set(w.rest) for w in r.w} == {c: a - {c} for c in a}


@pytest.fixture(scope="module")
def checked(spark):
    numbers = spark.range(270 * 16)
    return sw.sweep(numbers, "id", sw.all_configs(spark, 3), 270).collect()


def test_sweep_finds_no_failure(checked):
    assert len(checked) == 270
    for r in checked:
        assert "fail" not in [r[p] for p in sw.PROPERTIES], r
        assert r.n_rows >= 16
    assert any(r.p2 == "pass" and r.n_rows > 16 for r in checked)


def test_sweep_results_against_brute_force(spark):
    """Redo a few configurations from their rows in plain Python."""
    derived = sw.derive(sw.all_configs(spark, 3)).filter("config_id % 9 = 0")
    placed = sw.placed_rows(spark.range(270 * 12), "id", 270)
    left, right = (sw.table_rows(placed, derived, s) for s in (1, 2))
    results = {r.config_id: r for r in sw.check_properties(derived, left, right).collect()}
    ls, rs = left.collect(), right.collect()
    for c in derived.collect():
        l = [dict(zip(c.r1_fields, r.vals)) for r in ls if r.config_id == c.config_id]
        r = [dict(zip(c.r2_fields, x.vals)) for x in rs if x.config_id == c.config_id]
        joined = [{**a, **b} for a in l for b in r if all(a[k] == b[k] for k in c.jk)]
        distinct = lambda t, cols: len({tuple(x[i] for i in sorted(cols)) for x in t})
        gone = lambda t, cols: [x for x in cols if len(cols) > 1 and len(t) > 1 and distinct(t, set(cols) - {x}) == len(t)]
        assert distinct(l, c.g1) == len(l) and distinct(r, c.g2) == len(r)
        got = results[c.config_id]
        assert got.n_rows == len(joined)
        unique = distinct(joined, c.f1) == distinct(joined, c.f2) == len(joined)
        assert got.p1 == ("pass" if unique else "fail")
        fine = not gone(l, c.g1) and not gone(r, c.g2) and not gone(joined, c.convention)
        assert got.p2 == ("pass" if len(c.convention) <= 1 or len(joined) <= 1 or fine else "inconclusive")


def test_a_false_grain_is_reported(spark):
    """Rows that repeat a claimed grain make P1 fail."""
    derived = sw.derive(sw.edge_cases(spark))
    placed = sw.placed_rows(spark.range(160), "id", 16)
    left, right = (sw.table_rows(placed, derived, s) for s in (1, 2))
    twice = left.unionByName(left.filter("config_id = 5"))
    bad = {r.config_id for r in sw.check_properties(derived, twice, right).collect() if r.p1 == "fail"}
    assert bad == {5}


def test_edge_cases(spark):
    derived = {r.name: r for r in sw.derive(sw.edge_cases(spark)).collect()}
    assert len(derived) == 16
    # How the grains stand to each other inside the join key.
    want = "equal proper_subset proper_superset equal incomparable equal proper_subset equal proper_subset equal equal proper_superset equal incomparable equal equal".split()
    assert [derived[e[0]].jk_rel for e in sw.EDGE_CASES] == want
    sizes = {}
    for pool in (None, 16):  # even, and with one frequent join-key value
        rows = sw.sweep(spark.range(16 * 50), "id", sw.edge_cases(spark), 16, skew_pool=pool).collect()
        assert len(rows) == 16 and all(r[p] != "fail" and r.n_rows > 0 for r in rows for p in sw.PROPERTIES)
        sizes[pool] = sum(r.n_rows for r in rows)
    assert sizes[16] > sizes[None]


def test_random_configurations_reach_every_class(spark):
    configs = sw.random_configs(spark.range(10_000).withColumnRenamed("id", "config_id"), "config_id")
    derived = sw.derive(configs)
    assert derived.select("jk_rel", "g1e", "g2e").distinct().count() == 16
    widest = derived.agg(F.max(F.size("r1_fields") + F.size("r2_fields") - F.size("jk"))).first()[0]
    assert widest == 22


def test_both_formulas_on_350_examples(spark):
    """The present formula: unique and minimal always.  The older one: minimal only in case A."""
    derived = sw.derive(ex.examples(spark))
    placed = sw.placed_rows(spark.range(350 * 400), "id", 350)
    left = ex.left_rows(placed, derived)
    out = sw.formula_summary(sw.compare_formulas(derived, left, ex.right_rows(left, derived)), ["case_type"]).collect()
    got = {r.case_type: r for r in out}
    assert {c: r.n_examples for c, r in got.items()} == {"A": 200, "B": 150}
    assert {c: r.old_unique for c, r in got.items()} == {"A": 200, "B": 150}
    assert {c: r.new_unique for c, r in got.items()} == {"A": 200, "B": 150}
    assert {c: r.new_minimal for c, r in got.items()} == {"A": 200, "B": 150}
    assert {c: r.old_minimal for c, r in got.items()} == {"A": 200, "B": 0}


def test_worked_examples(spark):
    rows = ex.build_worked()
    assert len(rows) == 100
    derived = sw.derive(ex.examples(spark, rows))
    placed = sw.placed_rows(spark.range(100 * 3000), "id", 100)
    left = ex.left_rows(placed, derived)
    out = sw.compare_formulas(derived, left, ex.right_rows(left, derived)).collect()
    assert all(r.result_rows > 1 and r.new_unique and r.new_minimal and r.old_unique for r in out)
    assert all(r.old_minimal == (r.case_type == "A") for r in out)


def test_removable_column_of_the_older_formula_is_named(spark):
    derived = sw.derive(ex.examples(spark)).filter("category = 'main' and case_type = 'B' and config_id < 4")
    placed = sw.placed_rows(spark.range(350 * 60), "id", 350)
    left = ex.left_rows(placed, derived)
    for r in sw.compare_formulas(derived, left, ex.right_rows(left, derived)).collect():
        assert "b" in r.old_removable and r.new_minimal and set(r.superseded) == {"a", "b", "c"}


# Generated tables ------------------------------------------------------------

CONFIG = dict(fields=["a0", "a1", "j0", "j1"], jk=["j0", "j1"], grain=["a0", "j0"])


FANS = [dict(rows_per_key=1), dict(rows_per_key=2), dict(rows_per_key=5), dict(rows_per_key=3, skew=1), dict(rows_per_key=3, skew=2)]


@pytest.mark.parametrize("fan", FANS)
def test_generated_table_obeys_its_key(spark, fan):
    df = gen.generate_table(spark, "r1", n_rows=40, **fan, **CONFIG)
    rows = df.collect()
    assert df.columns == CONFIG["fields"] and len(rows) == 40
    assert len({(r.a0, r.j0) for r in rows}) == 40
    assert len({(r.j0, r.j1) for r in rows}) == len({r.j0 for r in rows})  # each key column tells the value apart
    assert rows == gen.generate_table(spark, "r1", n_rows=40, **fan, **CONFIG).collect()
    assert rows != gen.generate_table(spark, "r1", n_rows=40, seed=7, **fan, **CONFIG).collect()


def test_generated_tables_meet(spark):
    for grain2 in (["b0"], ["j0"], ["j0", "b0"]):
        for fan in FANS:
            l = gen.generate_table(spark, "r1", n_rows=20, **fan, **CONFIG)
            r = gen.generate_table(spark, "r2", ["j0", "j1", "b0"], ["j0", "j1"], grain2, 20, **fan)
            assert l.join(r, ["j0", "j1"]).limit(1).count() == 1


def test_rows_per_key_and_skew(spark):
    def fan(**how):
        per_key = gen.generate_table(spark, "r1", n_rows=100, **how, **CONFIG).groupBy("j0").count()
        return per_key.count(), per_key.agg(F.max("count")).first()[0]

    assert fan(rows_per_key=5) == (20, 5) and fan(rows_per_key=2) == (50, 2) and fan(rows_per_key=1) == (100, 1)
    assert fan(rows_per_key=2)[1] < fan(rows_per_key=2, skew=1)[1] < fan(rows_per_key=2, skew=2)[1]


def test_single_row_and_bad_arguments(spark):
    assert gen.generate_table(spark, "r1", n_rows=1, **CONFIG).count() == 1
    for bad in (dict(n_rows=0), dict(rows_per_key=0.5), dict(skew=-1)):
        with pytest.raises(ValueError):
            gen.generate_table(spark, "r1", **bad, **CONFIG)


def test_counter_and_partner(spark):
    left = gen.keyed_rows(gen.series(spark, 0, 99), "i", ["a", "c"], [5, 4], b=(F.col("i") * 3) % 7)
    assert left.count() == 20 and left.select("a", "c").distinct().count() == 20
    right = gen.dense_partner(left, ["a", "b"], ["b", "d"], {"d": 3}, v=F.col("d") * 10)
    assert set(right.columns) == {"a", "b", "d", "v"}
    assert right.count() == left.select("b").distinct().count() * 3 == right.select("b", "d").distinct().count()
    assert left.join(right, ["a", "b"]).limit(1).count() == 1
    endless = gen.keyed_rows(gen.series(spark, 0, 999), "i", ["a", "c"], [None, 4])
    assert endless.count() == 1000 and endless.agg(F.max("a")).first()[0] == 250


def test_digits_of_numbers_beyond_double_precision(spark):
    from rowgrain.functions.columns import digit

    big = [2**53 + 1, 2**60 + 7, 10**18 - 1]
    df = spark.createDataFrame([(n,) for n in big], "n bigint").select("n", digit(F.col("n"), 3, 1000).alias("d"))
    assert {r.n: r.d for r in df.collect()} == {n: n // 3 % 1000 + 1 for n in big}


def test_shuffled_is_repeatable(spark):
    ids = lambda seed: [r.id for r in gen.shuffled(spark.range(50), ["id"], seed).collect()]
    assert ids(1) == ids(1) != ids(2) and sorted(ids(1)) == list(range(50)) != ids(1)


# Registry --------------------------------------------------------------------

def test_registry_audit(spark):
    spec = lambda *g: GrainSpec(frozenset(g))
    reg = registry(spark, {
        "sales": (["customer", "date", "amount"], spec("customer", "date")),
        "visits": (["customer", "date", "n"], spec("customer", "date")),
        "customer": (["customer", "name"], spec("customer")),
    })
    joins = declared_joins(spark, [
        ("sales", "visits", ["customer", "date"]), ("sales", "visits", ["customer"]), ("sales", "customer", ["customer"]),
        ("customer", "sales", ["customer"]), ("sales", "customer", ["name"]),
    ])
    got = {r.join_no: r for r in audit_joins(reg, joins).collect()}
    assert [got[i].shape for i in range(1, 5)] == ["one_to_one", "many_to_many", "many_to_one", "one_to_many"]
    # Equal grains joined on part of them repeat each other's rows.
    assert (got[2].repeats_left, got[2].repeats_right) == (True, True)
    assert (got[1].repeats_left, got[1].repeats_right) == (False, False)
    assert set(got[3].grain) == {"customer", "date"} and not got[5].key_on_both
    wanted = spark.createDataFrame([(1, ["date", "customer"]), (2, ["customer", "date"])], "join_no int, target array<string>")
    assert [r.join_no for r in audit_expected(reg, audit_joins(reg, joins), wanted).collect()] == []
    wanted = spark.createDataFrame([(3, ["customer"])], "join_no int, target array<string>")
    assert [r.join_no for r in audit_expected(reg, audit_joins(reg, joins), wanted).collect()] == [3]
    ups = spark.createDataFrame([("sales", ["customer"]), ("customer", ["region"])], "table_name string, target array<string>")
    assert {r.table_name: (r.columns_exist, r.grain_is) for r in audit_rollups(reg, ups).collect()} == {
        "sales": (True, "finer"), "customer": (False, "incomparable")
    }
    assert table_grain(reg, "sales") == {"customer", "date"}
    with pytest.raises(MissingColumns):
        table_grain(reg, "nowhere")


def test_key_counts_by_rows_of_a_configuration(spark, monkeypatch):
    """Small configurations are counted in one task each; the rows of a large one are spread and only its keys meet."""
    configs = sw.derive(sw.edge_cases(spark))
    numbers = spark.range(640).select(F.when(F.col("id") % 50 != 0, F.col("id")).alias("n"))
    placed = sw.placed_rows(numbers.unionAll(numbers.limit(40)), "n", len(sw.EDGE_CASES))
    left, right = (sw.table_rows(placed, configs, side) for side in (1, 2))
    rows = lambda df: sorted(map(tuple, df.collect()))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    small = sw.key_counts(configs, left, right, True)
    want = rows(small)
    assert want and "hashpartitioning(config_id#" in plan(small)
    monkeypatch.setattr(sw, "CONFIG_KEYS", 0)
    monkeypatch.setattr(sw, "TASK_KEYS", 100)
    large = sw.key_counts(configs, left, right, True)
    assert rows(large) == want
    keyed = [x for x in plan(large).splitlines() if "hashpartitioning(config_id#" in x and ", no#" in x and ", a#" in x]
    assert keyed
    monkeypatch.setattr(sw, "CONFIG_KEYS", 1_000_000)
    many = sw.key_counts(configs, left, right, True)
    assert rows(many) == want and many.rdd.getNumPartitions() > 50
