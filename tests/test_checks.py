"""Key checks, trap measures and contracts, each on a good table and on one with a fault put in."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from rowgrain.operators import contracts as ct
from rowgrain.operators import traps
from rowgrain.operators import verify as vf
from rowgrain.sources.tables import KeyViolation, source
from rowgrain.spec import GrainError, MissingColumns


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def counts(rules):
    return {r.rule: r.n_violations for r in ct.report(rules).collect()}


def random_df(spark, rng, n, cols, values):
    data = [tuple(None if rng.random() < 0.1 else rng.randrange(values) for _ in cols) for _ in range(n)]
    return data, spark.createDataFrame(data, ", ".join(f"{c} int" for c in cols))


# Keys ------------------------------------------------------------------------

def test_uniqueness_counts_nulls_as_values(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (None, None), (None, None)], "a int, b int")
    assert rows(vf.uniqueness(df, ["a", "b"])) == [(4, 3, True)]
    assert rows(vf.duplicates(df, ["a", "b"])) == [(None, None, 2)]
    assert rows(vf.uniqueness(df.limit(0), ["a"])) == [(0, 0, False)]
    with pytest.raises(MissingColumns):
        vf.uniqueness(df, ["c"])


def test_reduced_counts_against_brute_force(spark):
    rng = random.Random(5)
    for n, width in ((0, 2), (1, 2), (9, 3), (12, 4)):
        cols = list("abcdefgh"[:width])
        data, df = random_df(spark, rng, n, cols, 3)
        got = {r.dropped: (r.n_rows, r.n_keys, r.removable) for r in vf.reduced_counts(df, cols).collect()}
        for dropped in [None, *cols]:
            keep = [i for i, c in enumerate(cols) if c != dropped]
            distinct = len({tuple(r[i] for i in keep) for r in data})
            assert got[dropped] == (n, distinct, dropped is not None and distinct == n and n > 1)


def test_reduced_counts_of_a_wide_key(spark):
    rng = random.Random(6)
    cols = list("abcdefg")
    data, df = random_df(spark, rng, 40, cols, 2)
    got = {r.dropped: r.n_keys for r in vf.reduced_counts(df, cols).collect()}
    for dropped in [None, *cols]:
        keep = [i for i, c in enumerate(cols) if c != dropped]
        assert got[dropped] == len({tuple(r[i] for i in keep) for r in data})


def test_keys(spark):
    df = spark.createDataFrame([(i, i % 3, i // 3) for i in range(9)], "id int, a int, b int")
    assert vf.is_key(df, ["id"]) and vf.is_key(df, ["a", "b"])
    assert vf.is_superkey(df, ["id", "a"]) and not vf.is_key(df, ["id", "a"])
    assert not vf.is_superkey(df, ["a"])
    assert vf.removable_columns(df, ["id", "a"]) == ["a"]
    assert rows(vf.minimality(df, ["a", "b"])) == [(9, 0, True)]


def test_dependency_violations(spark):
    df = spark.createDataFrame([(1, "x", 1), (1, "x", 2), (2, "y", 1), (2, None, 1), (3, None, 1), (3, None, 2)], "k int, v string, w int")
    assert rows(vf.dependency_violations(df, ["k"], ["v"])) == [(2, 2)]


def test_declared_key_is_checked(spark):
    with pytest.raises(KeyViolation):
        source(spark.createDataFrame([(1,), (1,)], "k int"), "k", verify=True)
    with pytest.raises(KeyViolation):
        source(spark.createDataFrame([(1,), (None,)], "k int"), "k", verify=True)
    source(spark.createDataFrame([(1,), (2,)], "k int"), "k", verify=True)


def audit(l, r, on, g1, g2):
    return {x.property[:2]: x.result for x in vf.audit_join(l, r, on, g1, g2).collect()}


def test_audit_join(spark):
    l = spark.createDataFrame([(a, c, (a + c) % 2) for a in range(3) for c in range(3)], "a int, c int, b int")
    r = spark.createDataFrame([(a, b, a % 2) for a in range(3) for b in range(2)], "a int, b int, c int")
    assert set(audit(l, r, ["a", "b", "c"], ["a", "c"], ["a", "b"]).values()) <= {"pass", "inconclusive"}
    one_to_many = audit(
        spark.createDataFrame([(i, i % 2) for i in range(6)], "id int, k int"), spark.createDataFrame([(0, 5), (1, 6)], "k int, v int"),
        "k", ["id"], ["k"],
    )
    assert one_to_many == {p: "pass" for p in ("P1", "P2", "P3", "P4", "P5", "P6")}
    false_claim = audit(
        spark.createDataFrame([(1, 0), (1, 0)], "id int, k int"), spark.createDataFrame([(0, 5)], "k int, v int"), "k", ["id"], ["k"]
    )
    assert false_claim["P1"] == "fail"


def test_audit_says_inconclusive_when_rows_prove_nothing(spark):
    l = spark.createDataFrame([(1, 1, 0), (2, 2, 0)], "a int, b int, k int")
    r = spark.createDataFrame([(0, 1), (0, 2)], "k int, d int")
    assert audit(l, r, "k", ["a", "b"], ["k", "d"])["P2"] == "inconclusive"


# Traps -----------------------------------------------------------------------

@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all left rows and a third of all right rows share one key."""
    l = [(i, 0 if i % 3 == 0 else i % 50, float(i)) for i in range(300)] + [(1000, None, 1.0)]
    r = [(0 if i % 3 == 0 else i % 70, i) for i in range(210)]
    return l, r, spark.createDataFrame(l, "id int, k int, m double"), spark.createDataFrame(r, "k int, x int")


def test_join_size_and_inflation_match_the_join(spark, skewed):
    l, r, ldf, rdf = skewed
    pairs = [(a, b) for a in l for b in r if a[1] is not None and a[1] == b[0]]
    size = traps.join_size(ldf, rdf, "k").first()
    rkeys, lkeys = {b[0] for b in r}, {a[1] for a in l}
    assert (size.n_left, size.n_right, size.n_result) == (len(l), len(r), len(pairs))
    assert size.left_unmatched == sum(a[1] not in rkeys for a in l)
    assert size.right_unmatched == sum(b[0] not in lkeys for b in r)
    got = traps.inflation(ldf, rdf, "k", F.col("m").cast("decimal(18,2)")).first()
    assert float(got.total_before) == sum(a[2] for a in l)
    assert float(got.total_after) == sum(a[2] for a, _ in pairs)


def test_chain_loss(spark, skewed):
    l, r, ldf, rdf = skewed
    keys = {b[0] for b in r}
    loss = traps.chain_loss([("l_to_r", ldf, rdf, "k"), ("r_to_l", rdf, ldf, "k")])
    got = {x.link: x for x in loss.collect()}
    assert (got["l_to_r"].n_rows, got["l_to_r"].n_null_key) == (len(l), 1)
    assert got["l_to_r"].n_unmatched == sum(a[1] is not None and a[1] not in keys for a in l)
    assert not got["l_to_r"].is_total
    whole = spark.createDataFrame([(k,) for k in keys], "k int")
    assert traps.is_safe_chain([("r_to_whole", rdf, whole, "k")])


def test_fan_trap_rule():
    assert traps.fan_trap("o", "c", "c") == (False, True)  # many to one
    assert traps.fan_trap("o", ["o", "l"], "o") == (True, False)  # one to many
    assert traps.fan_trap(["c", "x"], ["c", "y"], "c") == (True, True)  # both
    assert traps.fan_trap("k", "k", "k") == (False, False)


# Contracts -------------------------------------------------------------------

def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def versions(spark):
    data = [(e, day(10 * i + e), "ab"[i % 2]) for e in range(4) for i in range(6)]
    return data, spark.createDataFrame(data, "e int, t timestamp_ntz, p string")


def test_entity_event_sequence(spark, versions):
    data, good = versions
    assert ct.holds(ct.event(good, ["e"], "t")) and not ct.holds(ct.entity(good, ["e"]))
    twice = good.unionByName(good.filter("e = 1").limit(1))
    assert counts(ct.event(twice, ["e"], "t")) == {"entity_key_not_null": 0, "time_not_null": 0, "entity_and_time_unique": 1}
    missing = good.unionByName(spark.createDataFrame([(9, None, "a")], good.schema))
    assert counts(ct.event(missing, ["e"], "t"))["time_not_null"] == 1
    numbered = spark.createDataFrame([(i, day(i)) for i in range(5)], "e int, t timestamp_ntz")
    assert ct.holds(ct.sequence(numbered, ["e"], "t"))
    tie = numbered.unionByName(spark.createDataFrame([(7, day(2))], numbered.schema))
    assert counts(ct.sequence(tie, ["e"], "t")) == {"time_not_null": 0, "entity_key_unique": 0, "time_unique": 1}


@pytest.mark.parametrize("hot_rows", [2, 1000])
def test_versions_and_valid_to(spark, versions, hot_rows):
    data, good = versions
    assert ct.holds(ct.multi_version(good, ["e"], "t", ["p"], hot_rows))
    extra = spark.createDataFrame([(2, day(13), "b")], good.schema)  # after 12: "b" again
    broken = good.unionByName(extra)
    assert counts(ct.multi_version(broken, ["e"], "t", ["p"], hot_rows))["neighbours_differ"] == 1
    assert rows(ct.unchanged_versions(broken, ["e"], "t", ["p"], hot_rows)) == [(2, day(13), "b")]
    with pytest.raises(GrainError):
        ct.multi_version(good, ["e"], "t", ["t"])
    by_entity = {}
    for e, t, _ in data:
        by_entity.setdefault(e, []).append(t)
    want = {(e, t): nxt for e, ts in by_entity.items() for t, nxt in itertools.zip_longest(sorted(ts), sorted(ts)[1:])}
    got = {(r.e, r.t): r.valid_to for r in ct.valid_to(good, ["e"], "t", hot_rows=hot_rows).collect()}
    assert got == want


@pytest.mark.parametrize("some", [slice(None), slice(3, 4), slice(0, 1), slice(0, 0)])
def test_states_at_against_brute_force(spark, versions, some):
    data, df = versions
    moments = [day(-1), day(0), day(11), day(12), day(13), day(55), day(400)][some]
    times = spark.createDataFrame([(m,) for m in moments * 2], "at timestamp_ntz")
    want = []
    for m in moments:
        for e in range(4):
            past = [v for v in data if v[0] == e and v[1] <= m]
            if past:
                _, t, p = max(past, key=lambda v: v[1])
                want.append((m, e, t, p))
    got = rows(ct.states_at(df, ["e"], "t", ["p"], times, "at"))
    assert got == sorted(want, key=repr)
    assert got == rows(ct.states_at(df, ["e"], "t", ["p"], times, "at", hot_rows=3))
    # A row per version and the snapshots that show it.
    spans = {}
    for m, e, t, p in want:
        spans.setdefault((e, t, p), []).append(m)
    held = ct.state_intervals(df, ["e"], "t", ["p"], times, "at").collect()
    assert {(r.e, r.t, r.p): [m for m in sorted(set(moments)) if r.first_at <= m and (r.before_at is None or m < r.before_at)] for r in held} == {
        k: sorted(v) for k, v in spans.items()}
    assert len(held) == len(spans)


def test_snapshot_verdicts_find_every_fault(spark, versions):
    _, df = versions
    moments = [day(n) for n in (12, 20, 40, 400)]
    times = spark.createDataFrame([(m,) for m in moments], "at timestamp_ntz")
    told = [tuple(r) for r in ct.states_at(df, ["e"], "t", ["p"], times, "at").collect()]
    kinds = "at timestamp_ntz, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select("e", "t", "p").schema)
    faults = {"right": lambda x: x, "short": lambda x: x[1:], "twice": lambda x: [*x[1:], x[1]], "moved": lambda x: [(*x[0][:2], day(-9), x[0][3]), *x[1:]], "more": lambda x: [*x, x[0], x[0]]}
    for (name, fault), hot_rows in zip(faults.items(), (2, 1000, 1000, 1000, 1000)):
        rows_ = [r for m in moments for r in (fault([x for x in told if x[0] == m]) if m == day(40) else [x for x in told if x[0] == m])]
        flat = spark.createDataFrame(rows_, kinds)
        got = {r["at"]: r.same for r in ct.snapshot_verdicts(flat, "at", df, ["e"], "t", ["p"], hot_rows=hot_rows).collect()}
        assert got == {m: name == "right" or m != day(40) for m in {r[0] for r in told}}, name
        if name not in ("right", "twice"):
            continue
        nested = flat.groupBy("at").agg(F.collect_list(F.struct("e", "t", "p")).alias("all"))
        same = {r["at"]: r.same for r in ct.snapshot_verdicts(nested, "at", df, ["e"], "t", ["p"], "all", hot_rows=hot_rows).collect()}
        assert same == got
    named = flat.limit(0).unionByName(times.filter(F.col("at") == day(400)), allowMissingColumns=True)
    (nothing,) = ct.snapshot_verdicts(named, "at", df, ["e"], "t", ["p"]).collect()
    assert (nothing.n_told, nothing.same) == (0, False) and nothing.n_true > 0


def test_snapshot_contract(spark, versions):
    _, df = versions
    times = spark.createDataFrame([(day(20),), (day(40),)], "at timestamp_ntz")
    states = ct.states_at(df, ["e"], "t", ["p"], times, "at")
    nested = states.groupBy("at").agg(F.collect_list(F.struct("e", "t", "p")).alias("all"))
    assert ct.holds(ct.snapshot(nested, "at", "all", df, ["e"], "t", ["p"]))
    short = nested.withColumn("all", F.slice("all", 1, 3))
    assert counts(ct.snapshot(short, "at", "all", df, ["e"], "t", ["p"]))["collection_is_complete"] == 2


def test_parents_links_constraints(spark):
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    child = spark.createDataFrame([(1, 1), (2, None), (3, 9)], "c int, parent int")
    assert counts(ct.has_parent(child, ["parent"], parent, ["id"])) == {"parent_exists": 1, "parent_key_unique": 0}
    assert rows(ct.roots(child, ["parent"])) == [(2, None)]
    edges = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (5, 1)], "x int, y int")
    got = counts(ct.link(edges, ["x", "y"], ["x"], parent, ["id"], ["y"], parent, ["id"]))
    assert got == {"entity_key_unique": 1, "parties_not_null": 0, "pair_unique": 1, "party1_exists": 1, "party2_exists": 0}
    ask = spark.createDataFrame([(1, 2), (2, 2)], "x int, y int")
    assert rows(ct.relates_to(edges, ask, ["x", "y"])) == [(1, 2, True), (2, 2, False)]
    assert rows(ct.each_row(child, F.col("parent") < 5)) == [(2, None), (3, 9)]
    assert rows(ct.whole_collection(child, F.count("*") == 3)) == [(True,)]
    assert rows(ct.across(child, ["parent"], parent, ["id"])) == [(3, 9)]


def test_pair_counts_against_all_pairs(spark):
    rng = random.Random(3)
    data = [(rng.randrange(4), rng.randrange(6)) for _ in range(60)]
    df = spark.createDataFrame(data, "e int, t int")
    before = sum(a[1] < b[1] for a in data for b in data)
    together = sum(a[0] != b[0] and a[1] == b[1] for a, b in itertools.combinations(data, 2))
    got = ct.pair_counts(df, ["e"], "t").first()
    assert (int(got.n_before), int(got.n_concurrent)) == (before, together)


def test_row_relations(spark):
    df = spark.createDataFrame([(1, 5, 2, 5), (1, 5, 1, 5), (1, 4, 2, 5)], "e1 int, t1 int, e2 int, t2 int")
    c = [F.col(x) for x in df.columns]
    assert [r[0] for r in df.select(ct.ties(c[0], c[1], c[2], c[3])).collect()] == [True, False, False]
    assert [r[0] for r in df.select(ct.precedes(c[1], c[3])).collect()] == [False, False, True]


def test_classify(spark, versions):
    _, df = versions
    got = ct.classify({
        "event": ct.event(df, ["e"], "t"), "multi_version": ct.multi_version(df, ["e"], "t", ["p"]), "entity": ct.entity(df, ["e"]),
    })
    picked = {r["class"]: (r.holds, r.chosen) for r in got.collect()}
    assert picked == {"event": (True, False), "multi_version": (True, True), "entity": (False, False)}
    with pytest.raises(GrainError):
        ct.classify({"table": ct.entity(df, ["e"])})


def test_integrate(spark):
    a = source(spark.createDataFrame([(1, 5), (2, 6)], "e int, x int"), "e", entity_key="e", measures=["x"])
    b = source(spark.createDataFrame([(2, 1, 7), (2, 3, 8)], "e int, t int, y int"), ["e", "t"], entity_key="e", measures=["y"])
    out = ct.integrate([a, b.latest(["t"]).select("e", "y")], ["e"])
    assert rows(out.df) == [(1, 5, 0), (2, 6, 8)]
    with pytest.raises(GrainError):
        ct.integrate([a, b], ["e"])


def test_null_keys_and_parties_are_violations(spark):
    from rowgrain.operators import contracts as ct

    def broken(rules):
        return {r.rule for r in ct.report(rules).collect() if r.n_violations}

    events = spark.createDataFrame([(None, 1), (1, 1), (1, 2)], "k int, at int")
    assert broken(ct.event(events, ["k"], "at")) == {"entity_key_not_null"}
    parties = spark.createDataFrame([(1,), (2,)], "id int")
    links = spark.createDataFrame([(1, 1, 2), (2, None, 1)], "k int, a int, b int")
    assert broken(ct.link(links, ["k"], ["a"], parties, ["id"], ["b"], parties, ["id"])) == {"parties_not_null"}


def test_reduced_counts_share_a_shuffle_of_the_rows(spark):
    """Sets with a column of many values are counted where its rows are, not each shuffled by its own keys."""
    rows = [(i % 2000, i % 13, None if i % 5 == 0 else i % 700, "x" if i % 3 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "a int, g int, h int, t string")
    got = {r.dropped: (r.n_rows, r.n_keys, r.removable) for r in vf.reduced_counts(df, df.columns).collect()}
    count = lambda cols: df.select(*cols).distinct().count()
    want = {d: (n := count([c for c in df.columns if c != d])) for d in (None, *df.columns)}
    assert got == {d: (4000, n, d is not None and n == 4000) for d, n in want.items()} and set(want.values()) != {4000}
    plan = vf.reduced_counts(df, df.columns)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_at#" in plan
    empty = vf.reduced_counts(df.limit(0), df.columns).collect()
    assert {r.dropped for r in empty} == set(want) and {(r.n_rows, r.n_keys, r.removable) for r in empty} == {(0, 0, False)}
