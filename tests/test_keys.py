"""Key discovery and refutation on samples against brute force."""

from itertools import combinations

import numpy as np
import pytest

from rowgrain.operators import keys


def plain_unique(rows, cols, s):
    seen = [tuple(r[cols.index(c)] for c in sorted(s)) for r in rows]
    return len(set(seen)) == len(seen)


def plain_keys(rows, cols, most):
    found = []
    for k in range(1, most + 1):
        for s in map(frozenset, combinations(cols, k)):
            if not any(f <= s for f in found) and plain_unique(rows, cols, s):
                found.append(s)
    return found


def table(spark, seed, n=300, cols="abcde"):
    draw = np.random.default_rng(seed)
    wide = draw.integers(2, 60, len(cols))
    rows = {tuple(None if x == 0 else int(x) for x in draw.integers(0, wide)) for _ in range(n)}
    rows = sorted(rows, key=str)
    return spark.createDataFrame(rows, ", ".join(f"{c} int" for c in cols)), rows, list(cols)


@pytest.mark.parametrize("seed", range(3))
def test_discovery_equals_brute_force(spark, monkeypatch, seed):
    # Small samples, so that each of the three steps has something left to do.
    monkeypatch.setattr(keys, "PAIR_ROWS", 12)
    monkeypatch.setattr(keys, "SAMPLE_KEYS", 50)
    monkeypatch.setattr(keys, "AT_ONCE", 3)
    df, rows, cols = table(spark, seed)
    want = plain_keys(rows, cols, 4)
    assert set(keys.minimal_keys(df, cols, 4)) == set(want)
    got = {(r.key_columns, r.n_columns) for r in keys.discovered(df, cols, 4).collect()}
    assert got == {(",".join(sorted(k)), len(k)) for k in want}


def test_agreements_are_agreements(spark):
    df, rows, cols = table(spark, 7, n=120)
    for s in keys.agreements(df, cols):
        assert not plain_unique(rows, cols, s)
    assert not any(a < b for a in keys.agreements(df, cols) for b in keys.agreements(df, cols))


def test_a_rare_duplicate_is_found_by_its_hash(spark):
    rows = [(i, i * 7 % 5003, 1) for i in range(5000)] + [(4321, 4321 * 7 % 5003, 2)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    sets = [frozenset("a"), frozenset("ab"), frozenset("ac"), frozenset("c")]
    assert keys.refuted_by_hash(df, sets, 1) == {frozenset("a"), frozenset("ab"), frozenset("c")}
    # Classes are disjoint: a duplicate is in one of them with all its rows.
    got = keys.unique_sets(df, sets, known=[])
    assert got == {frozenset("a"): False, frozenset("ab"): False, frozenset("ac"): True, frozenset("c"): False}


def test_null_is_a_value_and_small_tables(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (3, 2)], "a int, b int")
    assert keys.minimal_keys(df) == [frozenset("ab")]
    assert keys.minimal_keys(df.limit(1)) == keys.minimal_keys(df.limit(0)) == [frozenset()]
    twice = df.unionAll(df)
    assert keys.minimal_keys(twice) == [] and keys.unique_sets(twice, [["a", "b"]]) == {frozenset("ab"): False}
    assert keys.unique_sets(df, [[]]) == {frozenset(): False}
    assert tuple(keys.is_key(df, ["a", "b"]).first()) == (True, True) and tuple(keys.is_key(df, ["a"]).first()) == (False, False)
    assert tuple(keys.accept_grain(df, ["a", "b"]).first()) == (3, 3, True, True)
    assert tuple(keys.minimality(df.limit(1), ["a", "b"]).first()) == (1, 0, True)
    assert tuple(keys.accept_grain(df.limit(0), ["a"]).first()) == (0, 0, True, True)


def test_many_columns(spark):
    cols = [f"c{i:02d}" for i in range(70)]
    rows = [tuple(int(i == k) for i in range(70)) for k in range(8)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in cols))
    want = {frozenset(s) for s in combinations(cols[:8], 1)}
    assert keys.minimal_keys(df, cols, 2) == [] and not any(keys.unique_sets(df, want).values())


def test_equal_columns_do_not_cancel_out(spark):
    df = spark.createDataFrame([(i, i, 0) for i in range(50)], "a int, b int, c int")
    assert keys.minimal_keys(df, max_size=3) == [frozenset("a"), frozenset("b")]
    assert keys.unique_sets(df, [["a", "b"]], known=[]) == {frozenset("ab"): True}


def test_keys_with_a_spread_column_are_counted_without_shuffling_them(spark, monkeypatch):
    """All sets with a column of many values in common share one shuffle, of the rows; the others go the old way."""
    rows = [(i, i % 50, None if i % 7 == 0 else i % 90, float(-0.0 if i % 2 else 0.0), i // 2) for i in range(3000)]
    df = spark.createDataFrame([*rows, (3000, 1, 1, 1.0, 7), (None, 5, 5, 5.0, 9000)], "id int, g int, h int, z double, half int")
    assert keys.spread_columns(df, df.columns) == ["half", "id"]
    sets = [{"id"}, {"id", "z"}, {"half", "z"}, {"half", "g"}, {"g", "h", "z"}, {"half"}, {"half", "g", "h"}]
    of = lambda s: df.groupBy(*s).count().filter("count > 1").limit(1).count() > 0
    want = {frozenset(s) for s in sets if of(sorted(s))}
    by_hash, seen = keys.refuted_by_hash, []
    monkeypatch.setattr(keys, "refuted_by_hash", lambda df, s, n: seen.extend(s) or by_hash(df, s, n))
    assert keys.refuted(df, map(frozenset, sets), df.count()) == want and frozenset({"half"}) in want
    assert seen == [frozenset({"g", "h", "z"})]
    assert keys.unique_sets(df, sets, known=[]) == {frozenset(s): frozenset(s) not in want for s in sets}
