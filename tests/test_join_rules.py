"""The join rules against brute force on small dense random tables."""

import random
from itertools import combinations

from rowgrain.frame import _join_fds
from rowgrain.spec import EQUAL, FD, GrainSpec, compare_grains, join_grain, outer_join_grain


def random_table(rng, cols, grain, size=7, values=3):
    rows, seen = [], set()
    for _ in range(size):
        r = {c: rng.randrange(values) for c in cols}
        k = tuple(r[c] for c in sorted(grain))
        if k not in seen:
            seen.add(k)
            rows.append(r)
    return rows


def join(left, right, jk, how, lcols, rcols):
    out, used = [], set()
    for l in left:
        hit = False
        for i, r in enumerate(right):
            if all(l[c] == r[c] for c in jk):
                hit = True
                used.add(i)
                out.append({**l, **r})
        if not hit and how in ("left", "full"):
            out.append({**{c: None for c in rcols}, **l})
    if how in ("right", "full"):
        out += [{**{c: None for c in lcols}, **r} for i, r in enumerate(right) if i not in used]
    return out


def unique(rows, cols):
    keys = [tuple(r[c] for c in sorted(cols)) for r in rows]
    return len(set(keys)) == len(keys)


def trials(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        jk = ["j0", "j1"][: rng.randint(1, 2)]
        lcols, rcols = ["a0", "a1"] + jk, jk + ["b0", "b1"]
        g1 = frozenset(rng.sample(lcols, rng.randint(1, len(lcols))))
        g2 = frozenset(rng.sample(rcols, rng.randint(1, len(rcols))))
        yield rng, jk, lcols, rcols, g1, g2


def test_inner_join_keys_are_unique():
    for rng, jk, lcols, rcols, g1, g2 in trials(1500, 1):
        rows = join(random_table(rng, lcols, g1), random_table(rng, rcols, g2), jk, "inner", lcols, rcols)
        got = join_grain(g1, g2, jk)
        assert unique(rows, got.f1) and unique(rows, got.f2)


def test_inner_join_grain_is_minimal_over_all_tables():
    """Each column of the grain is needed by some pair of tables of the same shape."""
    rng = random.Random(2)
    jk = ["j0", "j1"]
    lcols, rcols = ["a0", "a1"] + jk, jk + ["b0", "b1"]
    shapes = [
        (frozenset(g1), frozenset(g2))
        for g1 in combinations(lcols, 2) for g2 in combinations(rcols, 2)
    ]
    for g1, g2 in shapes:
        got = join_grain(g1, g2, jk)
        needed = set()
        for _ in range(400):
            rows = join(random_table(rng, lcols, g1, 12, 2), random_table(rng, rcols, g2, 12, 2), jk, "inner", lcols, rcols)
            needed |= {c for c in got.grain if not unique(rows, got.grain - {c})}
            if needed == got.grain:
                break
        assert needed == got.grain, (g1, g2, got)


def test_outer_join_keys_are_unique():
    for how in ("left", "right", "full"):
        for rng, jk, lcols, rcols, g1, g2 in trials(1200, 3):
            rows = join(random_table(rng, lcols, g1), random_table(rng, rcols, g2), jk, how, lcols, rcols)
            assert unique(rows, outer_join_grain(g1, g2, jk, how)), (how, g1, g2, jk)


def test_inner_rule_would_be_wrong_for_outer_joins():
    broken = 0
    for rng, jk, lcols, rcols, g1, g2 in trials(600, 4):
        rows = join(random_table(rng, lcols, g1), random_table(rng, rcols, g2), jk, "full", lcols, rcols)
        broken += not unique(rows, join_grain(g1, g2, jk).f1)
    assert broken > 0


def holds(rows, fd):
    seen = {}
    for r in rows:
        lhs, rhs = tuple(r[c] for c in sorted(fd.lhs)), tuple(r[c] for c in sorted(fd.rhs))
        if seen.setdefault(lhs, rhs) != rhs:
            return False
    return True


def test_dependencies_claimed_after_a_join_hold():
    for how in ("inner", "left", "right", "full"):
        for rng, jk, lcols, rcols, g1, g2 in trials(500, 5):
            rows = join(random_table(rng, lcols, g1), random_table(rng, rcols, g2), jk, how, lcols, rcols)
            claimed = _join_fds(
                (GrainSpec(g1), lcols, how in ("right", "full")), (GrainSpec(g2), rcols, how in ("left", "full")), frozenset(jk)
            )
            assert claimed and all(holds(rows, fd) for fd in claimed), (how, g1, g2, jk)


def test_measures_called_safe_are_not_repeated():
    """Where home grain and frame grain count as equal, each home row is there at most once."""
    checked = 0
    for how in ("inner", "left", "right", "full"):
        for rng, jk, lcols, rcols, g1, g2 in trials(500, 6):
            left, right = random_table(rng, lcols, g1), random_table(rng, rcols, g2)
            rows = join(left, right, jk, how, lcols, rcols)
            fds = _join_fds(
                (GrainSpec(g1), lcols, how in ("right", "full")), (GrainSpec(g2), rcols, how in ("left", "full")), frozenset(jk)
            )
            grain = join_grain(g1, g2, jk).grain if how == "inner" else outer_join_grain(g1, g2, jk, how)
            fds += (FD(grain, frozenset(lcols + rcols)),)
            if compare_grains(g1, grain, fds) == EQUAL:
                real = [r for r in rows if any({c: r[c] for c in lcols} == l for l in left)]
                assert unique(real, g1), (how, g1, g2, jk)
                checked += 1
    assert checked > 50
