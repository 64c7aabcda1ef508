"""Rules on column sets alone: ordering, dependencies, grain of a join."""

from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rowgrain import spec as sp
from rowgrain.spec import FD, closure, compare_grains, determines, join_grain

COLS = "abcdef"
sets = st.frozensets(st.sampled_from(COLS), max_size=4)
fd_lists = st.lists(st.tuples(sets, sets).map(lambda t: FD(*t)), max_size=5)


def fs(text):
    return frozenset(text.split())


def test_compare_by_columns():
    assert compare_grains("a", "a") == sp.EQUAL
    assert compare_grains(["a", "b"], ["a"]) == sp.FINER
    assert compare_grains(["a"], ["a", "b"]) == sp.COARSER
    assert compare_grains(["a"], ["b"]) == sp.INCOMPARABLE


def test_compare_through_a_dependency():
    by_department = [FD.of("employee", "department")]
    assert compare_grains("employee", "department", by_department) == sp.FINER
    assert compare_grains("department", "employee", by_department) == sp.COARSER


def test_meet_and_common_grain():
    assert sp.meet(["a", "b"], ["b", "c"]) == fs("a b c")
    assert sp.common_grain(["a", "b"], ["b", "c"]) == fs("b")


@settings(max_examples=150, deadline=None)
@given(fd_lists, sets, sets, sets, sets)
def test_dependency_axioms(fds, x, y, z, w):
    d = lambda a, b: determines(a, b, fds)
    assert d(x | y, y)  # reflexivity
    if d(x, y):
        assert d(x | z, y | z)  # augmentation
        assert d(x | z, y)  # a larger left side still determines
        if d(y, z):
            assert d(x, z)  # transitivity
        if d(x, z):
            assert d(x, y | z)  # union
        if d(y | w, z):
            assert d(x | w, z)  # pseudo-transitivity
        if d(z, w):
            assert d(x | z, y | w)  # composition
    if d(x, y | z):
        assert d(x, y) and d(x, z)  # decomposition
    assert closure(closure(x, fds), fds) == closure(x, fds)  # closing twice changes nothing


@settings(max_examples=100, deadline=None)
@given(fd_lists, sets, sets)
def test_closure_is_the_least_fixed_set(fds, x, y):
    c = closure(x, fds)
    assert x <= c
    closed_supersets = [
        frozenset(s) for n in range(len(COLS) + 1) for s in combinations(COLS, n)
        if x <= frozenset(s) and all(not fd.lhs <= frozenset(s) or fd.rhs <= frozenset(s) for fd in fds)
    ]
    assert c == frozenset.intersection(*closed_supersets)


# (name, G1, G2, join key, expected grain, expected alternative); keys with
# suffixes stand for columns that both tables have outside the join key.
JOINS = [
    ("accounts and addresses", "account_id", "customer_id address_id", "customer_id", "account_id address_id", None),
    ("three key columns", "a c", "a b", "a b c", "a c", "a b"),
    ("one key column", "a b", "c_r2 d", "b", "a c_r2 d", None),
    ("equal, whole key", "customer_id", "customer_id", "customer_id", "customer_id", None),
    ("equal, part of key", "customer_id region", "customer_id segment", "customer_id", "region segment customer_id", None),
    ("orders by product", "customer_id region", "order_id order_date", "customer_id product_id", "region order_id order_date", None),
    ("by e-mail", "customer_id_r1", "customer_id_r2", "email", "customer_id_r1 customer_id_r2", None),
    ("line and order", "order_id line", "order_id", "order_id", "order_id line", None),
    ("three and two", "order_id line_r1 product", "order_id line_r2", "order_id", "line_r1 product line_r2 order_id", None),
    ("line and dated order", "order_id line", "order_id order_date", "order_id customer_id", "line order_date order_id", None),
    ("on a plain column", "order_r1 line", "order_r2", "customer_id", "order_r1 line order_r2", None),
    ("channel and product", "customer channel date", "customer product date", "customer date", "channel product customer date", None),
    ("sales and catalogue", "sales product store", "product store category", "product store", "sales product store category", None),
    ("natural, same key", "customer region", "customer region", "customer region", "customer region", None),
    ("natural, crossing keys", "a b", "c d", "b c", "a b d", "a c d"),
]


@pytest.mark.parametrize("name,g1,g2,jk,grain,other", JOINS, ids=[j[0] for j in JOINS])
def test_join_grain_examples(name, g1, g2, jk, grain, other):
    got = join_grain(fs(g1), fs(g2), fs(jk))
    assert got.grain == fs(grain)
    assert got.alternative == (None if other is None else fs(other))


@settings(max_examples=200, deadline=None)
@given(sets, sets, sets)
def test_join_grain_laws(g1, g2, jk):
    got = join_grain(g1, g2, jk)
    assert len(got.f1) - len(got.f2) == len(g1 & jk) - len(g2 & jk)
    assert len(got.grain) <= min(len(got.f1), len(got.f2))
    if got.relation == "equal":
        assert got.f1 == got.f2
    swapped = join_grain(g2, g1, jk)
    assert {swapped.f1, swapped.f2} == {got.f1, got.f2}
    assert len(swapped.grain) == len(got.grain)


def test_dropped_home_columns_never_match_again():
    spec = sp.GrainSpec(fs("a"), measures={"m": fs("b")}).restricted(["a", "m"])
    assert spec.measures["m"] == fs("dropped:b")


def test_entity_key_has_to_be_in_the_grain():
    with pytest.raises(sp.GrainError):
        sp.GrainSpec(fs("a"), entity_key=fs("b")).check(["a", "b"])
    with pytest.raises(sp.MissingColumns):
        sp.GrainSpec(fs("a x")).check(["a", "b"])


def test_minimal_sets():
    assert sp.minimal_sets([fs("a b"), fs("a"), fs("c")]) == (fs("a"), fs("c"))
