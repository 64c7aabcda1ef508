"""Column-set algebra over tables of grains.

A grain is an ``array<string>`` column here, so thousands of grains or join
configurations are worked out in one ``select`` on the executors.  All results
are sorted and free of duplicates.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_set(a: Column | str) -> Column:
    return F.sort_array(F.array_distinct(_col(a)))


def union(a: Column | str, b: Column | str) -> Column:
    return F.sort_array(F.array_union(_col(a), _col(b)))


def intersection(a: Column | str, b: Column | str) -> Column:
    return F.sort_array(F.array_intersect(_col(a), _col(b)))


def difference(a: Column | str, b: Column | str) -> Column:
    return F.sort_array(F.array_except(_col(a), _col(b)))


def symmetric_difference(a: Column | str, b: Column | str) -> Column:
    return union(difference(a, b), difference(b, a))


def disjoint(a: Column | str, b: Column | str) -> Column:
    return F.size(F.array_intersect(_col(a), _col(b))) == 0


def is_subset(a: Column | str, b: Column | str) -> Column:
    return F.size(F.array_except(_col(a), _col(b))) == 0


def same_set(a: Column | str, b: Column | str) -> Column:
    return is_subset(a, b) & is_subset(b, a)


def compare(a: Column | str, b: Column | str) -> Column:
    """``finer`` means that ``a`` holds all columns of ``b`` and more."""
    a_in_b, b_in_a = is_subset(a, b), is_subset(b, a)
    return (
        F.when(a_in_b & b_in_a, "equal")
        .when(b_in_a, "finer")
        .when(a_in_b, "coarser")
        .otherwise("incomparable")
    )


def key_relation(g1: Column | str, g2: Column | str, jk: Column | str) -> Column:
    """How two grains compare inside the join key."""
    p1, p2 = intersection(g1, jk), intersection(g2, jk)
    return (
        F.when(same_set(p1, p2), "equal")
        .when(is_subset(p1, p2), "proper_subset")
        .when(is_subset(p2, p1), "proper_superset")
        .otherwise("incomparable")
    )


def join_candidates(g1: Column | str, g2: Column | str, jk: Column | str) -> tuple[Column, Column]:
    """Both candidate keys of an inner equi-join."""
    return union(g1, difference(g2, jk)), union(g2, difference(g1, jk))


def preferred(relation: Column, f1: Column, f2: Column) -> Column:
    """The smaller candidate: second one on a proper superset, shorter one when incomparable."""
    take_second = (relation == "proper_superset") | (
        (relation == "incomparable") & (F.size(f2) < F.size(f1))
    )
    return F.when(take_second, f2).otherwise(f1)


def superseded_join_grain(g1: Column | str, g2: Column | str, jk: Column | str) -> Column:
    """The older two-case formula, kept only to be compared with the present one.

    When the key parts are comparable it takes what they share, otherwise
    everything of both; the second case carries removable columns.
    """
    p1, p2 = intersection(g1, jk), intersection(g2, jk)
    outside = union(difference(g1, jk), difference(g2, jk))
    comparable = is_subset(p1, p2) | is_subset(p2, p1)
    return F.when(comparable, union(outside, intersection(p1, p2))).otherwise(
        union(outside, union(p1, p2))
    )


def without_each(grain: Column | str) -> Column:
    """Every set that lacks exactly one column: ``array<struct<dropped, rest>>``."""
    g = _col(grain)
    return F.transform(
        g, lambda c: F.struct(c.alias("dropped"), F.array_except(g, F.array(c)).alias("rest"))
    )
