"""Set operations on whole rows and on column sets, with the grain each one leaves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from rowgrain.frame import GrainedFrame
from rowgrain.spec import COARSER, EQUAL, FINER, GrainError, GrainMismatch, GrainSpec, columns


def _compatible(left: GrainedFrame, right: GrainedFrame) -> None:
    if set(left.columns) != set(right.columns):
        raise GrainError("the two sides have different columns")
    if left.grain != right.grain:
        raise GrainMismatch(f"{sorted(left.grain)} is not {sorted(right.grain)}")


def union_rows(left: GrainedFrame, right: GrainedFrame, rows_agree: bool = False) -> GrainedFrame:
    """Distinct rows of both.

    The common grain survives only if equal keys mean equal rows on both sides
    (``collections.conflicts`` is empty).  Without that promise the whole row
    is the grain.
    """
    _compatible(left, right)
    df = left.df.unionByName(right.df).distinct()
    if rows_agree:
        return GrainedFrame(df, left.spec)
    return GrainedFrame(df, GrainSpec(columns(left.columns), left.entity_key, measures=left.spec.measures))


def intersect_rows(left: GrainedFrame, right: GrainedFrame) -> GrainedFrame:
    _compatible(left, right)
    return GrainedFrame(left.df.intersect(right.df.select(*left.columns)), left.spec)


def subtract_rows(left: GrainedFrame, right: GrainedFrame) -> GrainedFrame:
    _compatible(left, right)
    return GrainedFrame(left.df.subtract(right.df.select(*left.columns)), left.spec)


def tagged_union(tag: str, **frames: GrainedFrame) -> GrainedFrame:
    """Rows of several types side by side; the tag says which type, absent columns are NULL."""
    parts = [f.df.withColumn(tag, F.lit(name)) for name, f in frames.items()]
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    grain = columns(tag).union(*[f.grain for f in frames.values()])
    return GrainedFrame(df, GrainSpec(grain))


def shared_columns(left: GrainedFrame, right: GrainedFrame) -> GrainedFrame:
    """Keys of both types cut down to the columns they share; the coarser grain remains."""
    order = left.compare(right)
    if order not in (EQUAL, FINER, COARSER):
        raise GrainMismatch("the grains cannot be ordered")
    coarse = left if order in (EQUAL, COARSER) else right
    other = right if coarse is left else left
    shared = [c for c in coarse.columns if c in other.columns]
    if not coarse.grain <= set(shared):
        raise GrainMismatch("the coarser grain is not among the shared columns")
    kept = coarse.select(*shared)
    return kept.semi_join(other, sorted(coarse.grain))


def all_columns(left: GrainedFrame, right: GrainedFrame) -> GrainedFrame:
    """Columns of both types, matched on what they share; the finer grain remains."""
    order = left.compare(right)
    if order not in (EQUAL, FINER, COARSER):
        raise GrainMismatch("the grains cannot be ordered")
    fine = left if order in (EQUAL, FINER) else right
    return left.natural_join(right).expect_grain(*fine.grain)
