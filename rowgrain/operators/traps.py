"""Joins that repeat or lose rows: found from the grains, measured on the data.

The measures never build the join.  Both sides are counted by key first, so a
key with very many rows is one row from then on.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowgrain.operators.joins import Pairs, key_pairs
from rowgrain.spec import columns


def fan_trap(g1: Iterable[str], g2: Iterable[str], jk: Iterable[str]) -> tuple[bool, bool]:
    """Which sides of an inner join may have rows repeated: (left, right).

    The result is strictly finer than a side exactly when the other side can
    hold several rows per join key, that is, when its grain is not inside the key.
    """
    g1, g2, jk = columns(g1), columns(g2), columns(jk)
    return not g2 <= jk, not g1 <= jk


def _counted(df: DataFrame, keys: Sequence[str], names: Sequence[str], n: str) -> DataFrame:
    return (
        df.select(*[F.col(k).alias(a) for k, a in zip(keys, names)])
        .groupBy(*names)
        .agg(F.count(F.lit(1)).alias(n))
    )


def join_size(left: DataFrame, right: DataFrame, on: str | Pairs) -> DataFrame:
    """One row: input rows, result rows and unmatched rows of an inner join, without joining rows."""
    pairs = key_pairs(on)
    names = [a for a, _ in pairs]
    l = _counted(left, names, names, "_l")
    r = _counted(right, [b for _, b in pairs], names, "_r")
    both = l.join(r, names, "full")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    wide = lambda c: n(c).cast("decimal(18,0)")
    return both.agg(
        F.coalesce(F.sum(n("_l")), F.lit(0)).cast("long").alias("n_left"),
        F.coalesce(F.sum(n("_r")), F.lit(0)).cast("long").alias("n_right"),
        F.coalesce(F.sum(wide("_l") * wide("_r")), F.lit(0)).cast("decimal(38,0)").alias("n_result"),
        F.coalesce(F.sum(F.when(F.col("_r").isNull(), n("_l"))), F.lit(0)).cast("long").alias("left_unmatched"),
        F.coalesce(F.sum(F.when(F.col("_l").isNull(), n("_r"))), F.lit(0)).cast("long").alias("right_unmatched"),
    )


def inflation(left: DataFrame, right: DataFrame, on: str | Pairs, measure: Column) -> DataFrame:
    """One row: the sum of a left-hand measure before the join and after it.

    The measure is added up by key and multiplied by the number of matches.
    """
    pairs = key_pairs(on)
    names = [a for a, _ in pairs]
    l = left.groupBy(*names).agg(F.sum(measure).alias("_m"))
    r = _counted(right, [b for _, b in pairs], names, "_r")
    return l.join(r, names, "left").agg(
        F.sum("_m").alias("total_before"),
        F.sum(F.col("_m") * F.coalesce(F.col("_r"), F.lit(0)).cast("decimal(12,0)")).alias("total_after"),
    )


def link_loss(left: DataFrame, right: DataFrame, on: str | Pairs, link: str) -> DataFrame:
    """One row for a link of a join chain: rows, NULL keys, keys found nowhere."""
    pairs = key_pairs(on)
    names = [a for a, _ in pairs]
    l = _counted(left, names, names, "_l")
    r = right.select(*[F.col(b).alias(a) for a, b in pairs]).distinct().withColumn("_hit", F.lit(True))
    has_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in names])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return l.join(r, names, "left").agg(
        F.lit(link).alias("link"),
        total("_l").alias("n_rows"),
        total(F.when(has_null, F.col("_l"))).alias("n_null_key"),
        total(F.when(~has_null & F.col("_hit").isNull(), F.col("_l"))).alias("n_unmatched"),
    )


def chain_loss(links: Sequence[tuple[str, DataFrame, DataFrame, str | Pairs]]) -> DataFrame:
    """Rows lost at every link of a chain of inner joins; all zero means the chain is safe."""
    parts = [link_loss(l, r, on, name) for name, l, r, on in links]
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("is_total", (F.col("n_null_key") == 0) & (F.col("n_unmatched") == 0))


def is_safe_chain(links) -> bool:
    return chain_loss(links).filter(~F.col("is_total")).limit(1).count() == 0
