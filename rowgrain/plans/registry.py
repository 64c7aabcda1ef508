"""Declared tables and joins, audited together.

The registry is a DataFrame with one row per table, the declared joins one with
one row per join.  The audit works out the grain of every join and who has rows
repeated, for all of them in one ``select``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowgrain.frame import GrainedFrame
from rowgrain.functions import grainsets as gs
from rowgrain.spec import GrainSpec, MissingColumns, columns

REGISTRY = "table_name string, kind string, columns array<string>, grain array<string>"
JOINS = "join_no int, left_table string, right_table string, jk array<string>"


def registry(spark: SparkSession, tables: Mapping[str, GrainedFrame | tuple[Sequence[str], GrainSpec]]) -> DataFrame:
    """One row per declared table."""
    rows = []
    for name, t in tables.items():
        cols, spec = (t.columns, t.spec) if isinstance(t, GrainedFrame) else t
        spec.check(cols)
        rows.append((name, spec.kind, sorted(cols), sorted(spec.grain)))
    return spark.createDataFrame(rows, REGISTRY)


def declared_joins(spark: SparkSession, joins: Iterable[tuple[str, str, Sequence[str]]]) -> DataFrame:
    rows = [(no, l, r, sorted(columns(jk))) for no, (l, r, jk) in enumerate(joins, 1)]
    return spark.createDataFrame(rows, JOINS)


def table_grain(reg: DataFrame, name: str) -> frozenset[str]:
    found = reg.filter(F.col("table_name") == name).select("grain").take(1)
    if not found:
        raise MissingColumns(f"table not registered: {name}")
    return frozenset(found[0].grain)


def audit_joins(reg: DataFrame, joins: DataFrame) -> DataFrame:
    """For each declared join: result grain, and whether either side has rows repeated.

    Equal grains are not enough to be safe: joined on a part of the grain, two
    tables of one grain repeat each other's rows.  The result grain tells.
    """
    side = lambda n, g, c: reg.select(F.col("table_name").alias(n), F.col("grain").alias(g), F.col("columns").alias(c))
    both = joins.join(side("left_table", "g1", "c1"), "left_table", "left").join(
        side("right_table", "g2", "c2"), "right_table", "left"
    )
    rel = gs.key_relation("g1", "g2", "jk")
    f1, f2 = gs.join_candidates("g1", "g2", "jk")
    found = both.select(
        "join_no", "left_table", "right_table", "jk", "g1", "g2",
        (gs.is_subset("jk", "c1") & gs.is_subset("jk", "c2")).alias("key_on_both"),
        rel.alias("relation"), gs.preferred(rel, f1, f2).alias("grain"),
    )
    # A side is repeated where the other one can hold several rows per join key.
    repeats = lambda other: ~gs.is_subset(other, "jk")
    shape = (
        F.when(gs.is_subset("g1", "jk") & gs.is_subset("g2", "jk"), "one_to_one")
        .when(gs.is_subset("g2", "jk"), "many_to_one")
        .when(gs.is_subset("g1", "jk"), "one_to_many")
        .otherwise("many_to_many")
    )
    return found.select(
        "join_no", "left_table", "right_table", "key_on_both", "relation", "grain", shape.alias("shape"),
        repeats("g2").alias("repeats_left"), repeats("g1").alias("repeats_right"),
    )


def audit_expected(reg: DataFrame, audited: DataFrame, expected: DataFrame) -> DataFrame:
    """Joins whose result grain is not the expected one; ``expected`` has ``join_no, target``."""
    return audited.join(expected, "join_no").filter(~gs.same_set("grain", "target"))


def audit_rollups(reg: DataFrame, rollups: DataFrame) -> DataFrame:
    """Group columns have to come from the table; ``rollups`` has ``table_name, target``."""
    return rollups.join(reg, "table_name").select(
        "table_name", "target",
        gs.is_subset("target", "columns").alias("columns_exist"),
        gs.compare("grain", "target").alias("grain_is"),
    )
