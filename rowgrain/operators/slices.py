"""Frequent keys in consecutive pieces of a fixed number of rows, whatever the order column and however many ties.

Rows of frequent keys are dealt out by ranges of key and order, so that a range may begin and end anywhere in a key,
also between rows that tie.  The rank of a row is its rank inside its range plus the rows of its key in the ranges
before, and those counts are few: only a key that is in several ranges has any.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowgrain.functions.columns import fresh
from rowgrain.operators.joins import match
from rowgrain.session import cut_lineage


def frequent(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame | None:
    """The keys with more than ``rows`` rows, or None without one.  Counting is a job, combined before its shuffle."""
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows).select(*keys)
    return None if found.isEmpty() else found


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    return not isinstance(kind, T.MapType)


def _tie(df: DataFrame) -> Column:
    """Parts rows that tie in the order; equal rows stay together."""
    return F.xxhash64(*[F.col(f.name) for f in df.schema.fields if _hashable(f.dataType)])


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Add the place of each row among those of its key, from 0, in ascending order with NULLs first.  Rows that nothing tells apart share a range."""
    tie, part, before, n = fresh([*df.columns, name], "_tie", "_range", "_before", "_n")
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn(tie, _tie(df)).repartitionByRange(tasks, *keys, *order, tie)
    # Bounds are sampled anew each time the ranges are made, so they are made once.
    placed = cut_lineage(dealt.withColumn(part, F.spark_partition_id()))
    counts = placed.groupBy(*keys, part).agg(F.count(F.lit(1)).alias(n))
    along = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    # A key has rows here only from its second range on, so there are fewer than ranges.
    offsets = counts.withColumn(before, F.sum(n).over(along)).filter(F.col(before).isNotNull()).select(*keys, part, before)
    local = F.row_number().over(Window.partitionBy(*keys, part).orderBy(*order, tie)) - 1
    return match(placed.withColumn(name, local.cast("long")), F.broadcast(offsets), [*keys, part], "left", null_safe=True).withColumn(
        name, F.col(name) + F.coalesce(F.col(before), F.lit(0))).select(*df.columns, name)


def pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int, name: str) -> DataFrame:
    """Add the number of the piece of ``rows`` consecutive rows of its key that a row is in; 0 for keys with fewer."""
    hot = frequent(df, keys, rows)
    if hot is None:
        return df.withColumn(name, F.lit(0).cast("long"))
    few = match(df, hot, keys, "left_anti", null_safe=True).withColumn(name, F.lit(0).cast("long"))
    (place,) = fresh([*df.columns, name], "_place")
    many = ranked(match(df, hot, keys, "left_semi", null_safe=True), keys, order, place)
    return few.unionByName(many.withColumn(name, F.floor(F.col(place) / rows).cast("long")).drop(place))
