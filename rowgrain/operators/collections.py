"""Tables as collections that hold one row per grain value.

``k`` is the list of grain columns; a NULL in one is a value like any other,
so two rows with NULL there have the same key.  Inputs hold each key once; where a batch
may not, the reduction to one row per key says by an explicit order which row
is kept.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rowgrain.functions.columns import fresh
from rowgrain.operators.joins import anti_join, match, semi_join
from rowgrain.operators.ordered import first_per_key


def empty(spark: SparkSession, schema: StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def singleton(spark: SparkSession, row: Mapping, schema: StructType) -> DataFrame:
    return spark.createDataFrame([tuple(row[f.name] for f in schema.fields)], schema)


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def lookup(df: DataFrame, k: Sequence[str], values: Mapping) -> DataFrame:
    """The row of one key, or nothing; the condition reaches the scan.

    More than one row comes back where ``k`` is not a key after all.
    """
    for c in k:
        df = df.filter(F.col(c).isNull() if values[c] is None else F.col(c) == F.lit(values[c]))
    return df


def lookup_many(df: DataFrame, k: Sequence[str], wanted: DataFrame) -> DataFrame:
    return semi_join(df, wanted, list(k), null_safe=True)


def contains(df: DataFrame, rows: DataFrame, k: Sequence[str], name: str = "is_member") -> DataFrame:
    """For each row: is exactly this row in the collection, not only its key?"""
    (whole,) = fresh([*df.columns, name], "_whole")
    cols = list(rows.columns)
    held = df.select(*k, F.struct(*cols).alias(whole))
    found = F.col(whole).isNotNull() & F.col(whole).eqNullSafe(F.struct(*cols))
    return match(rows, held, list(k), "left", null_safe=True).select(*cols, found.alias(name))


def dedup(df: DataFrame, k: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key by ``order``."""
    return first_per_key(df, list(k), order)


def insert(coll: DataFrame, new: DataFrame, k: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Add rows whose key is not there yet; a key already present keeps its row."""
    return coll.unionByName(anti_join(dedup(new, k, order), coll, list(k), right_unique=True, null_safe=True))


def delete(coll: DataFrame, gone: DataFrame, k: Sequence[str]) -> DataFrame:
    return anti_join(coll, gone, list(k), null_safe=True)


def upsert(coll: DataFrame, new: DataFrame, k: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Delete then insert: the new row replaces the old one."""
    return delete(coll, new, k).unionByName(dedup(new, k, order))


def union(left: DataFrame, right: DataFrame, k: Sequence[str]) -> DataFrame:
    """By key; where both have one, the row of the right side stays."""
    return right.unionByName(anti_join(left, right, list(k), right_unique=True, null_safe=True))


def intersection(left: DataFrame, right: DataFrame, k: Sequence[str]) -> DataFrame:
    """Rows of the left side whose key is on the right as well."""
    return semi_join(left, right, list(k), right_unique=True, null_safe=True)


def difference(left: DataFrame, right: DataFrame, k: Sequence[str]) -> DataFrame:
    return anti_join(left, right, list(k), right_unique=True, null_safe=True)


def conflicts(left: DataFrame, right: DataFrame, k: Sequence[str]) -> DataFrame:
    """Keys both sides have with different rows: ``k, left_row, right_row``."""
    rest = [c for c in left.columns if c not in k]
    l = left.select(*k, F.struct(*rest).alias("left_row"))
    r = right.select(*k, F.struct(*rest).alias("right_row"))
    return match(l, r, list(k), "inner", null_safe=True).filter(~F.col("left_row").eqNullSafe(F.col("right_row")))


def some_element(df: DataFrame, k: Sequence[str]) -> DataFrame:
    """One row, always the same one; Spark keeps one row per task."""
    return df.orderBy(*k).limit(1)


def filter_rows(df: DataFrame, predicate: Column) -> DataFrame:
    return df.filter(predicate)


# Comparing two collections ---------------------------------------------------
#
# Both sides are tagged, put together and counted by value.  That is a single
# shuffle in which each task combines equal values first, and it answers
# equality and containment in both directions at once.

def count_sides(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each distinct row with how often it occurs on either side."""
    (tag,) = fresh(left.columns, "_left")
    both = left.withColumn(tag, F.lit(True)).unionByName(right.withColumn(tag, F.lit(False)))
    return both.groupBy(*left.columns).agg(
        F.count_if(F.col(tag)).alias("n_left"), F.count_if(~F.col(tag)).alias("n_right")
    )


def compare_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row on whole rows with multiplicity: counts and ``equal / subset / proper_subset``."""
    counts = count_sides(left, right).agg(
        F.coalesce(F.sum("n_left"), F.lit(0)).cast("long").alias("n_left"),
        F.coalesce(F.sum("n_right"), F.lit(0)).cast("long").alias("n_right"),
        F.coalesce(F.sum(F.greatest(F.col("n_left") - F.col("n_right"), F.lit(0))), F.lit(0)).cast("long").alias("only_left"),
        F.coalesce(F.sum(F.greatest(F.col("n_right") - F.col("n_left"), F.lit(0))), F.lit(0)).cast("long").alias("only_right"),
    )
    return _verdicts(counts)


def compare_keys(left: DataFrame, right: DataFrame, left_key: Sequence[str], right_key: Sequence[str]) -> DataFrame:
    """One row on distinct keys, matched by position: one-to-one, specialization, or neither."""
    l = left.select(*left_key)
    r = right.select(*[F.col(b).alias(a) for a, b in zip(left_key, right_key)])
    counts = count_sides(l, r).agg(
        F.count_if(F.col("n_left") > 0).alias("n_left"),
        F.count_if(F.col("n_right") > 0).alias("n_right"),
        F.count_if((F.col("n_left") > 0) & (F.col("n_right") == 0)).alias("only_left"),
        F.count_if((F.col("n_right") > 0) & (F.col("n_left") == 0)).alias("only_right"),
    )
    return _verdicts(counts)


def _verdicts(counts: DataFrame) -> DataFrame:
    return counts.select(
        "*",
        ((F.col("only_left") == 0) & (F.col("only_right") == 0)).alias("equal"),
        (F.col("only_left") == 0).alias("subset"),
        ((F.col("only_left") == 0) & (F.col("only_right") > 0)).alias("proper_subset"),
    )


def same_count(left: DataFrame, right: DataFrame) -> DataFrame:
    tagged = left.select(F.lit(True).alias("l")).unionAll(right.select(F.lit(False).alias("l")))
    return tagged.agg(
        F.count_if("l").alias("n_left"), F.count_if(~F.col("l")).alias("n_right"),
        (F.count_if("l") == F.count_if(~F.col("l"))).alias("same_count"),
    )


def partition_check(whole: DataFrame, parts: Sequence[DataFrame], k: Sequence[str]) -> DataFrame:
    """Do the parts split the whole: every key in exactly one part, nothing more?

    One row: ``n_missing``, ``n_foreign``, ``n_overlapping``, ``is_partition``.
    """
    both = whole.select(*k, F.lit(-1).alias("_part"))
    for i, p in enumerate(parts):
        both = both.unionByName(p.select(*k, F.lit(i).alias("_part")))
    per_key = both.groupBy(*k).agg(
        F.count_if(F.col("_part") == -1).alias("_whole"), F.count_if(F.col("_part") >= 0).alias("_in")
    )
    return per_key.agg(
        F.count_if((F.col("_whole") > 0) & (F.col("_in") == 0)).alias("n_missing"),
        F.count_if((F.col("_whole") == 0) & (F.col("_in") > 0)).alias("n_foreign"),
        F.count_if(F.col("_in") > 1).alias("n_overlapping"),
    ).withColumn(
        "is_partition", (F.col("n_missing") == 0) & (F.col("n_foreign") == 0) & (F.col("n_overlapping") == 0)
    )
