"""Tables made from row numbers, so that every run and every engine gets the same rows."""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowgrain.functions.columns import digit, hashed, whole_division


def series(spark: SparkSession, first: int, last: int, name: str = "i") -> DataFrame:
    """The numbers from ``first`` to ``last``, both included."""
    return spark.range(first, last + 1).withColumnRenamed("id", name)


def counter(number: Column, bases: Sequence[int | None]) -> list[Column]:
    """Mixed-radix digits: distinct up to the product of the bases, then they repeat.

    A first base of None has no limit, so that all numbers stay distinct.
    """
    return [
        (whole_division(number, prod(bases[1:])) + F.lit(1)).cast("long") if b is None else digit(number, prod(bases[i + 1:]), b)
        for i, b in enumerate(bases)
    ]


def keyed_rows(df: DataFrame, number: str, names: Sequence[str], bases: Sequence[int | None], **derived: Column) -> DataFrame:
    """Rows whose key columns count through ``bases``; a key that comes up again keeps its first row."""
    cols = [c.alias(n) for n, c in zip(names, counter(F.col(number), bases))]
    firsts = df.select(number, *cols).groupBy(*names).agg(F.min(number).alias(number))
    return firsts.select(*names, *[c.alias(n) for n, c in derived.items()])


def dense_partner(
    left: DataFrame, jk: Sequence[str], grain: Sequence[str], extra: dict[str, int], **derived: Column
) -> DataFrame:
    """A right-hand table that meets every left row: its join key, times a series per extra key column.

    The left keys are reduced to one per right-hand key part first, so the
    series multiply as few rows as possible.
    """
    inside = [c for c in grain if c in jk]
    rest = [c for c in jk if c not in inside]
    if inside and rest:
        base = left.groupBy(*inside).agg(F.min(F.struct(*rest)).alias("_r")).select(*inside, "_r.*")
    else:
        base = left.select(*jk).distinct()
    for c, n in extra.items():
        base = base.withColumn(c, F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))))
    return base.withColumns(derived) if derived else base


def shuffled(df: DataFrame, key_cols: Sequence[str], seed: int) -> DataFrame:
    """A repeatable random order."""
    return df.orderBy(F.xxhash64(*key_cols, F.lit(seed)), *key_cols)


def key_index(row: Column, pool: Column | int, skew: int = 0) -> Column:
    """Which of ``pool`` join-key values a row takes, counted from 0.

    Rows go round the values.  Each degree of ``skew`` squares the place in the
    pool, in whole numbers, so that low values get more rows: of ``pool``
    values about the square root get half of them at degree one.
    """
    n = F.lit(pool).cast("long") if isinstance(pool, int) else pool
    at = F.pmod(row.cast("long"), n)
    for _ in range(skew):
        at = whole_division(at * (at + 1), n)
    return at


def key_value(index: Column, column_no: int) -> Column:
    """The value of a join-key column: each tells the index apart, and columns of one row differ."""
    return index.bitwiseXOR(F.lit(column_no + 1).cast("long"))


def generate_table(
    spark: SparkSession, tag: str, fields: Sequence[str], jk: Sequence[str], grain: Sequence[str],
    n_rows: int = 20, rows_per_key: float = 2.0, skew: int = 0, seed: int = 42,
) -> DataFrame:
    """A table of ``n_rows`` rows with ``grain`` as key and every other column depending on it.

    ``rows_per_key`` rows share a join-key value on average, if the grain has
    columns outside the key to tell them apart; those count in base 3, the
    last one without limit.
    """
    if n_rows < 1 or rows_per_key < 1 or skew < 0:
        raise ValueError("n_rows and rows_per_key must be at least 1, skew at least 0")
    rest = [c for c in grain if c not in jk]
    row = F.col("id")
    index = key_index(row, max(1, int(n_rows / rows_per_key)), skew) if rest else row
    cols = {c: key_value(index + F.lit(seed % 1000), no) for no, c in enumerate(sorted(jk))}
    for no, c in enumerate(rest):
        step = whole_division(row, 3**no)
        cols[c] = (step if no == len(rest) - 1 else step % 3).cast("long")
    for c in fields:
        if c not in cols:
            cols[c] = hashed([F.lit(tag), F.lit(c), F.lit(seed), *[cols[g] for g in grain]], 1000).cast("long")
    return spark.range(n_rows).select(*[cols[c].alias(c) for c in fields])
