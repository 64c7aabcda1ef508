"""Operators that need an order inside a key: latest row, first row, neighbours, as-of lookup.

One key may hold a large part of all rows.  "Best row per key" is an aggregate
or a row limit that Spark already applies before the shuffle, so a hot key costs
one row per task.  Neighbour lookups need the rows in order; there, hot keys are
cut into consecutive slices of a fixed number of rows, each slice is handled on its own, and only the
last value of every slice is carried over to the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowgrain.functions.columns import fresh
from rowgrain.operators import slices
from rowgrain.operators.joins import match

#: A key with more rows than this is cut into slices of about this size.
HOT_ROWS = 2_000_000


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` for each key, all columns from that same row.

    ``order`` should end in a tie breaker.  ``max_by`` keeps one row per key and
    task before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*df.columns)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """``DISTINCT ON``: the first row of each key in any mix of directions.

    Spark limits every task to one row per key before the shuffle, because the
    filter is on ``row_number``.
    """
    (rn,) = fresh(df.columns, "_rn")
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rn, F.row_number().over(window)).filter(F.col(rn) == 1).drop(rn)


def carry(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    *,
    inclusive: bool = False,
    backwards: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the nearest non-null ``value`` before (or after) each row of the same key.

    With ``inclusive`` the row's own value counts as well.  Rows of a key that
    tie in ``order`` come in any order, so end it in a tie breaker.
    """
    val, local, edge, part = fresh([*df.columns, name], "_val", "_local", "_edge", "_part")
    sort = [F.col(c).desc() if backwards else F.col(c).asc() for c in order]
    last_row = Window.currentRow if inclusive else -1

    def along(rows: DataFrame, *by: str) -> Column:
        return F.last(val, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*sort).rowsBetween(Window.unboundedPreceding, last_row))

    tagged = df.withColumn(val, value)
    hot = slices.frequent(df, keys, hot_rows)
    if hot is None:
        return tagged.withColumn(name, along(tagged, *keys)).drop(val)

    few = match(tagged, hot, keys, "left_anti", null_safe=True)
    placed = slices.ranked(match(tagged, hot, keys, "left_semi", null_safe=True), keys, order, part)
    placed = placed.withColumn(part, F.floor(F.col(part) / hot_rows).cast("long"))
    within = placed.withColumn(local, along(placed, *keys, part))

    # One row per slice of a frequent key: its last value, handed to the slices after it.
    pick = F.min_by if backwards else F.max_by
    across = Window.partitionBy(*keys).orderBy(F.col(part).desc() if backwards else F.col(part)).rowsBetween(Window.unboundedPreceding, -1)
    known = F.col(val).isNotNull()
    edges = (
        placed.groupBy(*keys, part)
        .agg(pick(F.when(known, F.struct(val)), F.when(known, F.struct(*order))).alias(edge))
        .withColumn(edge, F.last(edge, ignorenulls=True).over(across))
        .select(*keys, part, edge)
    )
    carried = match(within, edges, [*keys, part], "left", null_safe=True).withColumn(name, F.coalesce(F.col(local), F.col(edge)[val]))
    return few.withColumn(name, along(few, *keys)).select(*df.columns, name).unionByName(carried.select(*df.columns, name))


def slices_of_hot_keys(rows: DataFrame, keys: Sequence[str], pos: str, hot_rows: int) -> DataFrame:
    """Start and slice width of every key with more than ``hot_rows`` rows.

    There can be at most rows / ``hot_rows`` of them, so the result is small by construction.
    """
    return (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(pos).alias("_lo"), F.max(pos).alias("_hi"))
        .filter(F.col("_n") > F.lit(hot_rows))
        .select(*keys, "_lo", ((F.col("_hi") - F.col("_lo")) / F.ceil(F.col("_n") / F.lit(hot_rows))).alias("_width"))
    )


def in_slices(rows: DataFrame, hot: DataFrame, keys: Sequence[str], pos: str, name: str, how: str) -> DataFrame:
    """Add the slice number of each row; rows of other keys are all in slice 0."""
    number = F.when(F.col("_width") > 0, F.floor((F.col(pos) - F.col("_lo")) / F.col("_width"))).otherwise(F.lit(0))
    return (
        match(rows, F.broadcast(hot), keys, how, null_safe=True)
        .withColumn(name, F.coalesce(number, F.lit(0)).cast("long"))
        .drop("_lo", "_width")
    )


def previous_row(df, keys, order, cols, name="previous", **kw) -> DataFrame:
    """The row before, as a struct of ``cols``; NULL for the first row of a key."""
    return carry(df, keys, order, F.struct(*cols), name, **kw)


def next_row(df, keys, order, cols, name="following", **kw) -> DataFrame:
    """The row after, as a struct of ``cols``; NULL for the last row of a key."""
    return carry(df, keys, order, F.struct(*cols), name, backwards=True, **kw)


def as_of(
    lookups: DataFrame,
    versions: DataFrame,
    keys: Sequence[str],
    at: str,
    since: str,
    payload: Sequence[str],
    tie: Sequence[str] = (),
    **kw,
) -> DataFrame:
    """Give each lookup row the payload of the newest version with ``since <= at``.

    Both tables are laid on one time line per key and the version is carried
    forward, so no pair of lookup and version is ever formed.  Of versions with
    one start the greatest by ``tie`` counts, or by the payload without one.
    """
    cells = F.struct(F.col(since), *[F.col(c) for c in payload])
    rank = F.struct(*tie) if tie else cells
    right = versions.select(
        *keys, F.col(since).alias("_t"), F.lit(0).alias("_side"), rank.alias("_rank"), cells.alias("_version"),
        F.lit(None).cast(lookups.select(F.struct(*lookups.columns).alias("l")).schema["l"].dataType).alias("_lookup"),
    )
    none = lambda c: F.lit(None).cast(right.schema[c].dataType).alias(c)
    left = lookups.select(
        *keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), none("_rank"), none("_version"),
        F.struct(*lookups.columns).alias("_lookup"),
    )
    line = right.unionByName(left)
    found = carry(line, keys, ["_t", "_side", "_rank"], F.col("_version"), "_found", inclusive=True, **kw)
    return found.filter(F.col("_side") == 1).select(
        "_lookup.*", *[F.col("_found")[c].alias(c) for c in [since, *payload]]
    )
