"""Aggregates that know whether repeated rows change them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowgrain.functions.columns import fresh, key, money
from rowgrain.operators import slices

#: A key with more rows than this is handled in pieces of about this size.
PIECE_ROWS = 500_000

#: Aggregates whose value does not change when a row is repeated.
REPEAT_SAFE = frozenset({"min", "max", "count_distinct"})


@dataclass(frozen=True)
class Agg:
    """One aggregate of one column; ``rows`` has none and counts rows of the frame itself."""

    kind: str
    column: str | None = None
    decimal: bool = False

    def expression(self) -> Column:
        if self.kind == "rows":
            return F.count(F.lit(1))
        col = money(self.column) if self.decimal else F.col(self.column)
        return {
            "sum": F.sum, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max,
            "count_distinct": F.count_distinct,
        }[self.kind](col)

    @property
    def repeat_safe(self) -> bool:
        return self.kind == "rows" or self.kind in REPEAT_SAFE


def total(column: str, decimal: bool = False) -> Agg:
    return Agg("sum", column, decimal)


def mean(column: str, decimal: bool = False) -> Agg:
    return Agg("avg", column, decimal)


def filled(column: str) -> Agg:
    return Agg("count", column)


def rows() -> Agg:
    return Agg("rows")


def least(column: str) -> Agg:
    return Agg("min", column)


def greatest(column: str) -> Agg:
    return Agg("max", column)


def different(column: str) -> Agg:
    return Agg("count_distinct", column)


#: Aggregates of a join by its key that follow exactly from those of its sides.
JOINABLE = REPEAT_SAFE | {"rows"}


def over_join(left: DataFrame, right: DataFrame, keys: Sequence[str], aggs: Mapping[str, Agg]) -> DataFrame:
    """Aggregates of the inner join of ``left`` and ``right`` on ``keys``, grouped by ``keys``, without its pairs.

    Each side is grouped by the key first.  A key has as many pairs as the product of its rows on both sides, and every
    row of one side meets all of the other, so its values are those of its side.
    """
    l_n, r_n = fresh([*left.columns, *right.columns, *aggs], "_left_rows", "_right_rows")
    # A key column or a column outside the key is taken from the side that has it; both have the key.
    mine = {n: (left if a.column is None or a.column in left.columns else right) for n, a in aggs.items()}
    of = lambda side: [a.expression().alias(n) for n, a in aggs.items() if a.kind != "rows" and mine[n] is side]
    l = left.groupBy(*keys).agg(F.count(F.lit(1)).alias(l_n), *of(left))
    r = right.groupBy(*keys).agg(F.count(F.lit(1)).alias(r_n), *of(right))

    def result(name: str, a: Agg) -> Column:
        return (F.col(l_n) * F.col(r_n)).alias(name) if a.kind == "rows" else F.col(name)

    return l.join(r, list(keys)).select(*keys, *[result(n, a) for n, a in aggs.items()])


def distinct_count(df: DataFrame, cols: Sequence[str], name: str = "n") -> DataFrame:
    """Distinct tuples, where a NULL inside a tuple is a value like any other."""
    return df.agg(F.count_distinct(key(cols)).alias(name))


def collect_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """A collection of collections: the rows of each key as arrays of bounded length.

    A key with more than ``piece_rows`` rows becomes several consecutive pieces of that many, so no task holds more in
    one array, and the pieces of a key one after the other are its rows in order, whatever their size.  The result has
    the grain (keys, piece); rows inside a piece are sorted by ``order``.
    """
    rest = [*order, *[c for c in df.columns if c not in keys and c not in order]]
    return slices.pieces(df, keys, order, piece_rows, "piece").groupBy(*keys, "piece").agg(
        F.sort_array(F.collect_list(F.struct(*rest))).alias("members")
    )


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    start: Column,
    step: Callable[[Column, Column], Column],
    merge: Callable[[Column, Column], Column],
    name: str = "folded",
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Fold the values of each key in order.

    Keys with more than ``piece_rows`` rows are folded piece by piece, and ``merge`` joins the results of neighbouring
    pieces.  So ``start`` has to be neutral for ``merge``, and ``merge(f(xs), f(ys))`` has to equal ``f(xs + ys)``.
    """
    part, val, n = fresh([*df.columns, name], "_part", "_val", "_run")
    rows_in = df.select(*keys, *order, value.alias(val))
    in_order = F.sort_array(F.collect_list(F.struct(*order, F.col(val).alias(val))))
    cut = slices.pieces(rows_in, keys, order, piece_rows, part)
    folded = cut.groupBy(*keys, part).agg(F.aggregate(in_order, start, lambda acc, r: step(acc, r[val])).alias(name))
    # Neighbouring slices are merged in runs first, so no array gets long.
    runs = _merge_in_order(folded.withColumn(n, F.floor(F.col(part) / F.lit(RUN))), [*keys, n], part, name, start, merge)
    return _merge_in_order(runs, list(keys), n, name, start, merge)


#: How many neighbouring slices are merged at a time.
RUN = 1000


def _merge_in_order(df, keys, no, name, start, merge) -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct(no, name)))
    return df.groupBy(*keys).agg(F.aggregate(parts, start, lambda acc, r: merge(acc, r[name])).alias(name))


def distribution(df: DataFrame, by: Sequence[str], **conditions: Column) -> DataFrame:
    """Rows per class, with one conditional count per named condition."""
    counts = [F.count_if(c).alias(n) for n, c in conditions.items()]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *counts)
