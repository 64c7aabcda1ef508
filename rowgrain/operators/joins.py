"""Joins on plain DataFrames: name handling, and products that stay balanced."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowgrain.functions.columns import fresh, position
from rowgrain.spec import GrainError

LEFT_SUFFIX, RIGHT_SUFFIX = "_r1", "_r2"

Pairs = Sequence[str | tuple[str, str]]


@dataclass(frozen=True)
class JoinNames:
    """How both sides are renamed so that the result has no name twice."""

    keys: tuple[str, ...]
    left: Mapping[str, str]
    right: Mapping[str, str]


def key_pairs(on: str | Pairs) -> list[tuple[str, str]]:
    on = [on] if isinstance(on, str) else list(on)
    if not on:
        raise GrainError("an equi-join needs at least one key column; use product() for none")
    return [(k, k) if isinstance(k, str) else (k[0], k[1]) for k in on]


def plan_names(left_cols: Sequence[str], right_cols: Sequence[str], on: str | Pairs) -> JoinNames:
    """Suffix shared columns outside the key; the right key takes the left key's name."""
    pairs = key_pairs(on)
    lkeys, rkeys = [a for a, _ in pairs], [b for _, b in pairs]
    missing = sorted((set(lkeys) - set(left_cols)) | (set(rkeys) - set(right_cols)))
    if missing:
        raise GrainError(f"join key not on both sides: {', '.join(missing)}")
    lrest = [c for c in left_cols if c not in lkeys]
    rrest = [c for c in right_cols if c not in rkeys]
    clash = set(lrest) & set(rrest)
    left = {c: c + LEFT_SUFFIX for c in lrest if c in clash}
    right = {c: c + RIGHT_SUFFIX for c in rrest if c in clash or c in lkeys}
    right.update({b: a for a, b in pairs if a != b})
    return JoinNames(tuple(lkeys), left, right)


def equi_join(
    left: DataFrame, right: DataFrame, on: str | Pairs, how: str = "inner", own_shuffle: bool = False
) -> DataFrame:
    """Join without a strategy hint: Spark picks it from sizes, and re-plans skewed keys.

    Spark splits a frequent key only where both inputs of the join come straight
    from a shuffle.  A side that was just grouped by the join key does not; with
    ``own_shuffle`` the key gets a companion, so that both sides are shuffled
    for the join.
    """
    names = plan_names(left.columns, right.columns, on)
    l, r = left.withColumnsRenamed(dict(names.left)), right.withColumnsRenamed(dict(names.right))
    keys = list(names.keys)
    if not own_shuffle:
        return l.join(r, on=keys, how=how)
    l, r = _with_companion(l, keys), _with_companion(r, keys)
    return l.join(r, on=[*keys, COMPANION], how=how).drop(COMPANION)


COMPANION = "_key_hash"


def _with_companion(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumn(COMPANION, F.xxhash64(*keys))


def outer_join_by_parts(left: DataFrame, right: DataFrame, on: str | Pairs, how: str) -> DataFrame:
    """An outer join as matches plus unmatched rows.

    Spark can split a frequent key on either side of an inner join, but not on
    the side an outer join has to keep whole.  The unmatched rows come from
    anti-joins against distinct keys, where a frequent key is one row.
    """
    pairs = key_pairs(on)
    names = plan_names(left.columns, right.columns, pairs)
    out = equi_join(left, right, pairs)
    if how in ("left", "full"):
        alone = anti_join(left, right, pairs).withColumnsRenamed(dict(names.left))
        out = out.unionByName(alone, allowMissingColumns=True)
    if how in ("right", "full"):
        alone = anti_join(right, left, [(b, a) for a, b in pairs]).withColumnsRenamed(dict(names.right))
        out = out.unionByName(alone, allowMissingColumns=True)
    return out


def natural_keys(left: DataFrame, right: DataFrame) -> list[str]:
    shared = sorted(set(left.columns) & set(right.columns))
    if not shared:
        raise GrainError("no column in common, so there is no natural join")
    return shared


def disjoint_names(left: DataFrame, right: DataFrame) -> tuple[Mapping[str, str], Mapping[str, str]]:
    clash = set(left.columns) & set(right.columns)
    return {c: c + LEFT_SUFFIX for c in clash}, {c: c + RIGHT_SUFFIX for c in clash}


def default_grid(df: DataFrame) -> tuple[int, int]:
    """For a small right side: left rows are spread and not copied, right rows go to every cell."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1


def balanced_grid(left: DataFrame, right: DataFrame, cells: int | None = None) -> tuple[int, int]:
    """The grid that copies the fewest rows.  Counts both sides, so it runs two jobs.

    A left row is copied once per grid column, a right row once per grid row.
    """
    cells = cells or default_grid(left)[0]
    n_left, n_right = max(1, left.count()), max(1, right.count())
    cols = min(cells, max(1, round(sqrt(cells * n_right / n_left))))
    return max(1, cells // cols), cols


def product(left: DataFrame, right: DataFrame, grid: tuple[int, int] | None = None) -> DataFrame:
    """Every pair of rows, spread over a grid of cells.

    A left row belongs to one grid row and is copied to each of its cells, a
    right row to one grid column; each pair meets in exactly one cell.  So the
    work is an ordinary equi-join whose tasks are of equal size, with neither
    side sent whole to a task.  Rows are placed by a hash of all their columns,
    which spreads well because rows of a table with a grain differ.  Pass
    ``balanced_grid`` where the right side is large as well.
    """
    rows, cols = grid or default_grid(left)
    lnames, rnames = disjoint_names(left, right)
    l, r = left.withColumnsRenamed(dict(lnames)), right.withColumnsRenamed(dict(rnames))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    spread = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("int")
    l = l.withColumn("_cell_row", spread(l, rows)).withColumn("_cell_col", every(cols))
    r = r.withColumn("_cell_col", spread(r, cols)).withColumn("_cell_row", every(rows))
    return l.join(r, ["_cell_row", "_cell_col"]).drop("_cell_row", "_cell_col")


def theta_join(
    left: DataFrame,
    right: DataFrame,
    condition: Column,
    equal: str | Pairs = (),
    grid: tuple[int, int] | None = None,
) -> DataFrame:
    """Join on any condition over the suffixed names; equality parts go in ``equal``."""
    if equal:
        return equi_join(left, right, equal).filter(condition)
    return product(left, right, grid).filter(condition)


#: Bits between two widths of band: an interval is listed under 2 + 2 ** LEVEL_BITS bands at most.
LEVEL_BITS = 4
_LARGEST = 1.7976931348623157e308
_INSIDE = {
    "both": lambda x, a, b: ((x >= a), (x <= b)), "neither": lambda x, a, b: ((x > a), (x < b)),
    "low": lambda x, a, b: ((x >= a), (x < b)), "high": lambda x, a, b: ((x > a), (x <= b)),
}


def range_join(
    points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, closed: str = "both",
    equal: str | Pairs = (), open_ends: bool = False,
) -> DataFrame:
    """Every point with every interval it lies in, found by an index of bands instead of all pairs.

    Bands come in widths that differ by a factor of 16.  An interval picks the narrowest width of which some 16 bands
    cover it and is listed under those; a point is in one band of each width that any interval picked.  So a pair meets
    once, and the rows compared are at most about three times the result wherever points lie evenly inside an interval.
    Where many points and intervals share a band, so do they in the result; Spark splits such a band between tasks.

    ``closed``: ``both``, ``neither``, ``low`` or ``high`` end belongs to the interval.  ``equal``: columns that have to
    be equal as well.  NULL and NaN are in no interval; a NULL end matches nothing, or with ``open_ends`` has no limit.
    Columns are named as by ``equi_join``.  Two small jobs look at the span of the points and the widths in use.
    """
    if closed not in _INSIDE:
        raise GrainError(f"closed is one of {', '.join(_INSIDE)}")
    pairs = key_pairs(equal) if equal else []
    if pairs:
        names = plan_names(points.columns, intervals.columns, pairs)
        lnames, rnames = dict(names.left), dict(names.right)
    else:
        lnames, rnames = map(dict, disjoint_names(points, intervals))
    l, r = points.withColumnsRenamed(lnames), intervals.withColumnsRenamed(rnames)
    keys = [a for a, _ in pairs]
    columns = [*l.columns, *[c for c in r.columns if c not in keys]]
    at, low, high = lnames.get(at, at), rnames.get(low, low), rnames.get(high, high)
    where, start, end = position(l, at), position(r, low), position(r, high)
    if where is None or start is None or end is None:
        raise GrainError("a range join needs numbers, dates or times")
    pos, lo, hi, level, band = fresh(columns, "_pos", "_lo", "_hi", "_level", "_band")
    within = lambda c: F.least(F.greatest(c, F.lit(-_LARGEST)), F.lit(_LARGEST))
    l = l.withColumn(pos, where).filter(F.col(pos).isNotNull() & ~F.isnan(pos)).withColumn(pos, within(F.col(pos)))
    first, last = l.agg(F.min(pos), F.max(pos)).first()
    if first is None:
        return l.join(r.limit(0), F.lit(False)).select(*columns) if not keys else l.join(r.limit(0), keys).select(*columns)
    if open_ends:
        start, end = F.coalesce(start, F.lit(-_LARGEST)), F.coalesce(end, F.lit(_LARGEST))
    r = r.withColumn(lo, start).withColumn(hi, end).filter(
        (F.col(lo) <= F.col(hi)) & (F.col(lo) <= F.lit(last)) & (F.col(hi) >= F.lit(first)) & ~F.isnan(lo)
    )
    r = r.withColumn(lo, F.greatest(F.col(lo), F.lit(first))).withColumn(hi, F.least(F.col(hi), F.lit(last)))
    # Logarithms of zero are NULL, which greatest() passes over.  Places stay below 2 ** 50 bands, so they are exact.
    spread, size = F.log2(F.col(hi) / 2 - F.col(lo) / 2) + 1, F.log2(F.greatest(F.abs(lo), F.abs(hi)))
    wide = F.greatest(F.ceil(spread / LEVEL_BITS) - 1, F.ceil((size - 50) / LEVEL_BITS), F.lit(-1000 // LEVEL_BITS).cast("long"))
    r = r.withColumn(level, wide.cast("int"))
    levels = [x[0] for x in r.select(level).distinct().collect()]  # a few hundred exist
    width = F.pow(F.lit(2.0), F.col(level) * LEVEL_BITS)
    place = lambda c: F.floor(F.col(c) / width)
    l = l.withColumn(level, F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>")))
    l = l.filter(F.abs(F.col(pos) / width) <= 2.0**52).withColumn(band, place(pos)).drop(pos)
    r = r.withColumn(band, F.explode(F.sequence(place(lo), place(hi)))).drop(lo, hi)
    above, below = _INSIDE[closed](F.col(at), F.col(low), F.col(high))
    if open_ends:
        above, below = F.col(low).isNull() | above, F.col(high).isNull() | below
    return l.join(r, [*keys, level, band]).filter(above & below).select(*columns)


def semi_join(
    left: DataFrame, right: DataFrame, on: str | Pairs, right_unique: bool = False, left_unique: bool = False, null_safe: bool = False
) -> DataFrame:
    return _existence(left, right, on, "left_semi", right_unique, left_unique, null_safe)


def anti_join(
    left: DataFrame, right: DataFrame, on: str | Pairs, right_unique: bool = False, left_unique: bool = False, null_safe: bool = False
) -> DataFrame:
    return _existence(left, right, on, "left_anti", right_unique, left_unique, null_safe)


def _existence(left, right, on, how, right_unique, left_unique, null_safe) -> DataFrame:
    """Right keys are reduced to one each before the shuffle, unless they are known to be unique.

    The few keys left are shuffled again for the join, so that Spark can split
    a frequent key of the left side, unless that is known to be unique.  With
    ``null_safe`` a NULL in a key is a value; else it matches nothing.
    """
    pairs = key_pairs(on)
    keys = [a for a, _ in pairs]
    wanted = right.select(*[F.col(b).alias(a) for a, b in pairs])
    wanted = wanted if right_unique else wanted.distinct()
    if right_unique or left_unique:
        return match(left, wanted, keys, how, null_safe).select(*left.columns)
    l, r = _with_companion(left, keys), _with_companion(wanted, keys)
    return match(l, r, [*keys, COMPANION], how, null_safe).select(*left.columns)


def match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, null_safe: bool) -> DataFrame:
    """A join on columns of one name; the left side's columns stay, the right side's keys go.

    Spark hashes a comparison that takes NULL for a value like any other.
    """
    if not null_safe:
        return left.join(right, on=list(keys), how=how)
    names = fresh([*left.columns, *right.columns], *[f"_right_{i}" for i in range(len(keys))])
    other = right.withColumnsRenamed(dict(zip(keys, names)))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    out = left.join(other, reduce(lambda a, b: a & b, same), how)
    return out if how in ("left_semi", "left_anti") else out.drop(*names)


def unmatched(df: DataFrame, fk: Sequence[str], parent: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Rows whose foreign key is set but found nowhere."""
    filled = df
    for c in fk:
        filled = filled.filter(F.col(c).isNotNull())
    return anti_join(filled, parent, list(zip(fk, pk)))
