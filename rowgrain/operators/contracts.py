"""Table contracts: entity, event, versions, sequence, snapshot, hierarchy, link.

A contract is a set of named rules, each a DataFrame of the rows or keys that
break it.  ``report`` counts them; a contract holds when all counts are zero.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowgrain.frame import GrainedFrame
from rowgrain.functions.columns import fresh, position
from rowgrain.operators import slices
from rowgrain.operators.collections import count_sides
from rowgrain.operators.joins import equi_join, range_join, unmatched
from rowgrain.operators.ordered import HOT_ROWS, latest_per_key, next_row, previous_row
from rowgrain.operators.verify import duplicates
from rowgrain.session import cut_lineage
from rowgrain.spec import GrainError

Rules = dict[str, DataFrame]


def report(rules: Mapping[str, DataFrame]) -> DataFrame:
    """``rule, n_violations`` for every rule."""
    parts = [df.agg(F.lit(name).alias("rule"), F.count(F.lit(1)).alias("n_violations")) for name, df in rules.items()]
    return reduce(DataFrame.unionByName, parts)


def holds(rules: Mapping[str, DataFrame]) -> bool:
    return all(df.limit(1).count() == 0 for df in rules.values())


def _nulls(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols]))


def entity(df: DataFrame, ek: Sequence[str]) -> Rules:
    """One row per entity."""
    return {"entity_key_not_null": _nulls(df, ek), "entity_key_unique": duplicates(df, ek)}


def event(df: DataFrame, ek: Sequence[str], at: str) -> Rules:
    """One row per entity and moment."""
    return {
        "entity_key_not_null": _nulls(df, ek), "time_not_null": _nulls(df, [at]), "entity_and_time_unique": duplicates(df, [*ek, at]),
    }


ordered = event  # the same contract for an order other than time


def multi_version(
    df: DataFrame, ek: Sequence[str], since: str, payload: Sequence[str], hot_rows: int = HOT_ROWS
) -> Rules:
    """An event table whose neighbouring versions differ in the payload.

    Comparing neighbours is enough: two equal versions with none that differs
    in between always include two equal neighbours.
    """
    if set(payload) & {*ek, since}:
        raise GrainError("payload and grain overlap")
    return {**event(df, ek, since), "neighbours_differ": unchanged_versions(df, ek, since, payload, hot_rows)}


def unchanged_versions(df, ek, since, payload, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Versions with the payload of the version before."""
    seen = previous_row(df, ek, [since], payload, "_before", hot_rows=hot_rows)
    return seen.filter(F.col("_before").isNotNull() & F.col("_before").eqNullSafe(F.struct(*payload))).drop("_before")


def repaired_versions(df, ek, since, payload, name: str = "valid_to", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Versions that change something, with their end: a run of neighbours with equal payload becomes its first row.

    The end is the start of the next version that is kept, NULL for the newest.  What :func:`unchanged_versions` finds
    is gone, so the result keeps the contract of :func:`multi_version`.
    """
    seen = previous_row(df, ek, [since], payload, "_before", hot_rows=hot_rows)
    same = F.col("_before").isNotNull() & F.col("_before").eqNullSafe(F.struct(*payload))
    return valid_to(seen.filter(~same).drop("_before"), ek, since, name, hot_rows)


def valid_to(df, ek, since, name: str = "valid_to", hot_rows: int = HOT_ROWS) -> DataFrame:
    """End of validity: the start of the next version, NULL for the newest."""
    seen = next_row(df, ek, [since], [since], "_after", hot_rows=hot_rows)
    return seen.withColumn(name, F.col("_after")[since]).drop("_after")


def sequence(df: DataFrame, ek: Sequence[str], at: str) -> Rules:
    """Each entity once and each moment once: a strict order of all rows."""
    return {
        "time_not_null": _nulls(df, [at]),
        "entity_key_unique": duplicates(df, ek),
        "time_unique": duplicates(df, [at]),
    }


sequence_ordered = sequence  # the same contract for an order other than time


# States at a time ------------------------------------------------------------

def state_intervals(
    versions: DataFrame,
    ek: Sequence[str],
    since: str,
    payload: Sequence[str],
    times: DataFrame,
    at: str,
    tie: Sequence[str] = (),
    first: str = "first_at",
    before: str = "before_at",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The versions that snapshots see: ``ek, since, payload``, and the snapshots from ``first`` on and below ``before``.

    ``before`` is NULL for a state that lasts.  There is one row per version that some snapshot shows, however many
    snapshots show it.  A version meets the first snapshot at or after its start by a range join with the spans
    between snapshots; of those that meet the same one the newest counts.
    """
    if position(times, at) is None or position(versions, since) is None:
        raise GrainError("snapshot times have to be numbers, dates or times")
    rest = list(dict.fromkeys(c for c in (*payload, *tie) if c not in (*ek, since)))
    told = versions.select(*ek, since, *rest)
    started, ended, line = fresh([*told.columns, first, before], "_after", "_upto", "_line")
    moments = times.select(F.col(at).alias(ended)).filter(F.col(ended).isNotNull()).distinct().withColumn(line, F.lit(0))
    spans = previous_row(moments, [line], [ended], [ended], started, hot_rows=hot_rows)
    spans = spans.select(F.col(started)[ended].alias(started), ended)
    met = range_join(told, spans, since, started, ended, closed="high", open_ends=True).drop(started).withColumnRenamed(ended, first)
    # Read twice below, so the range join is run once.
    newest = cut_lineage(latest_per_key(met, [*ek, first], [since, *tie]))
    (after,) = fresh(newest.columns, "_next")
    held = next_row(newest, ek, [first], [first], after, hot_rows=hot_rows)
    return held.select(*ek, since, *[c for c in payload if c not in (*ek, since)], first, F.col(after)[first].alias(before))


def states_at(
    versions: DataFrame,
    ek: Sequence[str],
    since: str,
    payload: Sequence[str],
    times: DataFrame,
    at: str,
    tie: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The state of every entity at every snapshot time: ``at, ek, since, payload``.

    As large as entities times snapshots; :func:`state_intervals` says the same in a row per version.
    """
    first, before, moment = fresh([*versions.columns, at], "_first", "_until", "_moment")
    held = state_intervals(versions, ek, since, payload, times, at, tie, first, before, hot_rows)
    moments = times.select(F.col(at).alias(moment)).filter(F.col(moment).isNotNull()).distinct()
    shown = range_join(moments, held, moment, first, before, closed="low", open_ends=True)
    return shown.select(F.col(moment).alias(at), *ek, since, *payload)


def snapshot(
    snapshots: DataFrame, at: str, collection: str, versions: DataFrame, ek: Sequence[str], since: str,
    payload: Sequence[str],
) -> Rules:
    """Each moment once, and its collection is exactly the states of all entities then.

    ``collection`` is an array of structs with the columns ``ek, since, payload``.  A collection is summed up inside
    its row; the states are never laid out per snapshot.
    """
    return {
        "time_not_null": _nulls(snapshots, [at]),
        "time_unique": duplicates(snapshots, [at]),
        "collection_is_complete": snapshot_verdicts(snapshots, at, versions, ek, since, payload, collection).filter(~F.col("same")),
    }


def _digests(cells: Sequence[Column]) -> list[Column]:
    # The hash passes over NULLs, so where they are is hashed as well.
    every = [*cells, *[c.isNull() for c in cells]]
    return [F.xxhash64(*every), F.xxhash64(F.lit(1), *every)]


_SUM = ("_a", "_b")


def snapshot_verdicts(
    snapshots: DataFrame, at: str, versions: DataFrame, ek: Sequence[str], since: str, payload: Sequence[str],
    collection: str | None = None, tie: Sequence[str] = (), hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``at, n_told, n_true, same`` for every moment of ``snapshots``: are exactly the true states told?

    ``snapshots`` has a row per moment with a ``collection``, or else a row per moment and entity with the columns ``ek,
    since, payload``, where a row without entity only names its moment.  A snapshot is summed up by its number of rows and two 64-bit digests joined by exclusive or, and
    so is the truth: a state enters at one snapshot and leaves at another, so each moment's sum follows from the changes
    before it.  True states differ, so equal numbers and digests mean equal collections, but for a collision of 128 bits.
    """
    cells = list(dict.fromkeys([*ek, since, *payload]))
    kinds = versions.select(*cells).schema
    moments = snapshots.select(at).filter(F.col(at).isNotNull())
    if collection is None:
        named = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in ek])
        hashes = [F.when(named, h) for h in _digests([F.col(c).cast(kinds[c].dataType) for c in cells])]
        told = snapshots.groupBy(at).agg(
            F.count_if(named).alias("n_told"), *[F.coalesce(F.bit_xor(h), F.lit(0)).cast("long").alias(f"_told{n}") for n, h in zip(_SUM, hashes)]
        )
    else:
        def folded(k: int) -> Column:
            one = lambda s, e: s.bitwiseXOR(_digests([e[c].cast(kinds[c].dataType) for c in cells])[k])
            return F.aggregate(F.coalesce(collection, F.array().cast(snapshots.schema[collection].dataType)), F.lit(0).cast("long"), one)

        size = F.greatest(F.size(collection), F.lit(0)).cast("long")
        told = snapshots.select(at, size.alias("n_told"), *[folded(k).alias(f"_told{n}") for k, n in enumerate(_SUM)])
    told = told.filter(F.col(at).isNotNull())

    held = state_intervals(versions, ek, since, payload, moments, at, tie, "_first", "_until", hot_rows)
    a, b = _digests([F.col(c) for c in cells])
    change = lambda t, n: held.select(F.col(t).alias(at), F.lit(n).cast("long").alias("_n"), a.alias("_a"), b.alias("_b"))
    changes = change("_first", 1).unionByName(change("_until", -1).filter(F.col(at).isNotNull()))
    still = moments.distinct().select(at, F.lit(0).cast("long").alias("_n"), F.lit(0).cast("long").alias("_a"), F.lit(0).cast("long").alias("_b"))
    # A row per snapshot from here on; pieces of the time line are summed each by itself, then the pieces.
    steps = changes.unionByName(still).groupBy(at).agg(F.sum("_n").alias("_n"), *[F.bit_xor(c).alias(c) for c in _SUM]).withColumn("_line", F.lit(0))
    # Written again, so that a piece number which is the same everywhere stays a key of the join below.
    steps = cut_lineage(slices.pieces(cut_lineage(steps), ["_line"], [at], hot_rows, "_piece"))
    along = Window.partitionBy("_piece").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("_line").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = steps.groupBy("_line", "_piece").agg(F.sum("_n").alias("_n"), *[F.bit_xor(c).alias(c) for c in _SUM]).select(
        "_piece", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in _SUM],
    )
    true = steps.select(at, "_piece", F.sum("_n").over(along).alias("_n"), *[F.bit_xor(c).over(along).alias(c) for c in _SUM]).join(pieces, "_piece").select(
        at, (F.col("_n") + F.col("_n0")).alias("n_true"), *[F.col(c).bitwiseXOR(F.col(f"{c}0")).alias(c) for c in _SUM]
    )
    same = (F.col("n_told") == F.col("n_true")) & (F.col("_told_a") == F.col("_a")) & (F.col("_told_b") == F.col("_b"))
    return told.join(true, at).select(at, "n_told", "n_true", same.alias("same"))


def snapshot_differences(
    told: DataFrame, at: str, versions: DataFrame, ek: Sequence[str], since: str, payload: Sequence[str],
    times: DataFrame,
) -> DataFrame:
    """States told by flat snapshot rows but not true, or true and not told.

    Snapshots of many entities are kept flat, one row per moment and entity.  All states are laid out; where only the
    verdict of each snapshot is asked for, or its numbers, use :func:`snapshot_verdicts`.
    """
    cols = [at, *ek, since, *payload]
    true = states_at(versions, ek, since, payload, times, at)
    return count_sides(told.select(*cols), true.select(*cols)).filter(F.col("n_left") != F.col("n_right"))


# Links between tables --------------------------------------------------------

def has_parent(child: DataFrame, fk: Sequence[str], parent: DataFrame, pk: Sequence[str]) -> Rules:
    """A set foreign key is found in the parent; NULL means a root."""
    return {"parent_exists": unmatched(child, fk, parent, pk), "parent_key_unique": duplicates(parent, pk)}


def roots(child: DataFrame, fk: Sequence[str]) -> DataFrame:
    return _nulls(child, fk)


def link(
    df: DataFrame, ek: Sequence[str], fk1: Sequence[str], party1: DataFrame, pk1: Sequence[str],
    fk2: Sequence[str], party2: DataFrame, pk2: Sequence[str],
) -> Rules:
    """A many-to-many relation, or the edges of a graph: one row per pair of parties."""
    return {
        "entity_key_unique": duplicates(df, ek),
        "parties_not_null": _nulls(df, [*fk1, *fk2]),
        "pair_unique": duplicates(df, [*fk1, *fk2]),
        "party1_exists": unmatched(df, fk1, party1, pk1),
        "party2_exists": unmatched(df, fk2, party2, pk2),
    }


def relates_to(links: DataFrame, ask: DataFrame, cols: Sequence[str], name: str = "related") -> DataFrame:
    """For each asked pair: is there a link?"""
    known = links.select(*cols).distinct().withColumn(name, F.lit(True))
    told = equi_join(ask, known, list(cols), "left", own_shuffle=True)
    return told.withColumn(name, F.coalesce(F.col(name), F.lit(False)))


# Relations between two rows --------------------------------------------------

def precedes(t1: Column, t2: Column) -> Column:
    return t1 < t2


def ties(e1: Column, t1: Column, e2: Column, t2: Column) -> Column:
    """At one moment, but of different entities."""
    return (e1 != e2) & (t1 == t2)


happened_before, is_concurrent_with = precedes, ties


def pair_counts(df: DataFrame, ek: Sequence[str], at: str) -> DataFrame:
    """How many pairs of rows are ordered in time, and how many are concurrent.

    Counted from the number of rows per moment; no pair is formed.
    """
    big = lambda c: c.cast("decimal(18,0)")
    per_both = df.groupBy(*ek, at).agg(F.count(F.lit(1)).alias("_n"))
    per_time = per_both.groupBy(at).agg(
        F.sum("_n").alias("_n"), F.sum(big(F.col("_n")) * big(F.col("_n"))).alias("_same")
    )
    square = F.sum(big(F.col("_n")) * big(F.col("_n")))
    n = big(F.sum("_n"))
    return per_time.agg(
        ((n * n - square) / 2).cast("decimal(38,0)").alias("n_before"),
        ((square - F.sum("_same")) / 2).cast("decimal(38,0)").alias("n_concurrent"),
    )


# Constraints -----------------------------------------------------------------

def each_row(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that do not meet a condition; an unknown outcome counts as not met."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def whole_collection(df: DataFrame, condition: Column, name: str = "holds") -> DataFrame:
    """One row with the truth of a condition over aggregates."""
    return df.agg(condition.alias(name))


def across(left: DataFrame, fk: Sequence[str], right: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Referential integrity: left rows whose key is not on the right."""
    return unmatched(left, fk, right, pk)


# Which contract does a table meet? -------------------------------------------

#: Most specific first; a class later in the list is implied by some class before it.
CLASSES = (
    "snapshot", "seq_event", "multi_version", "event", "seq_ordered", "ordered", "nm_relation", "entity",
    "not_classified",
)


def classify(candidates: Mapping[str, Rules]) -> DataFrame:
    """Evaluate the contracts given by class name; the first class that holds is ``chosen``.

    Rows ``class, n_violations, holds, chosen``; the counts are the witness.
    """
    unknown = sorted(set(candidates) - set(CLASSES))
    if unknown:
        raise GrainError(f"no such class: {', '.join(unknown)}")
    parts = [
        report(rules).agg(
            F.lit(CLASSES.index(name)).alias("_rank"), F.lit(name).alias("class"),
            F.sum("n_violations").alias("n_violations"),
        )
        for name, rules in candidates.items()
    ]
    table = reduce(DataFrame.unionByName, parts).withColumn("holds", F.col("n_violations") == 0)
    # One row per class, so at most nine rows here.
    everything = Window.orderBy("_rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = F.min(F.when(F.col("holds"), F.col("_rank"))).over(everything)
    return table.select(
        "class", "n_violations", "holds", F.coalesce(F.col("_rank") == best, F.lit(False)).alias("chosen")
    )


def integrate(frames: Sequence[GrainedFrame], ek: Sequence[str]) -> GrainedFrame:
    """One row per entity from tables that share it; each is already coarsened to the entity key."""
    out = frames[0].expect_grain(*ek)
    for f in frames[1:]:
        out = out.full_join_totals(f.expect_grain(*ek), list(ek))
    return out
