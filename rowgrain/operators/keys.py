"""Which column sets identify a row: refutation on samples, full counts only for what survives, and key discovery.

Two rows that agree on a set prove that it is no key, and so is no part of it.  Two cheap samples give such proofs.

* Bounded samples of rows, of all and of groups equal in one column, compared pair by pair: most sets fall here.
* All rows whose values of a set hash into one class of many.  Rows equal on the set are in the sample together, so one
  duplicate among the sampled keys is a proof, also where duplicates are too rare for a sample of rows.

A set that survives both is nearly always a key; the count that proves it is the only one that shuffles all rows, once
for all sets with a column in common whose values are spread widely.  Rows equal on a set have equal hashes, so no key
is missed.
"""

from __future__ import annotations

from collections.abc import Collection, Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowgrain.operators.verify import PAIR_ROWS, column_hash as _hash, keys_by_column, require_columns, spread_columns, uniqueness
from rowgrain.spec import Columns

#: Keys of one set that its hash sample aims at, and the most classes it is cut from.
SAMPLE_KEYS, CLASSES = 4_000, 1 << 20
#: Sets sampled in one pass.
AT_ONCE = 256


def agreements(df: DataFrame, cols: Iterable[str], rows: int = PAIR_ROWS) -> list[Columns]:
    """The largest column sets on which two rows of a sample agree, from a few samples of ``rows`` rows at most each.

    The first sample is of rows, the others are one per column, of whole groups with equal values in it: two rows that
    agree on a column of many values do not meet otherwise.  Values are compared by two 64-bit hashes.
    """
    cols = sorted(cols)
    both = df.select(*[h.alias(f"h{k}_{i}") for i, c in enumerate(cols) for k, h in enumerate((_hash(c, i), _hash(c, -2 - i)))])
    any_order = F.xxhash64(*both.columns)
    samples = [both.orderBy(any_order).limit(rows)] + [both.orderBy(f"h0_{i}", any_order).limit(rows) for i in range(len(cols))]
    got: list[list] = [[] for _ in samples]
    for r in reduce(DataFrame.unionAll, [s.withColumn("sample", F.lit(k)) for k, s in enumerate(samples)]).collect():
        got[r[-1]].append(r[:-1])
    out: list[Columns] = []
    for s in sorted(set().union(*[_agreeing(np.array(g, dtype=np.int64).reshape(len(g), len(cols), 2), cols) for g in got]), key=lambda s: (-len(s), sorted(s))):
        if s and not any(s <= t for t in out):
            out.append(s)
    return out


def _agreeing(x: np.ndarray, cols: list[str]) -> set[Columns]:
    """The sets on which two rows agree."""
    words = -(-len(cols) // 64)
    found = np.empty((0, words), dtype=np.uint64)
    for lo in range(0, len(x), 64):  # rows of a block against all after its first
        same = (x[lo:lo + 64, None] == x[None, lo:]).all(3)
        pairs = same[np.triu(np.ones(same.shape[:2], dtype=bool), 1)]
        bits = np.packbits(np.pad(pairs, ((0, 0), (0, 64 * words - len(cols)))), axis=1).view(np.uint64)
        new = np.unique(bits[:, 0])[:, None] if words == 1 else np.unique(bits, axis=0)
        found = np.unique(np.concatenate([found, new]), axis=0)
    return {frozenset(c for c, bit in zip(cols, np.unpackbits(m.view(np.uint8))) if bit) for m in found}


def _classes(n_rows: int) -> int:
    return max(1, min(CLASSES, n_rows // SAMPLE_KEYS))


def refuted_by_hash(df: DataFrame, sets: Collection[Columns], classes: int) -> set[Columns]:
    """The sets that have a duplicate among the keys of one hash class in ``classes``; a pass for ``AT_ONCE`` of them.

    A row goes on only for the sets it is sampled for, as two 64-bit hashes of its values, and these are counted on each
    task before the shuffle.
    """
    ordered = sorted(map(frozenset, sets), key=lambda s: (len(s), sorted(s)))
    out: set[Columns] = set()
    for lo in range(0, len(ordered), AT_ONCE):
        some = ordered[lo:lo + AT_ONCE]
        cols = sorted(frozenset().union(*some))
        # Sets are data, not expressions: the plan stays small however many there are.
        literal = F.array(*[F.struct(F.lit(k).alias("set"), F.array(*[F.lit(cols.index(c)) for c in sorted(s)]).alias("of")) for k, s in enumerate(some)])
        both = df.select(F.array(*[_hash(c, i) for i, c in enumerate(cols)]).alias("a"), F.array(*[_hash(c, -2 - i) for i, c in enumerate(cols)]).alias("b"))
        mixed = lambda side, s: F.aggregate(s["of"], F.lit(0).cast("long"), lambda x, i: x.bitwiseXOR(F.get(side, i)))
        sampled = (
            both.select(F.explode(F.filter(literal, lambda s: F.pmod(mixed("a", s), F.lit(classes)) == 0)).alias("s"), "a", "b")
            .select(F.col("s.set").alias("set"), mixed("a", F.col("s")).alias("a"), mixed("b", F.col("s")).alias("b"))
        )
        twice = sampled.groupBy("set", "a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        out |= {some[r[0]] for r in twice.select("set").distinct().collect()}
    return out


def refuted_by_column(df: DataFrame, sets: Collection[Columns], column: str, n_rows: int) -> set[Columns]:
    """The sets with ``column`` in each that have a duplicate."""
    ordered = sorted(map(frozenset, sets), key=lambda s: (len(s), sorted(s)))
    twice = keys_by_column(df, ordered, column, n_rows).filter("n > 1")
    return {ordered[r[0]] for r in twice.select("set").distinct().collect()}


def refuted(df: DataFrame, sets: Collection[Columns], n_rows: int) -> set[Columns]:
    """The sets that have a duplicate among all rows."""
    left, out = set(map(frozenset, sets)), set()
    spread = spread_columns(df, frozenset().union(*left))
    while spread and left:
        # Neither order of sets nor of columns matters for the result; the column of most sets saves most shuffles.
        column = max(spread, key=lambda c: sum(c in s for s in left))
        some = sorted([s for s in left if column in s], key=sorted)
        for lo in range(0, len(some), AT_ONCE):
            out |= refuted_by_column(df, some[lo:lo + AT_ONCE], column, n_rows)
        left -= set(some)
        spread.remove(column)
    return out | (refuted_by_hash(df, left, 1) if left else set())


def unique_sets(df: DataFrame, sets: Iterable[Iterable[str]], known: Collection[Columns] | None = None, n_rows: int | None = None) -> dict[Columns, bool]:
    """For each column set whether its values differ between all rows; NULL is a value.

    ``known``: sets on which rows are known to agree.  A superset of a key found unique is not counted again.
    """
    wanted = {frozenset(s) for s in sets}
    for s in wanted:
        require_columns(df, s)
    n_rows = df.count() if n_rows is None else n_rows
    if n_rows <= 1:
        return dict.fromkeys(wanted, True)
    if known is None:
        known = agreements(df, frozenset().union(*wanted)) if any(wanted) else []
    out = {s: False for s in wanted if not s or any(s <= k for k in known)}
    rest = wanted - set(out)
    for classes in sorted({_classes(n_rows), 1}, reverse=True):  # the last pass takes all rows
        # A superset of a key needs no count; whether it has one is known for sets of one size after the other.
        for size in sorted({len(x) for x in rest}):
            level = {x for x in rest if len(x) == size and not any(t <= x for t, ok in out.items() if ok)}
            gone = (refuted(df, level, n_rows) if classes == 1 else refuted_by_hash(df, level, classes)) if level else set()
            out.update(dict.fromkeys(gone, False))
            if classes == 1:
                out.update(dict.fromkeys(level - gone, True))
        rest -= set(out)
    out.update(dict.fromkeys(rest, True))  # supersets of keys
    return out


def smaller(cols: Columns) -> list[Columns]:
    """The set without each of its columns; none for a key of one column."""
    return [cols - {c} for c in sorted(cols)] if len(cols) > 1 else []


def minimality(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """One row: ``n_rows, n_removable, is_minimal``.  A table of at most one row, or a key of one column, is minimal."""
    cols = frozenset(cols)
    n_rows = df.count()
    n = sum(unique_sets(df, smaller(cols), n_rows=n_rows).values()) if n_rows > 1 else 0
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(n).cast("long").alias("n_removable"), F.lit(n == 0).alias("is_minimal"))


def is_key(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """One row: ``is_superkey``, and ``is_key`` where no smaller set is unique; dropping one column at a time is enough."""
    cols = frozenset(cols)
    n_rows = df.count()
    got = unique_sets(df, [cols, *smaller(cols)], n_rows=n_rows)
    minimal = n_rows <= 1 or not any(got[s] for s in smaller(cols))
    return df.sparkSession.createDataFrame([(got[cols], got[cols] and minimal)], "is_superkey boolean, is_key boolean")


def accept_grain(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Does a declared grain hold on these rows?  One row: unique, minimal, and the counts behind it.

    Only the keys of the whole grain are counted; minimality is refuted on samples where it can be.
    """
    minimal = minimality(df, cols).first()["is_minimal"]
    return uniqueness(df, cols).select("n_rows", "n_keys", (~F.col("has_duplicates")).alias("is_unique"), F.lit(minimal).alias("is_minimal"))


def _candidates(cols: list[str], size: int, keys: list[Columns]) -> Iterator[Columns]:
    """Sets of one size without a key in them."""
    for s in combinations(cols, size):
        s = frozenset(s)
        if not any(k <= s for k in keys):
            yield s


def minimal_keys(df: DataFrame, cols: Iterable[str] | None = None, max_size: int = 4) -> list[Columns]:
    """All smallest column sets of up to ``max_size`` columns that identify every row, level by level.

    Sets that hold a key are never looked at.  Sets inside an agreement of two sampled rows are refuted without a pass,
    those left by hash samples, ``AT_ONCE`` in a pass, and only what survives is counted in full.  A table of at most
    one row has the empty set as its key.
    """
    cols = sorted(df.columns if cols is None else cols)
    require_columns(df, cols)
    n_rows = df.count()
    if n_rows <= 1:
        return [frozenset()]
    known = agreements(df, cols)
    keys: list[Columns] = []
    for size in range(1, max_size + 1):
        level = [s for s in _candidates(cols, size, keys) if not any(s <= k for k in known)]
        keys += [s for s, ok in unique_sets(df, level, known, n_rows).items() if ok] if level else []
    return sorted(keys, key=lambda s: (len(s), sorted(s)))


def discovered(df: DataFrame, cols: Iterable[str] | None = None, max_size: int = 4) -> DataFrame:
    """:func:`minimal_keys` as rows ``(key_columns, n_columns)``; names are in order, with a comma between."""
    found = [(",".join(sorted(k)), len(k)) for k in minimal_keys(df, cols, max_size)]
    return df.sparkSession.createDataFrame(found, "key_columns string, n_columns int")
