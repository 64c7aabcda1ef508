"""Checks of a claimed key on the rows themselves.

Every check is one lazy DataFrame with a small result.  Counting by key first
lets each task combine its rows before the shuffle, so one frequent key does
not make one slow task.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowgrain.functions.columns import fresh, key
from rowgrain.operators.joins import equi_join, plan_names
from rowgrain.spec import Columns, MissingColumns, columns, join_grain, rename_set

PASS, FAIL, INCONCLUSIVE = "pass", "fail", "inconclusive"


def require_columns(df: DataFrame, cols: Iterable[str]) -> None:
    missing = sorted(columns(cols) - set(df.columns))
    if missing:
        raise MissingColumns(f"not in the table: {', '.join(missing)}")


def null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULLs per key column, one row per column."""
    require_columns(df, cols)
    cols = sorted(cols)
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return counted.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null")) for c in cols])
        ).alias("x")
    ).select("x.*")


def uniqueness(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """One row: ``n_rows``, ``n_keys``, ``has_duplicates``.  An empty table passes."""
    cols = sorted(cols)
    require_columns(df, cols)
    per_key = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n_rows"),
        F.count_if(F.col("_n") > 0).alias("n_keys"),
        F.coalesce(F.max("_n") > 1, F.lit(False)).alias("has_duplicates"),
    )


def duplicates(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """The keys that occur more than once, with their counts."""
    cols = sorted(cols)
    require_columns(df, cols)
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def is_unique(df: DataFrame, cols: Iterable[str]) -> bool:
    return duplicates(df, cols).limit(1).count() == 0


def count_sets(df: DataFrame, sets: dict[str, Columns]) -> DataFrame:
    """One row: ``n_rows`` and, under its name, the number of distinct values of each column set.

    A single pass: rows are grouped by all sets at once and combined on each
    task before the shuffle.  A NULL in a set is a value of its own.
    """
    wanted = set(sets.values()) - {frozenset()}
    cols = sorted(frozenset().union(*wanted))
    # Spark numbers a set by the columns it leaves out, first column in the highest bit.
    number = {s: sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in s) for s in wanted}
    if not wanted:
        return df.agg(
            F.count(F.lit(1)).alias("n_rows"),
            *[F.when(F.count(F.lit(1)) > 0, 1).otherwise(0).cast("long").alias(n) for n in sets],
        )
    per_key = df.groupingSets([[F.col(c) for c in sorted(s)] for s in number], *[F.col(c) for c in cols]).agg(
        F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("_n")
    )
    per_set = per_key.groupBy("_set").agg(F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_keys"))
    some = F.coalesce(F.max("_rows"), F.lit(0))
    of = lambda s: F.coalesce(F.max(F.when(F.col("_set") == number[s], F.col("_keys"))), F.lit(0))
    return per_set.agg(
        some.alias("n_rows"), *[(of(s) if s else F.least(some, F.lit(1))).cast("long").alias(n) for n, s in sets.items()]
    )


#: Rows of a sample, which are compared pair by pair on the driver or tell how widely a column is spread.
PAIR_ROWS = 1000
#: A column is spread widely if none of its values has a larger share of a sample of rows.
LARGEST_SHARE = 0.01
#: Keys that a task counts on average where rows are shuffled by a column.
TASK_KEYS = 1_000_000


def column_hash(c: str, number: int) -> Column:
    """Differs between columns, so that equal columns do not cancel out."""
    return F.xxhash64(F.lit(number), F.col(c))


def spread_columns(df: DataFrame, cols: Iterable[str], rows: int = PAIR_ROWS) -> list[str]:
    """The columns of many values, none of them frequent, as a sample of rows shows."""
    cols = sorted(cols)
    hashed = df.select(*[column_hash(c, i).alias(f"h{i}") for i, c in enumerate(cols)])
    x = np.array(hashed.orderBy(F.xxhash64(*hashed.columns)).limit(rows).collect(), dtype=np.int64).reshape(-1, len(cols))
    most = [np.unique(x[:, i], return_counts=True)[1].max(initial=0) for i in range(len(cols))]
    return [c for c, n in zip(cols, most) if n <= max(1, LARGEST_SHARE * len(x))]


def keys_by_column(df: DataFrame, sets: Sequence[Columns], column: str, n_rows: int) -> DataFrame:
    """Each key of each set with its rows, ``set`` (number in ``sets``), ``n``; every set has to hold ``column``.

    Rows are shuffled once, by that column, and their keys not at all; a key is two 64-bit hashes.
    """
    cols = sorted(frozenset().union(*sets))
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_rows * len(sets) // TASK_KEYS))
    at = fresh(cols, "_at")[0]
    rows = df.select(*cols, F.xxhash64(column).alias(at)).repartition(tasks, at)
    hashes = lambda i, c: (("a", column_hash(c, i)), ("b", column_hash(c, -2 - i)))
    hashed = rows.select(at, *[h.alias(f"{k}{i}") for i, c in enumerate(cols) for k, h in hashes(i, c)])
    mixed = lambda k, s: reduce(Column.bitwiseXOR, [F.col(f"{k}{cols.index(c)}") for c in sorted(s)]).alias(k)
    keys = hashed.select(at, F.posexplode(F.array(*[F.struct(mixed("a", s), mixed("b", s)) for s in sets])).alias("set", "key"))
    return keys.groupBy(at, "set", "key.a", "key.b").agg(F.count(F.lit(1)).alias("n"))


def reduced_counts(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """For each key column: how many keys are left when it is dropped.

    Rows ``(dropped, n_rows, n_keys, removable)``; ``dropped`` is NULL for the whole key.  Sets with a widely spread
    column in common are counted after one shuffle of the rows by it; two small jobs look for such columns.
    """
    cols = columns(cols)
    require_columns(df, cols)
    sets = {"_whole": cols, **({f"_without_{c}": cols - {c} for c in sorted(cols)} if len(cols) > 1 else {})}
    n_rows = df.count()
    spread = spread_columns(df, cols) if n_rows > 1 else []
    parts = []
    while spread and sets:
        column = max(spread, key=lambda c: sum(c in s for s in sets.values()))
        some = [n for n in sets if column in sets[n]]
        spread.remove(column)
        if some:
            per_key = keys_by_column(df, [sets.pop(n) for n in some], column, n_rows)
            counted = per_key.groupBy("set").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"))
            name = F.get(F.array(*[F.lit(n) for n in some]), F.col("set"))
            parts.append(counted.select(name.alias("name"), "n_rows", "n_keys"))
    if sets:
        rows = [F.struct(F.lit(n).alias("name"), F.col("n_rows"), F.col(n).alias("n_keys")) for n in sets]
        parts.append(count_sets(df, sets).select(F.explode(F.array(*rows)).alias("x")).select("x.*"))
    dropped = F.when(F.col("name") != "_whole", F.regexp_replace("name", "^_without_", "")).alias("dropped")
    out = reduce(DataFrame.unionByName, parts).select(dropped, "n_rows", "n_keys")
    removable = F.col("dropped").isNotNull() & (F.col("n_keys") == F.col("n_rows")) & (F.col("n_rows") > 1)
    return out.withColumn("removable", removable)


def removable_columns(df: DataFrame, cols: Iterable[str]) -> list[str]:
    found = reduced_counts(df, cols).filter("removable").select("dropped").collect()
    return sorted(r.dropped for r in found)


def minimality(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """One row: ``n_rows``, ``n_removable``, ``is_minimal``.

    A table of at most one row, or a key of one column, counts as minimal.
    """
    return reduced_counts(df, cols).agg(
        F.max("n_rows").alias("n_rows"),
        F.count_if("removable").alias("n_removable"),
        (F.count_if("removable") == 0).alias("is_minimal"),
    )


def is_minimal(df: DataFrame, cols: Iterable[str]) -> bool:
    """Stops at the first column that can go."""
    cols = sorted(cols)
    if len(cols) <= 1 or df.limit(2).count() <= 1:
        return True
    return not any(is_unique(df, [x for x in cols if x != c]) for c in cols)


def is_superkey(df: DataFrame, cols: Iterable[str]) -> bool:
    return is_unique(df, cols)


def is_key(df: DataFrame, cols: Iterable[str]) -> bool:
    """Unique, and every smaller set is not; dropping one column at a time is enough."""
    return is_unique(df, cols) and is_minimal(df, cols)


def dependency_violations(df: DataFrame, lhs: Iterable[str], rhs: Iterable[str]) -> DataFrame:
    """Values of ``lhs`` that come with more than one ``rhs``.

    Smallest and greatest right-hand value differ exactly then, and both are
    kept per task, unlike a distinct count.
    """
    lhs = sorted(lhs)
    right = key(rhs)
    return (
        df.groupBy(*lhs)
        .agg(F.min(right).alias("_lo"), F.max(right).alias("_hi"), F.count(F.lit(1)).alias("n_rows"))
        .filter(~F.col("_lo").eqNullSafe(F.col("_hi")))
        .select(*lhs, "n_rows")
    )


# Audit of one join -----------------------------------------------------------

def _verdict(ok: Column, applicable: Column, possible: Column) -> Column:
    """Three values; a check that does not apply passes, as nothing contradicts it."""
    return F.when(~applicable, PASS).when(~possible, INCONCLUSIVE).when(ok, PASS).otherwise(FAIL)


def _facts(df: DataFrame, keys: dict[str, Columns]) -> DataFrame:
    """``tag, n_rows, n_keys, n_removable`` for each named key, all counted in one pass."""
    names = {}
    for cols in keys.values():
        for s in [cols, *[cols - {c} for c in cols]]:
            names.setdefault(s, f"_d{len(names)}")
    counts = count_sets(df, {n: s for s, n in names.items()})
    out = []
    for tag, cols in keys.items():
        gone = [(F.col(names[cols - {c}]) == F.col("n_rows")).cast("int") for c in cols] if len(cols) > 1 else []
        removable = F.when(F.col("n_rows") > 1, reduce(lambda a, b: a + b, gone, F.lit(0))).otherwise(0)
        out.append(F.struct(
            F.lit(tag).alias("tag"), F.col("n_rows"), F.col(names[cols]).alias("n_keys"), removable.alias("n_removable")
        ))
    return counts.select(F.explode(F.array(*out)).alias("x")).select("x.*")


def audit_join(
    left: DataFrame, right: DataFrame, on, g1: Iterable[str], g2: Iterable[str]
) -> DataFrame:
    """The six properties of an inner join, one row each: ``property, result``.

    Minimality that the data does not show is ``inconclusive``: few rows, or
    inputs whose own grains are not minimal, cannot prove a column needed.
    """
    names = plan_names(left.columns, right.columns, on)
    jk = frozenset(names.keys)
    n1, n2 = rename_set(g1, names.left), rename_set(g2, names.right)
    jg = join_grain(n1, n2, jk)
    wrong = jg.f1 if jg.grain == jg.f2 and jg.relation == "proper_superset" else jg.f2
    joined = equi_join(left, right, on).select(*sorted(jg.f1 | jg.f2))

    facts = (
        _facts(joined, {"f1": jg.f1, "f2": jg.f2})
        .unionByName(_facts(left, {"g1": columns(g1)}))
        .unionByName(_facts(right, {"g2": columns(g2)}))
    )
    of = lambda tag, what: F.max(F.when(F.col("tag") == tag, F.col(f"n_{what}"))).alias(f"{tag}_{what}")
    row = facts.agg(*[of(t, w) for t in ("f1", "f2", "g1", "g2") for w in ("rows", "keys", "removable")])

    conv = "f1" if jg.grain == jg.f1 else "f2"
    yes, no = F.lit(True), F.lit(False)
    unique = (F.col("f1_rows") == F.col("f1_keys")) & (F.col("f2_rows") == F.col("f2_keys"))
    inputs_ok = (F.col("g1_removable") == 0) & (F.col("g2_removable") == 0)
    enough = F.col("f1_rows") > 1
    conv_min = F.col(f"{conv}_removable") == 0
    both_min = (F.col("f1_removable") == 0) & (F.col("f2_removable") == 0)
    ordered = jg.relation in ("proper_subset", "proper_superset")
    wrong_tag = "f1" if wrong == jg.f1 else "f2"
    size_law = len(jg.f1) - len(jg.f2) == len(n1 & jk) - len(n2 & jk)
    smallest = len(jg.grain) <= min(len(jg.f1), len(jg.f2))
    checks = [
        ("P1_both_keys_unique", _verdict(unique, yes, yes)),
        ("P2_kept_key_minimal", _verdict(conv_min, F.lit(len(jg.grain) > 1) & enough, inputs_ok & conv_min)),
        ("P3_larger_key_reducible", _verdict(F.col(f"{wrong_tag}_removable") > 0, F.lit(ordered and len(wrong) > 1) & enough, yes)),
        ("P4_unordered_keys_minimal", _verdict(both_min, F.lit(jg.relation == "incomparable") & enough, inputs_ok & both_min)),
        ("P5_sizes_agree", _verdict(F.lit(size_law), yes, yes)),
        ("P6_kept_key_not_larger", _verdict(F.lit(smallest), yes, yes)),
    ]
    return row.select(
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("property"), c.alias("result")) for n, c in checks])
        ).alias("x")
    ).select("x.property", "x.result")
