"""Many join configurations checked at once.

A configuration is a row: the columns of two tables, the join key and both
grains, as arrays of names.  All configurations, their rows, the joins and the
checks of every candidate key form one Spark plan; nothing loops over
configurations.  A row of a configured table is an array of numbers, one per
column, so tables of different shape share one DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product as cartesian

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowgrain.functions import grainsets as gs
from rowgrain.sources.generate import key_index

SCHEMA = (
    "config_id bigint, r1_fields array<string>, r2_fields array<string>, jk array<string>,"
    " g1 array<string>, g2 array<string>"
)


# Configurations --------------------------------------------------------------

def derive(configs: DataFrame) -> DataFrame:
    """All derived column sets and the class of each configuration, in one ``select``."""
    base = configs.select(
        "*",
        gs.intersection("g1", "jk").alias("g1_jk"),
        gs.intersection("g2", "jk").alias("g2_jk"),
        gs.difference("g1", "jk").alias("g1_rest"),
        gs.difference("g2", "jk").alias("g2_rest"),
        gs.key_relation("g1", "g2", "jk").alias("jk_rel"),
        gs.join_candidates("g1", "g2", "jk")[0].alias("f1"),
        gs.join_candidates("g1", "g2", "jk")[1].alias("f2"),
    )
    return base.select(
        "*",
        gs.preferred(F.col("jk_rel"), F.col("f1"), F.col("f2")).alias("convention"),
        gs.superseded_join_grain("g1", "g2", "jk").alias("superseded"),
        (F.size("g1_rest") == 0).alias("g1e"),
        (F.size("g2_rest") == 0).alias("g2e"),
    )


def shapes(max_size: int) -> list[tuple[int, int, int, int]]:
    """``(n_jk, n_left, n_right, first_id)`` of every pair of table shapes up to a size."""
    out, first = [], 0
    for n_jk in range(1, max_size + 1):
        for n_left, n_right in cartesian(range(max_size - n_jk + 1), repeat=2):
            out.append((n_jk, n_left, n_right, first))
            first += (2 ** (n_jk + n_left) - 1) * (2 ** (n_jk + n_right) - 1)
    return out


def count_configs(max_size: int) -> int:
    n_jk, n_left, n_right, first = shapes(max_size)[-1]
    return first + (2 ** (n_jk + n_left) - 1) * (2 ** (n_jk + n_right) - 1)


def all_configs(spark: SparkSession, max_size: int) -> DataFrame:
    """Every configuration whose tables have at most ``max_size`` columns.

    The driver lists table shapes only; the grains are bit masks exploded on the executors.
    """
    base = spark.createDataFrame(shapes(max_size), "n_jk int, n_left int, n_right int, first_id bigint")
    masks = base.withColumn(
        "g1_mask", F.expr("explode(sequence(1L, shiftleft(1L, n_jk + n_left) - 1))")
    ).withColumn("g2_mask", F.expr("explode(sequence(1L, shiftleft(1L, n_jk + n_right) - 1))"))
    number = F.col("first_id") + F.expr("(g1_mask - 1) * (shiftleft(1L, n_jk + n_right) - 1) + g2_mask - 1")
    return from_masks(masks.withColumn("config_id", number))


def from_masks(masks: DataFrame) -> DataFrame:
    """Name the columns ``a0.. j0.. b0..`` and turn bit masks into grains.

    Bit ``i`` of a mask stands for column ``i`` of the table.
    """
    named = masks.select(
        "config_id", "g1_mask", "g2_mask",
        F.expr("transform(sequence(1, n_jk), x -> concat('j', x - 1))").alias("jk"),
        F.expr("transform(filter(sequence(0, n_left), x -> x > 0), x -> concat('a', x - 1))").alias("left_only"),
        F.expr("transform(filter(sequence(0, n_right), x -> x > 0), x -> concat('b', x - 1))").alias("right_only"),
    ).select(
        "config_id", "g1_mask", "g2_mask", "jk",
        F.concat("left_only", "jk").alias("r1_fields"), F.concat("jk", "right_only").alias("r2_fields"),
    )
    return named.select(
        "config_id", "r1_fields", "r2_fields", "jk",
        F.expr("filter(r1_fields, (x, i) -> shiftright(g1_mask, i) % 2 = 1)").alias("g1"),
        F.expr("filter(r2_fields, (x, i) -> shiftright(g2_mask, i) % 2 = 1)").alias("g2"),
    )


def random_configs(numbers: DataFrame, number: str, max_jk: int = 8, max_only: int = 7) -> DataFrame:
    """One configuration per row, its shape and grains drawn from a row number.

    Plain arithmetic instead of a random generator, so any engine can draw the
    same ones.  Needs ``config_id`` in ``numbers``.
    """
    n = f"({number} % 1000003)"
    drawn = numbers.select(
        "config_id",
        F.expr(f"cast({n} * 31 % 1009 % {max_jk} + 1 as int)").alias("n_jk"),
        F.expr(f"cast({n} * 37 % 2003 % {max_only + 1} as int)").alias("n_left"),
        F.expr(f"cast({n} * 41 % 3001 % {max_only + 1} as int)").alias("n_right"),
        F.expr(f"{n} * 7919 % 1000033").alias("d1"),
        F.expr(f"{n} * 104729 % 1000037").alias("d2"),
    )
    return from_masks(
        drawn.select(
            "config_id", "n_jk", "n_left", "n_right",
            F.expr("d1 % (shiftleft(1L, n_jk + n_left) - 1) + 1").alias("g1_mask"),
            F.expr("d2 % (shiftleft(1L, n_jk + n_right) - 1) + 1").alias("g2_mask"),
        )
    )


# Sixteen boundary shapes, as (name, R1, G1, R2, G2, Jk).
EDGE_CASES = (
    ("grain_inside_jk", "j0 j1 a0 a1", "j0", "j0 j1 b0", "j0 b0", "j0 j1"),
    ("grain_outside_jk", "j0 a0 a1", "a0 a1", "j0 b0", "j0 b0", "j0"),
    ("grain_is_full_type", "j0 j1 a0", "j0 j1 a0", "j0 j1 b0", "j0 b0", "j0 j1"),
    ("single_field_grain", "j0 j1 a0", "a0", "j0 j1 b0", "b0", "j0 j1"),
    ("natural_join", "j0 j1 j2 a0", "j0 j1 a0", "j0 j1 j2 b0", "j0 j2 b0", "j0 j1 j2"),
    ("single_field_jk", "j0 a0 a1", "j0 a0", "j0 b0 b1", "j0 b0", "j0"),
    ("jk_portions_differ_by_one", "j0 j1 j2 a0", "j0 a0", "j0 j1 j2 b0", "j0 j1 b0", "j0 j1 j2"),
    ("self_join", "j0 j1 a0", "j0 a0", "j0 j1 b0", "j0 b0", "j0 j1"),
    ("both_grains_inside_jk", "j0 j1 j2 a0", "j0 j1", "j0 j1 j2 b0", "j0 j1 j2", "j0 j1 j2"),
    ("large_jk_nongrain", "j0 j1 j2 j3 j4 a0", "j0 a0", "j0 j1 j2 j3 j4 b0", "j0 b0", "j0 j1 j2 j3 j4"),
    ("equal_jk_different_rest", "j0 j1 a0 a1", "j0 a0 a1", "j0 j1 b0", "j0 b0", "j0 j1"),
    ("extreme_asymmetry", "j0 j1 a0", "j0 j1", "j0 j1 b0 b1", "b0 b1", "j0 j1"),
    ("size_imbalance", "j0", "j0", "j0 b0 b1 b2 b3", "j0 b0 b1", "j0"),
    ("disjoint_grains", "j0 j1 a0", "j0 a0", "j0 j1 b0", "j1 b0", "j0 j1"),
    ("identical_grains", "j0 j1 a0", "j0 j1", "j0 j1 b0", "j0 j1", "j0 j1"),
    ("everything_is_jk", "j0 j1", "j0 j1", "j0 j1", "j0 j1", "j0 j1"),
)


def edge_cases(spark: SparkSession) -> DataFrame:
    rows = []
    for no, (name, r1, g1, r2, g2, jk) in enumerate(EDGE_CASES):
        r1, g1, r2, g2, jk = (x.split() for x in (r1, g1, r2, g2, jk))
        left_only = [c for c in r1 if c not in jk]
        rows.append((no, left_only + jk, r2, jk, g1, g2, name))
    return spark.createDataFrame(rows, SCHEMA + ", name string")


# Rows ------------------------------------------------------------------------

def placed_rows(numbers: DataFrame, number: str, n_configs: int) -> DataFrame:
    """Deal rows out to configurations by their number: ``config_id`` and the running number ``i`` in it."""
    return numbers.select(
        (F.col(number) % F.lit(n_configs)).alias("config_id"),
        F.expr(f"{number} div {n_configs}").alias("i"),
    )


def table_rows(
    placed: DataFrame, configs: DataFrame, side: int, fan: int = 2,
    skew_pool: int | None = None,
) -> DataFrame:
    """Rows of one side of every configuration: ``config_id, jkv, vals``, keyed by its grain.

    ``fan`` rows share a join-key value wherever the grain has columns outside
    the key to tell them apart.  Those columns count in base 2, the last
    one without limit; columns outside grain and key depend on the row.
    """
    f, g, rest, inside = (f"r{side}_fields", f"g{side}", f"g{side}_rest", f"g{side}_jk")
    joined = placed.join(configs.select("config_id", f, "jk", rest, inside), "config_id")
    has_rest, has_key = f"size({rest}) > 0", f"size({inside}) > 0"
    if skew_pool is None:
        shared, within = F.expr(f"i div {fan}"), F.expr(f"case when {has_rest} and {has_key} then i % {fan} else i end")
    else:
        shared, within = key_index(F.col("i"), skew_pool, 1), F.col("i")
    numbered = joined.select(
        "config_id", "i", f, "jk", rest,
        F.when(F.expr(has_rest), shared).otherwise(F.col("i")).alias("k"),
        within.alias("m"),
        F.expr("size(jk)").alias("n_jk"), F.expr(f"size({rest})").alias("n_rest"),
    )
    cell = f"""
        transform({f}, (x, p) ->
            case when array_contains(jk, x) then k ^ array_position(jk, x)
                 when array_position({rest}, x) = n_rest then shiftright(m, n_rest - 1) + 1
                 when array_contains({rest}, x) then shiftright(m, cast(array_position({rest}, x) as int) - 1) % 2 + 1
                 else (i + p) * (p + 2) % 31 end)"""
    return numbered.select(
        "config_id",
        F.expr("transform(jk, (x, p) -> k ^ cast(p + 1 as bigint))").alias("jkv"),
        F.expr(cell).alias("vals"),
    )


# Checks ----------------------------------------------------------------------

ROLES = ("f1", "f2", "g1", "g2", "superseded")
_STEP = 1000

#: Keys that a task counts on average, and keys of one configuration at most, where each configuration is counted in one task.
TASK_KEYS, CONFIG_KEYS = 500_000, 1_000_000


def _key_sets(grain: str, fields: str, role: str, wanted: str = "true") -> str:
    """SQL for the positions of a grain and of the grain without each column, numbered by role."""
    at = lambda cols: f"transform({cols}, c -> cast(array_position({fields}, c) as int) - 1)"
    base = ROLES.index(role) * _STEP
    return f"""
        case when {wanted} then concat(
            array(named_struct('no', {base}, 'at', {at(grain)})),
            case when size({grain}) > 1 then
                transform({grain}, (d, p) -> named_struct('no', {base} + p + 1, 'at', {at(f'array_except({grain}, array(d))')}))
            else cast(array() as array<struct<no:int,at:array<int>>>) end)
        else cast(array() as array<struct<no:int,at:array<int>>>) end"""


def with_key_sets(configs: DataFrame, superseded: bool = False) -> DataFrame:
    """Add the column sets to be counted on the left table, the right table and the join."""
    out = configs.withColumn("fields", F.concat("r1_fields", "r2_fields"))
    joined = [_key_sets("f1", "fields", "f1"), _key_sets("f2", "fields", "f2", "f1 != f2")]
    if superseded:
        joined.append(_key_sets("superseded", "fields", "superseded"))
    return out.select(
        "*",
        F.expr(_key_sets("g1", "r1_fields", "g1")).alias("left_sets"),
        F.expr(_key_sets("g2", "r2_fields", "g2")).alias("right_sets"),
        F.expr(f"concat({', '.join(joined)})").alias("join_sets"),
    )


def _tasks(sets: DataFrame, left: DataFrame) -> tuple[int, int]:
    """Tasks for the keys of all sets, and pieces a configuration is cut into; one where the largest fits into a task."""
    per_row = F.expr("2 * size(sets[0]) + size(sets[1]) + size(sets[2])")  # two joined rows and a right one for each left one
    rows = left.groupBy("config_id").agg(F.count(F.lit(1)).alias("n"))
    keys = rows.join(sets, "config_id").agg(F.sum(F.col("n") * per_row), F.max(F.col("n") * per_row))
    total, largest = (x or 0 for x in keys.first())
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_KEYS))
    return tasks, 1 if largest <= CONFIG_KEYS else -(-largest // TASK_KEYS)


def key_counts(
    configs: DataFrame, left: DataFrame, right: DataFrame, superseded: bool = False
) -> DataFrame:
    """Rows and distinct keys of every column set of every configuration: ``config_id, no, n_rows, n_keys``.

    Where every configuration is small, its rows come to one task and only they are shuffled, not their keys; there are
    as many tasks as the keys need.  Else each configuration is cut into pieces, and keys go on as two 64-bit hashes, which
    each task combines before the shuffle.  One small job counts the rows of the configurations for this choice.
    """
    sets = with_key_sets(configs, superseded).select("config_id", F.array("join_sets", "left_sets", "right_sets").alias("sets"))
    joined = left.join(right.withColumnRenamed("vals", "rvals"), ["config_id", "jkv"]).select(
        "config_id", F.concat("vals", "rvals").alias("vals")
    )
    every = (
        joined.withColumn("which", F.lit(0))
        .unionByName(left.select("config_id", "vals", F.lit(1).alias("which")))
        .unionByName(right.select("config_id", "vals", F.lit(2).alias("which")))
    )
    tasks, pieces = _tasks(sets, left)
    if pieces == 1:
        with_sets = every.repartition(tasks, "config_id").join(sets, "config_id")
    else:
        copies = sets.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
        spread = every.withColumn("piece", F.pmod(F.xxhash64("vals"), F.lit(pieces)).cast("int")).repartition(tasks, "config_id", "piece")
        with_sets = spread.join(copies, ["config_id", "piece"])
    keyed = (
        with_sets.select("config_id", "vals", F.explode(F.get("sets", "which")).alias("s"))
        .select("config_id", F.col("s.no").alias("no"), F.expr("transform(s.at, p -> vals[p])").alias("key"))
    )
    names = ["key"]
    if pieces > 1:
        names = ["a", "b"]
        keyed = keyed.select("config_id", "no", F.xxhash64("key").alias("a"), F.xxhash64(F.lit(1), "key").alias("b"))
    per_key = keyed.groupBy("config_id", "no", *names).agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("config_id", "no").agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys")
    )


def per_config(configs: DataFrame, counts: DataFrame, roles: Sequence[str]) -> DataFrame:
    """One row per configuration: for each role its rows, distinct keys and removable columns."""
    cols = []
    for role in roles:
        base = ROLES.index(role) * _STEP
        mine = (F.col("no") >= base) & (F.col("no") < base + _STEP)
        cols += [
            F.max(F.when(F.col("no") == base, F.col("n_rows"))).alias(f"{role}_rows"),
            F.max(F.when(F.col("no") == base, F.col("n_keys"))).alias(f"{role}_keys"),
            F.count_if(
                mine & (F.col("no") > base) & (F.col("n_keys") == F.col("n_rows")) & (F.col("n_rows") > 1)
            ).alias(f"{role}_removable"),
        ]
    facts = configs.join(counts.groupBy("config_id").agg(*cols), "config_id", "left")
    same = F.col("f1") == F.col("f2")
    for what in ("rows", "keys", "removable"):
        facts = facts.withColumn(f"f2_{what}", F.when(same, F.col(f"f1_{what}")).otherwise(F.col(f"f2_{what}")))
        for role in roles:
            facts = facts.withColumn(f"{role}_{what}", F.coalesce(f"{role}_{what}", F.lit(0)))
    return facts


def check_properties(configs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The six properties of every configuration, each ``pass``, ``fail`` or ``inconclusive``."""
    facts = per_config(configs, key_counts(configs, left, right), ("f1", "f2", "g1", "g2"))
    few = F.col("f1_rows") <= 1
    inputs = (F.col("g1_removable") == 0) & (F.col("g2_removable") == 0)
    by_rel = lambda for_super, other: F.when(F.col("jk_rel") == "proper_superset", F.col(for_super)).otherwise(F.col(other))
    convention_removable = F.when(F.col("convention") == F.col("f1"), F.col("f1_removable")).otherwise(F.col("f2_removable"))
    wrong_removable = by_rel("f1_removable", "f2_removable")
    wrong_size = F.when(F.col("jk_rel") == "proper_superset", F.size("f1")).otherwise(F.size("f2"))
    both = (F.col("f1_removable") == 0) & (F.col("f2_removable") == 0)
    result = lambda passes, otherwise: F.when(passes, "pass").otherwise(otherwise)
    return facts.select(
        "config_id", "jk_rel", "g1e", "g2e", F.col("f1_rows").alias("n_rows"),
        result(
            (F.col("f1_rows") == F.col("f1_keys")) & (F.col("f2_rows") == F.col("f2_keys")), "fail"
        ).alias("p1"),
        result((F.size("convention") <= 1) | few | (inputs & (convention_removable == 0)), "inconclusive").alias("p2"),
        result(
            ~F.col("jk_rel").isin("proper_subset", "proper_superset") | (wrong_size <= 1) | few | (wrong_removable > 0),
            "fail",
        ).alias("p3"),
        result((F.col("jk_rel") != "incomparable") | few | (inputs & both), "inconclusive").alias("p4"),
        result(F.size("f1") - F.size("f2") == F.size("g1_jk") - F.size("g2_jk"), "fail").alias("p5"),
        result(F.size("convention") <= F.least(F.size("f1"), F.size("f2")), "fail").alias("p6"),
    )


PROPERTIES = ("p1", "p2", "p3", "p4", "p5", "p6")


def by_class(checked: DataFrame) -> DataFrame:
    """Results per class of configuration."""
    cols = [F.count(F.lit(1)).alias("n_configs"), F.sum("n_rows").cast("long").alias("n_rows")]
    for p in PROPERTIES:
        cols += [F.count_if(F.col(p) == r).alias(f"{p}_{r}") for r in ("pass", "fail", "inconclusive")]
    return checked.groupBy("jk_rel", "g1e", "g2e").agg(*cols)


def sweep(
    numbers: DataFrame, number: str, configs: DataFrame, n_configs: int, fan: int = 2, skew_pool: int | None = None
) -> DataFrame:
    """Deal the rows of a table to all configurations and check every property of each."""
    derived = derive(configs)
    placed = placed_rows(numbers, number, n_configs)
    left, right = (table_rows(placed, derived, side, fan, skew_pool) for side in (1, 2))
    return check_properties(derived, left, right)


def compare_formulas(configs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The older two-case formula beside the present one: unique? minimal? which columns can go?

    ``configs`` comes from ``derive``; further columns of it are kept.
    """
    roles = ("f1", "f2", "g1", "g2", "superseded")
    counts = key_counts(configs, left, right, True)
    facts = per_config(configs, counts, roles)
    base = ROLES.index("superseded") * _STEP
    gone = counts.filter(
        (F.col("no") > base) & (F.col("n_keys") == F.col("n_rows")) & (F.col("n_rows") > 1)
    ).groupBy("config_id").agg(F.sort_array(F.collect_list(F.col("no") - base)).alias("gone"))
    first = F.col("convention") == F.col("f1")
    new = lambda what: F.when(first, F.col(f"f1_{what}")).otherwise(F.col(f"f2_{what}"))
    return facts.join(gone, "config_id", "left").select(
        *configs.columns,
        F.col("f1_rows").alias("result_rows"),
        (F.col("superseded_keys") == F.col("superseded_rows")).alias("old_unique"),
        (F.col("superseded_removable") == 0).alias("old_minimal"),
        F.coalesce(F.expr("transform(gone, p -> superseded[p - 1])"), F.expr("cast(array() as array<string>)")).alias("old_removable"),
        (new("keys") == new("rows")).alias("new_unique"),
        (new("removable") == 0).alias("new_minimal"),
    )


def formula_summary(compared: DataFrame, by: Sequence[str]) -> DataFrame:
    return compared.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_examples"),
        F.sum("result_rows").cast("long").alias("result_rows"),
        F.count_if("old_unique").alias("old_unique"),
        F.count_if("old_minimal").alias("old_minimal"),
        F.count_if("new_unique").alias("new_unique"),
        F.count_if("new_minimal").alias("new_minimal"),
    )
