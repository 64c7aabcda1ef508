"""Join examples in families: 350 with key columns of many sizes, and 100 worked ones.

Each example is a configuration (see ``sweep``) plus the number of values of
its key columns.  The sizes come from one rule per family.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowgrain.plans.sweep import SCHEMA

#: Sizes a key column can have; the first column of a left key has no limit, so that no row is lost.
SIZES = (2, 3, 4)


def _sizes(n_columns: int, count: int) -> list[tuple[int, ...]]:
    """The first ``count`` size combinations, from few rows to many."""
    combos = sorted(product(SIZES, repeat=n_columns), key=lambda c: (max(c), c))
    return [combos[i % len(combos)] for i in range(count)]


def _family(category, case, count, r1, g1, r2, g2, jk, sizes=None):
    """Examples of one shape; left sizes for its grain, right sizes for key columns outside the join key."""
    r1, g1, r2, g2, jk = (x.split() for x in (r1, g1, r2, g2, jk))
    extra = [c for c in g2 if c not in jk]
    for drawn in sizes or _sizes(len(g1) + len(extra), count):
        yield category, case, r1, r2, jk, g1, g2, list(drawn[: len(g1)]), list(drawn[len(g1): len(g1) + len(extra)])


def _equal_grains():
    """Equal grains of one to four columns, joined on the first ones of them."""
    shapes = [(n, m) for n in range(1, 5) for m in range(1, n + 1)]
    for no in range(50):
        n, m = shapes[no % len(shapes)]
        shared = [f"g{i}" for i in range(1, m + 1)]
        side = lambda s: shared + [f"g{i}{s}" for i in range(m + 1, n + 1)]
        g1, g2 = side("_r1"), side("_r2")
        sizes = _sizes(n, 50)[no]
        left = list(sizes)
        yield "equal grains", "A", g1 + ["v1"], g2 + ["v2"], shared, g1, g2, left, left[m:]


def build() -> list[tuple]:
    # Shapes of the nine families, and how many examples each has.
    rows = [
        *_family("main", "B", 50, "a b c e", "a c", "a b c d", "a b", "a b c"),
        *_family("incomparable", "B", 50, "a b c v1", "a c", "a b d v2", "b d", "a b"),
        *_family("natural", "B", 50, "a b c", "a b", "b c d", "c d", "b c"),
        *_family("main", "A", 30, "a b v1", "a", "a b v2", "a b", "a b"),
        *_equal_grains(),
        *_family("ordered", "A", 25, "g1 g2 v1", "g1 g2", "g1 v2", "g1", "g1"),
        *_family("ordered", "A", 30, "g1 v1", "g1", "g1 g2 v2", "g1 g2", "g1"),
        *_family("incomparable", "A", 30, "a b c v1", "a b c", "a b d v2", "a b d", "a b"),
        *_family("natural", "A", 35, "a b c", "a b", "b c d", "b c", "b c"),
    ]
    return _numbered(rows)


# Fifteen worked shapes, as (category, case, R1, G1, R2, G2, join key).
WORKED = (
    ("main", "A", "account customer", "account", "customer address text", "customer address", "customer"),
    ("main", "B", "a b c e", "a c", "a b c d", "a b", "a b c"),
    ("main", "A", "a b c_r1", "a b", "b c_r2 d", "c_r2 d", "b"),
    ("equal grains", "A", "customer name", "customer", "customer tier", "customer", "customer"),
    ("equal grains", "A", "customer region name", "customer region", "customer segment label", "customer segment", "customer"),
    ("equal grains", "A", "customer region product", "customer region", "order date customer product", "order date", "customer product"),
    ("equal grains", "A", "customer_r1 email", "customer_r1", "customer_r2 email points", "customer_r2", "email"),
    ("ordered", "A", "order line amount", "order line", "order status", "order", "order"),
    ("ordered", "A", "order line_r1 product", "order line_r1 product", "order line_r2 discount", "order line_r2", "order"),
    ("ordered", "A", "order line customer", "order line", "order date customer", "order date", "order customer"),
    ("ordered", "A", "order_r1 line customer", "order_r1 line", "order_r2 customer date", "order_r2", "customer"),
    ("incomparable", "A", "customer channel date", "customer channel date", "customer product date", "customer product date", "customer date"),
    ("incomparable", "A", "sale product store", "sale product store", "product store category", "product store category", "product store"),
    ("natural", "A", "customer name region", "customer region", "customer region segment", "customer region", "customer region"),
    ("natural", "B", "a b c", "a b", "b c d", "c d", "b c"),
)


def build_worked() -> list[tuple]:
    """The fifteen worked shapes and 85 more of their kinds."""
    # In case A the last column goes round the other columns (60) twice, so that keys share a join value.
    wide = {1: (1,), 2: (1, 120), 3: (1, 2, 120)}
    rows = []
    for cat, case, *shape in WORKED:
        sizes = [wide[len(shape[1].split())] + (5,) * len(shape[3].split())] if case == "A" else None
        rows += _family(cat, case, 1, *shape, sizes=sizes)
    rows += [
        *_family("main", "A", 7, "a b c", "a b", "a b d", "a b d", "a b"),
        *_family("main", "B", 8, "a b c", "a c", "a b c d", "b c", "a b c"),
        *list(_equal_grains())[:20],
        *_family("ordered", "A", 10, "g1 g2 v1", "g1 g2", "g1 v2", "g1", "g1"),
        *_family("ordered", "A", 10, "g1 v1", "g1", "g1 g2 v2", "g1 g2", "g1"),
        *_family("incomparable", "A", 7, "a b c v1", "a b c", "a b d v2", "a b d", "a b"),
        *_family("incomparable", "B", 8, "a b c v1", "a c", "a b d v2", "b d", "a b"),
        *_family("natural", "A", 7, "a b c", "a b", "a b d", "a b", "a b"),
        *_family("natural", "B", 8, "a b c", "a b", "b c d", "c d", "b c"),
    ]
    return _numbered(rows)


def _numbered(rows) -> list[tuple]:
    return [(no, r1, r2, jk, g1, g2, cat, case, ls, rs) for no, (cat, case, r1, r2, jk, g1, g2, ls, rs) in enumerate(rows)]


def examples(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(
        build() if rows is None else rows,
        SCHEMA + ", category string, case_type string, left_sizes array<int>, right_sizes array<int>",
    )


def left_rows(placed: DataFrame, derived: DataFrame) -> DataFrame:
    """Left rows: the key counts through its sizes, its first column without limit, so every row has a key of its own.

    Columns outside the key repeat after 60 rows, a multiple of all sizes, so
    that they tell the limited key columns but not the unlimited one.
    """
    cols = derived.select("config_id", "r1_fields", "jk", "g1", "left_sizes")
    digits = """
        transform(left_sizes, (s, p) ->
            i div aggregate(slice(left_sizes, p + 2, size(left_sizes)), 1L, (acc, x) -> acc * x)
            % case when p = 0 then 9223372036854775807 else s end)"""
    firsts = placed.join(cols, "config_id").select("config_id", F.expr(digits).alias("key"), "i")
    cell = """
        transform(r1_fields, (x, p) ->
            case when array_contains(g1, x) then key[cast(array_position(g1, x) as int) - 1]
                 else (i + p) % 60 end)"""
    return (
        firsts.join(cols, "config_id")
        .withColumn("vals", F.expr(cell))
        .select("config_id", F.expr("transform(jk, x -> vals[cast(array_position(r1_fields, x) as int) - 1])").alias("jkv"), "vals")
    )


def right_rows(left: DataFrame, derived: DataFrame) -> DataFrame:
    """Right rows made from the left join keys: one per right key part, times a series per further key column."""
    cols = derived.select("config_id", "r2_fields", "jk", "g2_jk", "g2_rest", "right_sizes")
    inside = "transform(g2_jk, x -> jkv[cast(array_position(jk, x) as int) - 1])"
    base = (
        left.join(cols, "config_id").groupBy("config_id", F.expr(inside).alias("inside")).agg(F.min("jkv").alias("jkv"))
    )
    number = "explode(sequence(0L, aggregate(right_sizes, 1L, (acc, x) -> acc * x) - 1))"
    cell = """
        transform(r2_fields, (x, p) ->
            case when array_contains(jk, x) then jkv[cast(array_position(jk, x) as int) - 1]
                 when array_contains(g2_rest, x) then
                    e div aggregate(slice(right_sizes, cast(array_position(g2_rest, x) as int) + 1, size(right_sizes)), 1L, (acc, y) -> acc * y)
                    % right_sizes[cast(array_position(g2_rest, x) as int) - 1]
                 else (e + jkv[0]) * (p + 2) % 31 end)"""
    return (
        base.join(cols, "config_id").withColumn("e", F.expr(number))
        .select("config_id", "jkv", F.expr(cell).alias("vals"))
    )
