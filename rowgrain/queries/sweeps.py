"""Thousands of join configurations, with rows dealt out from the given tables.

The SQL beside each query works on bit masks instead of name lists: bit ``p`` of
a mask stands for column ``p``, and the result's columns are numbered join key
first, then left columns, then right ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowgrain.functions import grainsets as gs
from rowgrain.plans import examples as ex
from rowgrain.plans import sweep as sw
from rowgrain.queries.catalog import query, raw
from rowgrain.sources.generate import dense_partner, key_index, key_value, keyed_rows

MAX_SIZE = 5


# Configurations drawn from rows ----------------------------------------------

_DRAWN = """
    n AS (SELECT o_orderkey % 1000003 AS n FROM orders),
    d AS (SELECT n * 31 % 1009 % 8 + 1 AS n_jk, n * 37 % 2003 % 8 AS n_left, n * 41 % 3001 % 8 AS n_right,
                 n * 7919 % 1000033 AS d1, n * 104729 % 1000037 AS d2 FROM n),
    c AS (SELECT *, d1 % ((1::BIGINT << (n_jk + n_left)) - 1) + 1 AS g1_mask, d2 % ((1::BIGINT << (n_jk + n_right)) - 1) + 1 AS g2_mask FROM d)"""

_PARTS = """
    p AS (SELECT *, g1_mask >> n_left AS k1, g1_mask & ((1::BIGINT << n_left) - 1) AS rest1,
                 g2_mask & ((1::BIGINT << n_jk) - 1) AS k2, g2_mask >> n_jk AS rest2 FROM c),
    t AS (SELECT *, CASE WHEN k1 = k2 THEN 'equal' WHEN k1 & k2 = k1 THEN 'proper_subset' WHEN k1 & k2 = k2 THEN 'proper_superset'
                         ELSE 'incomparable' END AS jk_rel, rest1 = 0 AS g1e, rest2 = 0 AS g2e,
                 k1 | (rest1 << n_jk) | (rest2 << (n_jk + n_left)) AS f1, k2 | (rest1 << n_jk) | (rest2 << (n_jk + n_left)) AS f2 FROM p),
    u AS (SELECT *, CASE WHEN jk_rel = 'proper_superset' OR (jk_rel = 'incomparable' AND bit_count(f2) < bit_count(f1)) THEN f2 ELSE f1 END AS conv,
                 CASE WHEN jk_rel = 'incomparable' THEN f1 | f2 ELSE f1 & f2 END AS old FROM t)"""


def _drawn(spark, sf):
    orders = raw(spark, sf, "orders").select(F.col("o_orderkey").alias("config_id"))
    return sw.random_configs(orders, "config_id")


@query("i5_derive", f"""
    WITH {_DRAWN}, {_PARTS}
    SELECT jk_rel, g1e, g2e, COUNT(*) AS n, CAST(SUM(bit_count(f1)) AS BIGINT) AS f1_columns, CAST(SUM(bit_count(f2)) AS BIGINT) AS f2_columns,
           CAST(SUM(bit_count(conv)) AS BIGINT) AS grain_columns, CAST(SUM(bit_count(old)) AS BIGINT) AS old_columns
    FROM u GROUP BY 1, 2, 3""")
def i5_derive(spark, sf):
    size = lambda c, n: F.sum(F.size(c)).cast("long").alias(n)
    return sw.derive(_drawn(spark, sf)).groupBy("jk_rel", "g1e", "g2e").agg(
        F.count(F.lit(1)).alias("n"), size("f1", "f1_columns"), size("f2", "f2_columns"),
        size("convention", "grain_columns"), size("superseded", "old_columns"),
    )


@query("x2_random_sizes", f"""
    WITH {_DRAWN} SELECT n_jk + n_left + n_right AS n_columns, COUNT(*) AS n FROM c GROUP BY 1""")
def x2_random_sizes(spark, sf):
    total = (F.size("r1_fields") + F.size("r2_fields") - F.size("jk")).cast("long")
    return _drawn(spark, sf).groupBy(total.alias("n_columns")).agg(F.count(F.lit(1)).alias("n"))


@query("g_set_algebra", f"""
    WITH {_DRAWN}, {_PARTS},
         s AS (SELECT k1 | (rest1 << n_jk) AS a, k2 | (rest2 << (n_jk + n_left)) AS b FROM t)
    SELECT CASE WHEN a = b THEN 'equal' WHEN a & b = b THEN 'finer' WHEN a & b = a THEN 'coarser' ELSE 'incomparable' END AS order_is,
           COUNT(*) AS n, CAST(SUM(bit_count(a | b)) AS BIGINT) AS meet_columns, CAST(SUM(bit_count(a & b)) AS BIGINT) AS common_columns,
           CAST(SUM(bit_count(a & ~b)) AS BIGINT) AS left_only, CAST(SUM(bit_count(xor(a, b))) AS BIGINT) AS differing,
           COUNT(*) FILTER (WHERE a & b = 0) AS n_disjoint FROM s GROUP BY 1""")
def g_set_algebra(spark, sf):
    size = lambda c, n: F.sum(F.size(c)).cast("long").alias(n)
    return _drawn(spark, sf).groupBy(gs.compare("g1", "g2").alias("order_is")).agg(
        F.count(F.lit(1)).alias("n"), size(gs.union("g1", "g2"), "meet_columns"), size(gs.intersection("g1", "g2"), "common_columns"),
        size(gs.difference("g1", "g2"), "left_only"), size(gs.symmetric_difference("g1", "g2"), "differing"),
        F.count_if(gs.disjoint("g1", "g2")).alias("n_disjoint"),
    )


# All properties over configured rows -----------------------------------------

def _cells(bits, rest, start, m):
    """Values of the columns of one side outside the join key, from row number ``i``."""
    rank = f"bit_count({rest} & ((1::BIGINT << q) - 1))"
    return f"""list_transform(range({bits}), lambda q: CASE
        WHEN ({rest} >> q) & 1 = 0 THEN (i + q + {start}) * (q + {start} + 2) % 31
        WHEN {rank} = bit_count({rest}) - 1 THEN ({m} >> {rank}) + 1 ELSE ({m} >> {rank}) % 2 + 1 END)"""


def _sweep_sql(configs, n_configs, final):
    return f"""
    WITH {configs}, {_PARTS},
    placed AS (SELECT o_orderkey % {n_configs} AS config_id, o_orderkey // {n_configs} AS i FROM orders),
    l0 AS (SELECT u.*, i, CASE WHEN rest1 <> 0 THEN i // 2 ELSE i END AS k, CASE WHEN rest1 <> 0 AND k1 <> 0 THEN i % 2 ELSE i END AS m
           FROM placed JOIN u USING (config_id)),
    l AS (SELECT *, {_cells('n_left', 'rest1', '0', 'm')} AS av FROM l0),
    r0 AS (SELECT u.*, i, CASE WHEN rest2 <> 0 THEN i // 2 ELSE i END AS k, CASE WHEN rest2 <> 0 AND k2 <> 0 THEN i % 2 ELSE i END AS m
           FROM placed JOIN u USING (config_id)),
    r AS (SELECT *, {_cells('n_right', 'rest2', 'n_jk', 'm')} AS bv FROM r0),
    jv AS (SELECT DISTINCT config_id, n_jk, k, list_transform(range(n_jk), lambda q: xor(k, q + 1)) AS v FROM (SELECT config_id, n_jk, k FROM l UNION SELECT config_id, n_jk, k FROM r)),
    cells AS (
        SELECT 'j' AS side, config_id, list_concat(list_concat(v, av), bv) AS v FROM l JOIN r USING (config_id, k) JOIN jv USING (config_id, k)
        UNION ALL SELECT 'l', config_id, list_concat(v, av) FROM l JOIN jv USING (config_id, k)
        UNION ALL SELECT 'r', config_id, list_concat(v, bv) FROM r JOIN jv USING (config_id, k)),
    wholes AS (
        SELECT config_id, 'f1' AS role, 'j' AS side, f1 AS mask FROM u UNION ALL SELECT config_id, 'f2', 'j', f2 FROM u
        UNION ALL SELECT config_id, 'g1', 'l', k1 | (rest1 << n_jk) FROM u UNION ALL SELECT config_id, 'g2', 'r', k2 | (rest2 << n_jk) FROM u),
    sets AS (
        SELECT config_id, role, side, -1 AS gone, mask FROM wholes
        UNION ALL SELECT config_id, role, side, q, mask & ~(1::BIGINT << q) FROM (SELECT *, unnest(range(24)) AS q FROM wholes)
                  WHERE (mask >> q) & 1 = 1 AND bit_count(mask) > 1),
    counted AS (
        SELECT config_id, role, gone, COUNT(*) AS n, COUNT(DISTINCT list_transform(range(len(v)), lambda q: CASE WHEN (mask >> q) & 1 = 1 THEN v[q + 1] END)) AS keys
        FROM sets JOIN cells USING (config_id, side) GROUP BY 1, 2, 3),
    facts AS (
        SELECT config_id, {', '.join(f"MAX(n) FILTER (WHERE role = '{x}' AND gone = -1) AS {x}_n, MAX(keys) FILTER (WHERE role = '{x}' AND gone = -1) AS {x}_keys, COUNT(*) FILTER (WHERE role = '{x}' AND gone >= 0 AND keys = n AND n > 1) AS {x}_gone" for x in ('f1', 'f2', 'g1', 'g2'))}
        FROM counted GROUP BY 1),
    b AS (SELECT u.*, COALESCE(f1_n, 0) AS n_rows, COALESCE(f1_n, 0) = COALESCE(f1_keys, 0) AND COALESCE(f2_n, 0) = COALESCE(f2_keys, 0) AS uniq,
                 COALESCE(g1_gone, 0) = 0 AND COALESCE(g2_gone, 0) = 0 AS inputs, COALESCE(f1_gone, 0) AS f1_gone, COALESCE(f2_gone, 0) AS f2_gone
          FROM u LEFT JOIN facts USING (config_id)),
    v AS (SELECT config_id, jk_rel, g1e, g2e, n_rows,
            CASE WHEN uniq THEN 'pass' ELSE 'fail' END AS p1,
            CASE WHEN bit_count(conv) <= 1 OR n_rows <= 1 OR (inputs AND CASE WHEN conv = f1 THEN f1_gone ELSE f2_gone END = 0) THEN 'pass' ELSE 'inconclusive' END AS p2,
            CASE WHEN jk_rel NOT IN ('proper_subset', 'proper_superset') OR bit_count(CASE WHEN jk_rel = 'proper_superset' THEN f1 ELSE f2 END) <= 1
                 OR n_rows <= 1 OR CASE WHEN jk_rel = 'proper_superset' THEN f1_gone ELSE f2_gone END > 0 THEN 'pass' ELSE 'fail' END AS p3,
            CASE WHEN jk_rel <> 'incomparable' OR n_rows <= 1 OR (inputs AND f1_gone = 0 AND f2_gone = 0) THEN 'pass' ELSE 'inconclusive' END AS p4,
            CASE WHEN bit_count(f1) - bit_count(f2) = bit_count(k1) - bit_count(k2) THEN 'pass' ELSE 'fail' END AS p5,
            CASE WHEN bit_count(conv) <= bit_count(f1) AND bit_count(conv) <= bit_count(f2) THEN 'pass' ELSE 'fail' END AS p6 FROM b)
    {final}"""


_ALL = f"""
    s AS (SELECT j.n AS n_jk, a.n AS n_left, b.n AS n_right, ((1::BIGINT << (j.n + a.n)) - 1) AS m1, ((1::BIGINT << (j.n + b.n)) - 1) AS m2
          FROM range(1, {MAX_SIZE + 1}) j(n), range({MAX_SIZE}) a(n), range({MAX_SIZE}) b(n) WHERE j.n + a.n <= {MAX_SIZE} AND j.n + b.n <= {MAX_SIZE}),
    o AS (SELECT *, CAST(SUM(m1 * m2) OVER (ORDER BY n_jk, n_left, n_right) - m1 * m2 AS BIGINT) AS first_id FROM s),
    m AS (SELECT *, unnest(range(1, m1 + 1)) AS g1_mask FROM o),
    c AS (SELECT n_jk, n_left, n_right, g1_mask, g2_mask, first_id + (g1_mask - 1) * m2 + g2_mask - 1 AS config_id FROM (SELECT *, unnest(range(1, m2 + 1)) AS g2_mask FROM m))"""

_COUNTS = ", ".join(
    f"COUNT(*) FILTER (WHERE {p} = '{r}') AS {p}_{r}" for p in sw.PROPERTIES for r in ("pass", "fail", "inconclusive")
)
N_ALL = sw.count_configs(MAX_SIZE)


@query("x5_sweep_all", _sweep_sql(
    _ALL, N_ALL, f"SELECT jk_rel, g1e, g2e, COUNT(*) AS n_configs, CAST(SUM(n_rows) AS BIGINT) AS n_rows, {_COUNTS} FROM v GROUP BY 1, 2, 3"))
def x5_sweep_all(spark, sf):
    """Every configuration up to five columns per table."""
    orders = raw(spark, sf, "orders").select("o_orderkey")
    return sw.by_class(sw.sweep(orders, "o_orderkey", sw.all_configs(spark, MAX_SIZE), N_ALL))


def _edge_masks():
    rows = []
    for no, (_, r1, g1, r2, g2, jk) in enumerate(sw.EDGE_CASES):
        r1, g1, r2, g2, jk = (x.split() for x in (r1, g1, r2, g2, jk))
        left = [c for c in r1 if c not in jk] + jk
        mask = lambda cols, g: sum(1 << p for p, c in enumerate(cols) if c in g)
        rows.append(f"({no}::BIGINT, {len(jk)}, {len(left) - len(jk)}, {len(r2) - len(jk)}, {mask(left, g1)}::BIGINT, {mask(r2, g2)}::BIGINT)")
    return f"c AS (SELECT * FROM (VALUES {', '.join(rows)}) x(config_id, n_jk, n_left, n_right, g1_mask, g2_mask))"


@query("x4_edge_cases", _sweep_sql(_edge_masks(), len(sw.EDGE_CASES), "SELECT * FROM v"))
def x4_edge_cases(spark, sf):
    """The boundary shapes, each with its share of all orders."""
    orders = raw(spark, sf, "orders").select("o_orderkey")
    return sw.sweep(orders, "o_orderkey", sw.edge_cases(spark), len(sw.EDGE_CASES))


N_RANDOM = 10_000
_RANDOM = f"""
    n AS (SELECT range AS config_id, range % 1000003 AS n FROM range({N_RANDOM})),
    d AS (SELECT config_id, n * 31 % 1009 % 8 + 1 AS n_jk, n * 37 % 2003 % 8 AS n_left, n * 41 % 3001 % 8 AS n_right,
                 n * 7919 % 1000033 AS d1, n * 104729 % 1000037 AS d2 FROM n),
    c AS (SELECT *, d1 % ((1::BIGINT << (n_jk + n_left)) - 1) + 1 AS g1_mask, d2 % ((1::BIGINT << (n_jk + n_right)) - 1) + 1 AS g2_mask FROM d)"""


@query("x5_sweep_random", _sweep_sql(
    _RANDOM, N_RANDOM, f"SELECT jk_rel, g1e, g2e, COUNT(*) AS n_configs, CAST(SUM(n_rows) AS BIGINT) AS n_rows, {_COUNTS} FROM v GROUP BY 1, 2, 3"))
def x5_sweep_random(spark, sf):
    """Random configurations of up to 22 columns, with all orders dealt out to them."""
    orders = raw(spark, sf, "orders").select("o_orderkey")
    configs = sw.random_configs(spark.range(N_RANDOM).withColumnRenamed("id", "config_id"), "config_id")
    return sw.by_class(sw.sweep(orders, "o_orderkey", configs, N_RANDOM))


# Both join formulas compared -------------------------------------------------

def _list(items, kind):
    return "[" + ", ".join(f"'{x}'" if kind == "s" else str(x) for x in items) + "]" + ("::VARCHAR[]" if kind == "s" else "::BIGINT[]")


def _example_values(rows):
    return ", ".join(
        f"({no}, {_list(r1, 's')}, {_list(r2, 's')}, {_list(jk, 's')}, {_list(g1, 's')}, {_list(g2, 's')}, '{cat}', '{case}', {_list(ls, 'n')}, {_list(rs, 'n')})"
        for no, r1, r2, jk, g1, g2, cat, case, ls, rs in rows
    )


_MINUS = "list_filter({a}, lambda x: NOT list_contains({b}, x))".format
_BOTH = "list_filter({a}, lambda x: list_contains({b}, x))".format
_PLUS = lambda a, b: f"list_sort(list_distinct(list_concat({a}, {b})))"
_TAIL = lambda lst, p: f"CAST(list_aggregate(list_concat([1::BIGINT], {lst}[{p}:]), 'product') AS BIGINT)"


def _formula_sql(rows):
    return f"""
    WITH c AS (SELECT * FROM (VALUES {_example_values(rows)}) x(config_id, r1, r2, jk, g1, g2, category, case_type, ls, rs)),
    d AS (SELECT *, {_BOTH(a='g1', b='jk')} AS p1, {_BOTH(a='g2', b='jk')} AS p2, {_MINUS(a='g1', b='jk')} AS o1, {_MINUS(a='g2', b='jk')} AS o2 FROM c),
    e AS (SELECT *, {_PLUS('g1', 'o2')} AS f1, {_PLUS('g2', 'o1')} AS f2, len({_MINUS(a='p1', b='p2')}) AS d12, len({_MINUS(a='p2', b='p1')}) AS d21 FROM d),
    u AS (SELECT *, CASE WHEN (d12 > 0 AND d21 = 0) OR (d12 > 0 AND d21 > 0 AND len(f2) < len(f1)) THEN f2 ELSE f1 END AS newer,
            CASE WHEN d12 = 0 OR d21 = 0 THEN {_PLUS(_PLUS('o1', 'o2'), _BOTH(a='p1', b='p2'))} ELSE {_PLUS(_PLUS('o1', 'o2'), _PLUS('p1', 'p2'))} END AS older FROM e),
    placed AS (SELECT o_orderkey % {len(rows)} AS config_id, o_orderkey // {len(rows)} AS i FROM orders),
    l0 AS (SELECT config_id, list_transform(range(1, len(ls) + 1), lambda p: i // {_TAIL('ls', 'p + 1')} % CASE WHEN p = 1 THEN 9223372036854775807 ELSE ls[p] END) AS key, i FROM placed JOIN u USING (config_id)),
    l1 AS (SELECT config_id, list_transform(range(1, len(r1) + 1), lambda p: CASE WHEN list_contains(g1, r1[p]) THEN key[list_position(g1, r1[p])]
             ELSE (i + p - 1) % 60 END) AS lv, r1, jk FROM l0 JOIN u USING (config_id)),
    l AS (SELECT config_id, lv, list_transform(jk, lambda x: lv[list_position(r1, x)]) AS jkv FROM l1),
    r0 AS (SELECT config_id, list_transform(list_sort(p2), lambda x: jkv[list_position(jk, x)]) AS inside, MIN(jkv) AS jkv FROM l JOIN u USING (config_id) GROUP BY 1, 2),
    r1_ AS (SELECT r0.config_id, jkv, jk, r2, list_sort(o2) AS o2, rs, unnest(range({_TAIL('rs', '1')})) AS e FROM r0 JOIN u USING (config_id)),
    r AS (SELECT config_id, jkv, list_transform(range(1, len(r2) + 1), lambda p: CASE WHEN list_contains(jk, r2[p]) THEN jkv[list_position(jk, r2[p])]
             WHEN list_contains(o2, r2[p]) THEN e // {_TAIL('rs', 'list_position(o2, r2[p]) + 1')} % rs[list_position(o2, r2[p])]
             ELSE (e + jkv[1]) * (p + 1) % 31 END) AS rv FROM r1_),
    j AS (SELECT config_id, list_concat(lv, rv) AS v FROM l JOIN r USING (config_id, jkv)),
    wholes AS (SELECT config_id, 'old' AS role, older AS cols, list_concat(r1, r2) AS fields FROM u UNION ALL SELECT config_id, 'new', newer, list_concat(r1, r2) FROM u),
    sets AS (SELECT config_id, role, NULL AS gone, cols, fields FROM wholes
             UNION ALL SELECT config_id, role, g, list_filter(cols, lambda x: x <> g), fields FROM (SELECT *, unnest(cols) AS g FROM wholes WHERE len(cols) > 1)),
    counted AS (SELECT config_id, role, gone, COUNT(*) AS n, COUNT(DISTINCT list_transform(cols, lambda x: v[list_position(fields, x)])) AS keys FROM sets JOIN j USING (config_id) GROUP BY 1, 2, 3),
    facts AS (SELECT config_id, MAX(n) AS n,
                MAX(keys) FILTER (WHERE role = 'old' AND gone IS NULL) AS old_keys, COUNT(*) FILTER (WHERE role = 'old' AND gone IS NOT NULL AND keys = n AND n > 1) AS old_gone,
                MAX(keys) FILTER (WHERE role = 'new' AND gone IS NULL) AS new_keys, COUNT(*) FILTER (WHERE role = 'new' AND gone IS NOT NULL AND keys = n AND n > 1) AS new_gone
              FROM counted GROUP BY 1)
    SELECT category, case_type, COUNT(*) AS n_examples, CAST(SUM(COALESCE(n, 0)) AS BIGINT) AS result_rows,
           COUNT(*) FILTER (WHERE COALESCE(old_keys = n, TRUE)) AS old_unique, COUNT(*) FILTER (WHERE COALESCE(old_gone, 0) = 0) AS old_minimal,
           COUNT(*) FILTER (WHERE COALESCE(new_keys = n, TRUE)) AS new_unique, COUNT(*) FILTER (WHERE COALESCE(new_gone, 0) = 0) AS new_minimal
    FROM u LEFT JOIN facts USING (config_id) GROUP BY 1, 2"""


def _formulas(spark, sf, rows):
    """Both formulas on examples whose left rows are counted from order numbers."""
    derived, n = sw.derive(ex.examples(spark, rows)), len(rows)
    placed = sw.placed_rows(raw(spark, sf, "orders").select("o_orderkey"), "o_orderkey", n)
    left = ex.left_rows(placed, derived)
    compared = sw.compare_formulas(derived, left, ex.right_rows(left, derived))
    return sw.formula_summary(compared, ["category", "case_type"])


@query("v6_compare_formulas", _formula_sql(ex.build()))
def v6_compare_formulas(spark, sf):
    return _formulas(spark, sf, ex.build())


@query("x6_worked_examples", _formula_sql(ex.build_worked()))
def x6_worked_examples(spark, sf):
    return _formulas(spark, sf, ex.build_worked())


# Counters --------------------------------------------------------------------

@query("s8_keyed_counter", """
    SELECT n // 143 + 1 AS a, n // 13 % 11 + 1 AS b, n % 13 + 1 AS c, MIN(n) AS first_number
    FROM (SELECT o_orderkey AS n FROM orders) GROUP BY 1, 2, 3""")
def s8_keyed_counter(spark, sf):
    numbers = raw(spark, sf, "orders")
    return keyed_rows(numbers, "o_orderkey", ["a", "b", "c"], [None, 11, 13], first_number=F.col("o_orderkey"))


@query("s9_dense_partner", """
    WITH l AS (SELECT o_custkey AS a, o_orderkey AS c, o_orderkey % 31 AS b FROM orders),
         r AS (SELECT b, a, d FROM (SELECT DISTINCT b, a FROM l) CROSS JOIN (VALUES (1), (2), (3)) s(d)),
         j AS (SELECT l.a, l.b, c, d FROM l JOIN r ON l.a = r.a AND l.b = r.b)
    SELECT COUNT(*) AS n_rows, COUNT(DISTINCT (a, c, d)) AS n_keys, (SELECT COUNT(*) FROM r) AS n_right FROM j""")
def s9_dense_partner(spark, sf):
    """A right table made to meet every order by customer and a part of its number, and their join on its grain."""
    orders = raw(spark, sf, "orders")
    left = orders.select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("c"), (F.col("o_orderkey") % 31).alias("b"))
    right = dense_partner(left, ["a", "b"], ["a", "b", "d"], {"d": 3})
    n = right.groupBy("b", "a").agg(F.count(F.lit(1)).alias("n_right"))
    joined = left.join(right, ["a", "b"]).groupBy("a", "c", "d").agg(F.count(F.lit(1)).alias("n"))
    return (
        joined.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.lit(0).cast("long").alias("n_right"))
        .unionByName(n.agg(F.lit(0).cast("long").alias("n_rows"), F.lit(0).cast("long").alias("n_keys"), F.sum("n_right").alias("n_right")))
        .agg(F.sum("n_rows").alias("n_rows"), F.sum("n_keys").alias("n_keys"), F.sum("n_right").alias("n_right"))
    )


#: Rows per key value on average, and degrees of skew.
_FANS = ((1, 0), (4, 0), (4, 1), (4, 2))


def _index_sql(skew):
    at = "o_orderkey % pool"
    for _ in range(skew):
        at = f"(({at}) * (({at}) + 1)) // pool"
    return at


@query("s12_fan_control", " UNION ALL ".join(
    f"SELECT {per} AS rows_per_key, {skew} AS skew, COUNT(*) AS n_values, CAST(MAX(c) AS BIGINT) AS most_rows, CAST(SUM(v) AS BIGINT) AS value_sum"
    f" FROM (SELECT xor({_index_sql(skew)}, 1) AS v, COUNT(*) AS c FROM orders, (SELECT GREATEST(COUNT(*) // {per}, 1) AS pool FROM orders) GROUP BY 1)"
    for per, skew in _FANS))
def s12_fan_control(spark, sf):
    """How many order rows share a join-key value, by rows per value and by skew."""
    orders = raw(spark, sf, "orders").select("o_orderkey")
    n = orders.agg(F.count(F.lit(1))).scalar()
    parts = []
    for per, skew in _FANS:
        dealt = orders.withColumn("pool", F.greatest(F.floor(n / per), F.lit(1)).cast("long"))
        value = key_value(key_index(F.col("o_orderkey"), F.col("pool"), skew), 0)
        per_value = dealt.select(value.alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("c"))
        parts.append(per_value.agg(
            F.lit(per).alias("rows_per_key"), F.lit(skew).alias("skew"), F.count(F.lit(1)).alias("n_values"), F.max("c").alias("most_rows"),
            F.sum("v").alias("value_sum"),
        ))
    return reduce(DataFrame.unionByName, parts)
