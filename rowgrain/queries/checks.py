"""Keys, traps and table contracts measured on the given tables."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowgrain.functions.columns import money
from rowgrain.frame import requires_grain, safe_join_aggregate
from rowgrain.operators import aggregates as ag
from rowgrain.operators import contracts as ct
from rowgrain.operators import keys, traps
from rowgrain.operators import verify as vf
from rowgrain.plans import registry as rg
from rowgrain.plans import reports
from rowgrain.queries.catalog import frame, query, raw
from rowgrain.queries.relational import as_double
from rowgrain.spec import GrainError

LINE_KEYS = {
    "order_line": ["l_orderkey", "l_linenumber"],
    "order_line_part": ["l_orderkey", "l_linenumber", "l_partkey"],
    "four_columns": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
    "order_part": ["l_orderkey", "l_partkey"],
}


def stack(parts: dict[str, DataFrame], name: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.withColumn(name, F.lit(n)) for n, df in parts.items()])


# Keys ------------------------------------------------------------------------

def _unique_sql(label, cols):
    keys = ", ".join(cols)
    return f"""SELECT '{label}' AS key_name, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS n_rows, COUNT(*) AS n_keys,
        COALESCE(MAX(n) > 1, FALSE) AS has_duplicates FROM (SELECT COUNT(*) AS n FROM lineitem GROUP BY {keys})"""


@query("v1_unique", " UNION ALL ".join(_unique_sql(n, c) for n, c in LINE_KEYS.items()))
def v1_unique(spark, sf):
    items = raw(spark, sf, "lineitem")
    return stack({n: vf.uniqueness(items, c) for n, c in LINE_KEYS.items()}, "key_name")


@query("v1b_duplicates", """
    SELECT l_orderkey, l_linenumber, COUNT(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1""")
def v1b_duplicates(spark, sf):
    found = vf.duplicates(raw(spark, sf, "lineitem"), LINE_KEYS["order_line"])
    return found.orderBy(F.col("n_rows").desc(), "l_orderkey", "l_linenumber")


_COLS = ["l_linenumber", "l_orderkey", "l_partkey", "l_suppkey"]
_V2B = " UNION ALL ".join(
    f"SELECT {d} AS dropped, (SELECT COUNT(*) FROM lineitem) AS n_rows, COUNT(*) AS n_keys FROM (SELECT DISTINCT {', '.join(s)} FROM lineitem)"
    for d, s in [("CAST(NULL AS VARCHAR)", _COLS), *[(f"'{c}'", [x for x in _COLS if x != c]) for c in _COLS]]
)


@query("v2_minimal", f"""
    SELECT MAX(n_rows) AS n_rows, COUNT(*) FILTER (WHERE dropped IS NOT NULL AND n_keys = n_rows) AS n_removable,
           COUNT(*) FILTER (WHERE dropped IS NOT NULL AND n_keys = n_rows) = 0 AS is_minimal FROM ({_V2B})""")
def v2_minimal(spark, sf):
    return keys.minimality(raw(spark, sf, "lineitem"), LINE_KEYS["four_columns"])


@query("v2b_removable", f"SELECT *, dropped IS NOT NULL AND n_keys = n_rows AND n_rows > 1 AS removable FROM ({_V2B})")
def v2b_removable(spark, sf):
    return vf.reduced_counts(raw(spark, sf, "lineitem"), LINE_KEYS["four_columns"])


@query("v3_audit_join", """
    WITH j AS (SELECT o_orderkey, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey),
         n AS (SELECT COUNT(*) AS n, COUNT(DISTINCT o_orderkey) AS f1, COUNT(DISTINCT (o_orderkey, o_custkey)) AS f2,
                      COUNT(DISTINCT o_custkey) AS f2_less FROM j)
    SELECT 'P1_both_keys_unique' AS property, CASE WHEN n = f1 AND n = f2 THEN 'pass' ELSE 'fail' END AS result FROM n
    UNION ALL SELECT 'P2_kept_key_minimal', 'pass' FROM n
    UNION ALL SELECT 'P3_larger_key_reducible', CASE WHEN n <= 1 OR f1 = n OR f2_less = n THEN 'pass' ELSE 'fail' END FROM n
    UNION ALL SELECT 'P4_unordered_keys_minimal', 'pass' FROM n
    UNION ALL SELECT 'P5_sizes_agree', 'pass' FROM n
    UNION ALL SELECT 'P6_kept_key_not_larger', 'pass' FROM n""")
def v3_audit_join(spark, sf):
    return vf.audit_join(
        raw(spark, sf, "orders"), raw(spark, sf, "customer"), [("o_custkey", "c_custkey")], ["o_orderkey"], ["c_custkey"]
    )


@query("v4_key_nulls", """
    SELECT 'event_id' AS column_name, COUNT(*) FILTER (WHERE event_id IS NULL) AS n_null FROM events
    UNION ALL SELECT 'ts', COUNT(*) FILTER (WHERE ts IS NULL) FROM events
    UNION ALL SELECT 'user_id', COUNT(*) FILTER (WHERE user_id IS NULL) FROM events""")
def v4_key_nulls(spark, sf):
    return vf.null_counts(raw(spark, sf, "events"), ["event_id", "user_id", "ts"])


@query("v5_dependency", """
    SELECT 'part_to_brand' AS dependency, COUNT(*) AS n_violations FROM (SELECT 1 FROM part GROUP BY p_partkey HAVING COUNT(DISTINCT p_brand) > 1)
    UNION ALL SELECT 'segment_to_nation', COUNT(*) FROM (SELECT 1 FROM customer GROUP BY c_mktsegment HAVING COUNT(DISTINCT c_nationkey) > 1)
    UNION ALL SELECT 'part_to_supplier', COUNT(*) FROM (SELECT 1 FROM lineitem GROUP BY l_partkey HAVING COUNT(DISTINCT l_suppkey) > 1)""")
def v5_dependency(spark, sf):
    return ct.report({
        "part_to_brand": vf.dependency_violations(raw(spark, sf, "part"), ["p_partkey"], ["p_brand"]),
        "segment_to_nation": vf.dependency_violations(raw(spark, sf, "customer"), ["c_mktsegment"], ["c_nationkey"]),
        "part_to_supplier": vf.dependency_violations(raw(spark, sf, "lineitem"), ["l_partkey"], ["l_suppkey"]),
    }).withColumnRenamed("rule", "dependency")


_KEYS = {
    "o_orderkey": ("orders", ["o_orderkey"]),
    "customer_and_date": ("orders", ["o_custkey", "o_orderdate"]),
    "order_and_customer": ("orders", ["o_orderkey", "o_custkey"]),
    "user_and_time": ("events", ["user_id", "ts"]),
}


def _key_sql(label, table, cols):
    total = f"(SELECT COUNT(*) FROM {table})"
    distinct = lambda s: f"(SELECT COUNT(*) FROM (SELECT DISTINCT {', '.join(s)} FROM {table}))"
    fewer = [distinct([x for x in cols if x != c]) for c in cols] if len(cols) > 1 else []
    minimal = " AND ".join(f"{d} < {total}" for d in fewer) or "TRUE"
    return f"SELECT '{label}' AS key_name, {distinct(cols)} = {total} AS is_superkey, {distinct(cols)} = {total} AND {minimal} AS is_key"


@query("v7_keys", " UNION ALL ".join(_key_sql(n, *k) for n, k in _KEYS.items()))
def v7_keys(spark, sf):
    return stack({n: keys.is_key(raw(spark, sf, table), cols) for n, (table, cols) in _KEYS.items()}, "key_name")


def _discovery_sql(table, cols, most):
    """Every set of up to ``most`` columns counted; minimal are the unique ones without a unique subset."""
    sets = [s for k in range(1, most + 1) for s in combinations(range(len(cols)), k)]
    counted = " UNION ALL ".join(
        f"SELECT '{','.join(cols[i] for i in s)}' AS key_columns, {sum(1 << i for i in s)} AS mask, {len(s)} AS n_columns, "
        f"(SELECT COUNT(*) FROM (SELECT DISTINCT {', '.join(cols[i] for i in s)} FROM {table})) AS n" for s in sets
    )
    return f"""WITH u AS (SELECT * FROM ({counted}) WHERE n = (SELECT COUNT(*) FROM {table}))
        SELECT key_columns, n_columns FROM u WHERE NOT EXISTS (SELECT 1 FROM u t WHERE t.mask <> u.mask AND (t.mask & u.mask) = t.mask)"""


_LINE_COLUMNS = sorted(["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                        "l_returnflag", "l_linestatus", "l_shipdate"])
_EVENT_COLUMNS = sorted(["event_id", "ts", "user_id", "event_type", "value", "props"])


@query("v8_discover_line_keys", _discovery_sql("lineitem", _LINE_COLUMNS, 3))
def v8_discover_line_keys(spark, sf):
    return keys.discovered(raw(spark, sf, "lineitem"), _LINE_COLUMNS, max_size=3)


@query("v8_discover_event_keys", _discovery_sql("events", _EVENT_COLUMNS, 4))
def v8_discover_event_keys(spark, sf):
    return keys.discovered(raw(spark, sf, "events"), _EVENT_COLUMNS, max_size=4)


_DECLARED = {
    "orders": ("orders", ["o_orderkey"]),
    "events": ("events", ["user_id", "ts"]),
    "conversations": ("conversations", ["conv_id", "turn"]),
    "lineitem": ("lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]),
}


def _accept_sql(name, table, cols):
    total = f"(SELECT COUNT(*) FROM {table})"
    distinct = lambda s: f"(SELECT COUNT(*) FROM (SELECT DISTINCT {', '.join(s)} FROM {table}))"
    fewer = [distinct([x for x in cols if x != c]) for c in cols] if len(cols) > 1 else []
    minimal = " AND ".join(f"{d} < {total}" for d in fewer) or "TRUE"
    return f"SELECT '{name}' AS table_name, {total} AS n_rows, {distinct(cols)} AS n_keys, {distinct(cols)} = {total} AS is_unique, {minimal} AS is_minimal"


@query("g8_accept_grain", " UNION ALL ".join(_accept_sql(n, *k) for n, k in _DECLARED.items()))
def g8_accept_grain(spark, sf):
    """Every declared grain held against the rows."""
    return stack({n: frame(spark, sf, n).check() for n in _DECLARED}, "table_name")


# Traps -----------------------------------------------------------------------

@query("e3_group_then_join", """
    WITH o AS (SELECT o_custkey, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS spent FROM orders GROUP BY 1),
         l AS (SELECT o_custkey, COUNT(*) AS n_items, SUM(CAST(l_quantity AS DECIMAL(18,2))) AS qty
               FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT COALESCE(o.o_custkey, l.o_custkey) AS o_custkey, CAST(COALESCE(spent, 0) AS DOUBLE) AS spent,
           COALESCE(n_items, 0) AS n_items, CAST(COALESCE(qty, 0) AS DOUBLE) AS qty
    FROM o FULL JOIN l ON o.o_custkey = l.o_custkey""")
def e3_group_then_join(spark, sf):
    orders, items = frame(spark, sf, "orders"), frame(spark, sf, "lineitem")
    owner = orders.select("o_orderkey", "o_custkey")
    # Items go to their order first, so the join to orders is one-to-one and small.
    per_order = items.aggregate("l_orderkey", n_items=ag.rows(), qty=ag.total("l_quantity", decimal=True))
    with_customer = per_order.join(owner, [("l_orderkey", "o_orderkey")])
    out = safe_join_aggregate(
        [
            (orders, {"spent": ag.total("o_totalprice", decimal=True)}),
            (with_customer, {"n_items": ag.total("n_items"), "qty": ag.total("qty", decimal=True)}),
        ],
        ["o_custkey"],
    )
    return as_double(out.df, "spent", "qty")


@query("i4_three_reports", """
    WITH j AS (SELECT o_custkey, CAST(o_totalprice AS DECIMAL(18,2)) AS p FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
    SELECT 'joined_only' AS method, FALSE AS accepted, COUNT(*) AS n_rows, CAST(SUM(p) AS DOUBLE) AS total_price FROM j
    UNION ALL SELECT 'joined_then_grouped', FALSE, COUNT(DISTINCT o_custkey), CAST(SUM(p) AS DOUBLE) FROM j
    UNION ALL SELECT 'grouped_then_joined', TRUE, COUNT(DISTINCT o_custkey), CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM orders""")
def i4_three_reports(spark, sf):
    """Three ways to one report: is it let through, and what would it have said?"""
    orders, items = frame(spark, sf, "orders"), frame(spark, sf, "lineitem")

    def accepted(build):
        try:
            build(orders, items)
            return F.lit(True)
        except GrainError:
            return F.lit(False)

    # What the refused forms would give, from counts per order instead of the repeated rows.
    per_order = items.df.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    repeated = orders.df.join(per_order, "o_orderkey").withColumn("p", money("o_totalprice") * F.col("n").cast("decimal(12,0)"))
    right = reports.grouped_then_joined(orders, items).df
    forms = {
        "joined_only": (reports.joined_only, repeated.agg(F.sum("n").alias("n_rows"), F.sum("p").alias("total_price"))),
        "joined_then_grouped": (
            reports.joined_then_grouped, repeated.agg(F.count_distinct("o_custkey").alias("n_rows"), F.sum("p").alias("total_price"))
        ),
        "grouped_then_joined": (
            reports.grouped_then_joined, right.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("total_price").alias("total_price"))
        ),
    }
    parts = [
        df.select(F.lit(name).alias("method"), accepted(build).alias("accepted"), "n_rows", F.col("total_price").cast("double").alias("total_price"))
        for name, (build, df) in forms.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query("e3b_inflation", """
    SELECT (SELECT CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM orders) AS total_before,
           (SELECT CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM orders JOIN lineitem ON o_orderkey = l_orderkey) AS total_after""")
def e3b_inflation(spark, sf):
    orders, items = raw(spark, sf, "orders"), raw(spark, sf, "lineitem")
    out = traps.inflation(orders, items, [("o_orderkey", "l_orderkey")], money("o_totalprice"))
    return as_double(out, "total_before", "total_after")


@query("e4_chain_loss", """
    WITH t AS (
        SELECT 'customer_orders' AS link, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE c_custkey IS NULL) AS n_null_key,
               COUNT(*) FILTER (WHERE c_custkey IS NOT NULL AND c_custkey NOT IN (SELECT o_custkey FROM orders)) AS n_unmatched FROM customer
        UNION ALL SELECT 'orders_items', COUNT(*), COUNT(*) FILTER (WHERE o_orderkey IS NULL),
               COUNT(*) FILTER (WHERE o_orderkey IS NOT NULL AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) FROM orders
        UNION ALL SELECT 'documents_labels', COUNT(*), COUNT(*) FILTER (WHERE doc_id IS NULL),
               COUNT(*) FILTER (WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels)) FROM documents)
    SELECT *, n_null_key = 0 AND n_unmatched = 0 AS is_total FROM t""")
def e4_chain_loss(spark, sf):
    t = {n: raw(spark, sf, n) for n in ("customer", "orders", "lineitem", "documents", "labels")}
    return traps.chain_loss([
        ("customer_orders", t["customer"], t["orders"], [("c_custkey", "o_custkey")]),
        ("orders_items", t["orders"], t["lineitem"], [("o_orderkey", "l_orderkey")]),
        ("documents_labels", t["documents"], t["labels"], "doc_id"),
    ])


#: Joins people write on these tables, as (left, right, renames of the right side, key).
JOINS = (
    ("orders", "customer", {"c_custkey": "o_custkey"}, ["o_custkey"]),
    ("orders", "lineitem", {"l_orderkey": "o_orderkey"}, ["o_orderkey"]),
    ("lineitem", "part", {"p_partkey": "l_partkey"}, ["l_partkey"]),
    ("lineitem", "supplier", {"s_suppkey": "l_suppkey"}, ["l_suppkey"]),
    ("customer", "supplier", {"s_nationkey": "c_nationkey"}, ["c_nationkey"]),
    ("customer", "nation", {"n_nationkey": "c_nationkey"}, ["c_nationkey"]),
    ("documents", "labels", {}, ["doc_id"]),
    ("events", "customer", {"c_custkey": "user_id"}, ["user_id"]),
)

# Left and right keys as the tables name them, and what the grains say about each join.
_AUDIT_SQL = (
    (1, "orders", "customer", "o_custkey", "c_custkey", "many_to_one", "o_orderkey", False, True),
    (2, "orders", "lineitem", "o_orderkey", "l_orderkey", "one_to_many", "l_linenumber,l_partkey,l_quantity,l_suppkey,o_orderkey", True, False),
    (3, "lineitem", "part", "l_partkey", "p_partkey", "many_to_one", "l_linenumber,l_orderkey,l_partkey,l_quantity,l_suppkey", False, True),
    (4, "lineitem", "supplier", "l_suppkey", "s_suppkey", "many_to_one", "l_linenumber,l_orderkey,l_partkey,l_quantity,l_suppkey", False, True),
    (5, "customer", "supplier", "c_nationkey", "s_nationkey", "many_to_many", "c_custkey,s_suppkey", True, True),
    (6, "customer", "nation", "c_nationkey", "n_nationkey", "many_to_one", "c_custkey", False, True),
    (7, "documents", "labels", "doc_id", "doc_id", "one_to_one", "doc_id", False, False),
    (8, "events", "customer", "user_id", "c_custkey", "many_to_one", "ts,user_id", False, True),
)


def _audit_sql(no, left, right, lk, rk, shape, grain, rl, rr):
    return f"""SELECT {no} AS join_no, '{left}' AS left_table, '{right}' AS right_table, '{shape}' AS shape, '{grain}' AS grain,
        {rl} AS repeats_left, {rr} AS repeats_right, (SELECT COUNT(*) FROM {left}) AS n_left, (SELECT COUNT(*) FROM {right}) AS n_right,
        (SELECT COUNT(*) FROM {left} l JOIN {right} r ON l.{lk} = r.{rk}) AS n_result"""


@query("e6_registry_audit", " UNION ALL ".join(_audit_sql(*a) for a in _AUDIT_SQL))
def e6_registry_audit(spark, sf):
    """What the declared grains say about each join, beside what the rows show."""
    names = {n for l, r, _, _ in JOINS for n in (l, r)}
    frames = {n: frame(spark, sf, n) for n in sorted(names)}
    reg_frames, declared, sizes = {}, [], {}
    for no, (left, right, renames, key) in enumerate(JOINS, 1):
        renamed = frames[right].rename(renames)
        reg_frames[left] = frames[left]
        reg_frames[f"{right}@{no}"] = renamed
        declared.append((left, f"{right}@{no}", key))
        sizes[no] = traps.join_size(frames[left].df, renamed.df, key).withColumn("join_no", F.lit(no))
    measured = reduce(DataFrame.unionByName, sizes.values())
    audited = rg.audit_joins(rg.registry(spark, reg_frames), rg.declared_joins(spark, declared))
    return audited.join(measured, "join_no").select(
        "join_no", "left_table", F.split("right_table", "@")[0].alias("right_table"), "shape",
        F.array_join("grain", ",").alias("grain"), "repeats_left", "repeats_right", "n_left", "n_right",
        F.col("n_result").cast("long").alias("n_result"),
    )


@query("a11_rollup_audit", """
    SELECT 'orders' AS table_name, 'o_custkey' AS target, TRUE AS columns_exist, COUNT(DISTINCT o_custkey) AS n_groups FROM orders
    UNION ALL SELECT 'orders', 'o_orderdate,o_orderstatus', TRUE, COUNT(DISTINCT (o_orderstatus, o_orderdate)) FROM orders
    UNION ALL SELECT 'lineitem', 'l_orderkey', TRUE, COUNT(DISTINCT l_orderkey) FROM lineitem""")
def a11_rollup_audit(spark, sf):
    targets = [("orders", ["o_custkey"]), ("orders", ["o_orderdate", "o_orderstatus"]), ("lineitem", ["l_orderkey"])]
    frames = {n: frame(spark, sf, n) for n in ("orders", "lineitem")}
    asked = spark.createDataFrame(targets, "table_name string, target array<string>")
    audited = rg.audit_rollups(rg.registry(spark, frames), asked).select(
        "table_name", F.array_join("target", ",").alias("target"), "columns_exist"
    )
    counted = reduce(
        DataFrame.unionByName,
        [
            frames[t].aggregate_to(cols).aggregate([], n_groups=ag.rows()).df
            .withColumn("table_name", F.lit(t)).withColumn("target", F.lit(",".join(cols)))
            for t, cols in targets
        ],
    )
    return audited.join(counted, ["table_name", "target"])


_ITEM_KEY = "o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity"
_REFUSALS_SQL = {
    "orders_summed_over_items": "SELECT COUNT(*), COUNT(DISTINCT o_orderkey) FROM j",
    "items_summed_over_orders": f"SELECT COUNT(*), COUNT(DISTINCT ({_ITEM_KEY})) FROM j",
    "items_as_customers": "SELECT COUNT(*), COUNT(DISTINCT o_custkey) FROM j",
    "items_as_items": f"SELECT COUNT(*), COUNT(DISTINCT ({_ITEM_KEY})) FROM j",
    "orders_given_for_customers": "SELECT COUNT(*), COUNT(DISTINCT o_custkey) FROM orders",
    "orders_given_for_orders": "SELECT COUNT(*), COUNT(DISTINCT o_orderkey) FROM orders",
    "orders_rolled_up_to_a_column_of_customers": """
        SELECT 1, COUNT(DISTINCT column_name) FROM information_schema.columns WHERE table_name = 'orders' AND column_name IN ('c_name')""",
    "orders_rolled_up_to_customer_and_status": """
        SELECT 2, COUNT(DISTINCT column_name) FROM information_schema.columns WHERE table_name = 'orders' AND column_name IN ('o_custkey', 'o_orderstatus')""",
}


@query("e8_refusals", f"""
    WITH j AS (SELECT * FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
         n(case_name, needed, found) AS ({" UNION ALL ".join(f"SELECT '{n}', * FROM ({q})" for n, q in _REFUSALS_SQL.items())})
    SELECT case_name, needed, found, needed <> found AS refused FROM n""")
def e8_refusals(spark, sf):
    """What is refused from the declarations alone, beside what the rows say: as many keys (or columns) as needed, or fewer.

    ``refused`` comes from calling the operation, before any job; the SQL works it out from the rows.
    """
    orders, items = frame(spark, sf, "orders"), frame(spark, sf, "lineitem")
    joined = orders.join(items, [("o_orderkey", "l_orderkey")])

    @requires_grain("c_custkey")
    def per_customer(f):
        return f

    @requires_grain("o_orderkey")
    def per_order(f):
        return f

    def refused(ask) -> bool:
        try:
            ask()
        except GrainError:
            return True
        return False

    wanted = {"orders_rolled_up_to_a_column_of_customers": ["c_name"], "orders_rolled_up_to_customer_and_status": ["o_custkey", "o_orderstatus"]}
    calls = {
        "orders_summed_over_items": lambda: joined.aggregate("o_custkey", price=ag.total("o_totalprice")),
        "items_summed_over_orders": lambda: joined.aggregate("o_custkey", quantity=ag.total("l_quantity")),
        "items_as_customers": lambda: joined.expect_grain("o_custkey"),
        "items_as_items": lambda: joined.expect_grain(*joined.grain),
        "orders_given_for_customers": lambda: per_customer(orders.rename({"o_custkey": "c_custkey"})),
        "orders_given_for_orders": lambda: per_order(orders),
        **{n: lambda c=c: orders.aggregate_to(c) for n, c in wanted.items()},
    }
    answer = {n: refused(ask) for n, ask in calls.items()}
    item_key = sorted(joined.grain)
    by_rows = [
        (joined.df, {"orders_summed_over_items": ["o_orderkey"], "items_summed_over_orders": item_key,
                     "items_as_customers": ["o_custkey"], "items_as_items": item_key}),
        (orders.df, {"orders_given_for_customers": ["o_custkey"], "orders_given_for_orders": ["o_orderkey"]}),
    ]
    row = lambda n, needed, found: F.struct(
        F.lit(n).alias("case_name"), needed.cast("long").alias("needed"), found.cast("long").alias("found"), F.lit(answer[n]).alias("refused"))
    parts = []
    for df, cases in by_rows:
        names = {n: frozenset(cols) for n, cols in cases.items()}
        counts = vf.count_sets(df, names)
        parts.append(counts.select(F.explode(F.array(*[row(n, F.col("n_rows"), F.col(n)) for n in names])).alias("x")).select("x.*"))
    columns = F.array(*[row(n, F.lit(len(c)), F.lit(len(set(c) & set(orders.columns)))) for n, c in wanted.items()])
    parts.append(spark.range(1).select(F.explode(columns).alias("x")).select("x.*"))
    return reduce(DataFrame.unionByName, parts)


# Contracts -------------------------------------------------------------------

def _rules(**parts):
    return " UNION ALL ".join(f"SELECT '{n}' AS rule, COUNT(*) AS n_violations FROM ({s})" for n, s in parts.items())


def _dup(table, *cols):
    keys = ", ".join(cols)
    return f"SELECT 1 FROM {table} GROUP BY {keys} HAVING COUNT(*) > 1"


@query("b1_entity", _rules(
    entity_key_not_null="SELECT 1 FROM customer WHERE c_custkey IS NULL", entity_key_unique=_dup("customer", "c_custkey")))
def b1_entity(spark, sf):
    return ct.report(ct.entity(raw(spark, sf, "customer"), ["c_custkey"]))


@query("b2_event", _rules(
    entity_key_not_null="SELECT 1 FROM orders WHERE o_custkey IS NULL",
    time_not_null="SELECT 1 FROM orders WHERE o_orderdate IS NULL", entity_and_time_unique=_dup("orders", "o_custkey", "o_orderdate")))
def b2_event(spark, sf):
    return ct.report(ct.event(raw(spark, sf, "orders"), ["o_custkey"], "o_orderdate"))


@query("b2b_pair_counts", """
    WITH b AS (SELECT o_custkey, o_orderdate, COUNT(*) AS n FROM orders GROUP BY 1, 2),
         t AS (SELECT o_orderdate, SUM(n) AS n, SUM(n * n) AS same FROM b GROUP BY 1)
    SELECT CAST((SUM(n) * SUM(n) - SUM(n * n)) // 2 AS BIGINT) AS n_before, CAST((SUM(n * n) - SUM(same)) // 2 AS BIGINT) AS n_concurrent FROM t""")
def b2b_pair_counts(spark, sf):
    out = ct.pair_counts(raw(spark, sf, "orders"), ["o_custkey"], "o_orderdate")
    return out.select(F.col("n_before").cast("long"), F.col("n_concurrent").cast("long"))


_UNCHANGED = """SELECT 1 FROM (SELECT event_type, LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events) WHERE before = event_type"""


@query("b3_multi_version", _rules(
    entity_key_not_null="SELECT 1 FROM events WHERE user_id IS NULL",
    time_not_null="SELECT 1 FROM events WHERE ts IS NULL", entity_and_time_unique=_dup("events", "user_id", "ts"), neighbours_differ=_UNCHANGED))
def b3_multi_version(spark, sf):
    return ct.report(ct.multi_version(raw(spark, sf, "events"), ["user_id"], "ts", ["event_type"]))


@query("b3_unchanged_versions", """
    SELECT event_id, user_id, event_type FROM (
        SELECT *, LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events) WHERE before = event_type""")
def b3_unchanged_versions(spark, sf):
    found = ct.unchanged_versions(raw(spark, sf, "events"), ["user_id"], "ts", ["event_type"])
    return found.select("event_id", "user_id", "event_type")


@query("b3b_repair_versions", """
    WITH kept AS (SELECT * FROM (
        SELECT *, ROW_NUMBER() OVER w AS n, LAG(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
        WHERE n = 1 OR before IS DISTINCT FROM event_type)
    SELECT event_id, user_id, event_type, ts, LEAD(ts) OVER (PARTITION BY user_id ORDER BY ts) AS valid_to FROM kept""")
def b3b_repair_versions(spark, sf):
    found = ct.repaired_versions(raw(spark, sf, "events"), ["user_id"], "ts", ["event_type"])
    return found.select("event_id", "user_id", "event_type", "ts", "valid_to")


@query("w4_valid_to", "SELECT event_id, ts, LEAD(ts) OVER (PARTITION BY user_id ORDER BY ts) AS valid_to FROM events")
def w4_valid_to(spark, sf):
    return ct.valid_to(raw(spark, sf, "events"), ["user_id"], "ts").select("event_id", "ts", "valid_to")


@query("b4_seq_event", _rules(
    time_not_null="SELECT 1 FROM events WHERE ts IS NULL", entity_key_unique=_dup("events", "event_id"), time_unique=_dup("events", "ts")))
def b4_seq_event(spark, sf):
    return ct.report(ct.sequence(raw(spark, sf, "events"), ["event_id"], "ts"))


_MONTHS = "SELECT DISTINCT LAST_DAY(CAST(o_orderdate AS DATE)) AS month_end FROM orders"
_LATEST = """
    SELECT m.month_end, o.o_custkey, MAX(o.day) AS since FROM (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders) o
    JOIN m ON o.day <= m.month_end GROUP BY 1, 2"""


def _versions(spark, sf):
    """The largest order of a customer and day as that day's state."""
    return raw(spark, sf, "orders").groupBy("o_custkey", F.col("o_orderdate").cast("date").alias("since")).agg(
        F.max("o_totalprice").alias("largest")
    )


def _month_ends(spark, sf):
    return raw(spark, sf, "orders").select(F.last_day(F.col("o_orderdate").cast("date")).alias("month_end")).distinct()


@query("b5b_states_at", f"""
    WITH m AS ({_MONTHS}), s AS ({_LATEST}),
         v AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS since, MAX(o_totalprice) AS largest FROM orders GROUP BY 1, 2)
    SELECT month_end, o_custkey, since, largest FROM s JOIN v USING (o_custkey, since)""")
def b5b_states_at(spark, sf):
    return ct.states_at(_versions(spark, sf), ["o_custkey"], "since", ["largest"], _month_ends(spark, sf), "month_end")


@query("b5b_state_intervals", f"""
    WITH m AS ({_MONTHS}), s AS ({_LATEST}),
         v AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS since, MAX(o_totalprice) AS largest FROM orders GROUP BY 1, 2),
         shown AS (SELECT o_custkey, since, MIN(month_end) AS first_at FROM s GROUP BY 1, 2)
    SELECT o_custkey, since, largest, first_at, LEAD(first_at) OVER (PARTITION BY o_custkey ORDER BY first_at) AS before_at
    FROM shown JOIN v USING (o_custkey, since)""")
def b5b_state_intervals(spark, sf):
    return ct.state_intervals(_versions(spark, sf), ["o_custkey"], "since", ["largest"], _month_ends(spark, sf), "month_end")


_PRIORITIES = "SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS since, MAX(o_totalprice) AS largest FROM orders GROUP BY 1, 2"


@query("b5_snapshot_nested", f"""
    WITH m AS ({_MONTHS}), v AS ({_PRIORITIES}),
         s AS (SELECT month_end, o_orderpriority, MAX(since) AS since FROM v JOIN m ON since <= month_end GROUP BY 1, 2),
         told AS (SELECT month_end, o_orderpriority, since, CASE WHEN MONTH(month_end) = 2 THEN largest + 1 ELSE largest END AS largest
                  FROM s JOIN v USING (o_orderpriority, since) WHERE NOT (MONTH(month_end) = 1 AND o_orderpriority = '1-URGENT')),
         wrong AS (SELECT month_end FROM (SELECT s.month_end, s.o_orderpriority, since, largest FROM s JOIN v USING (o_orderpriority, since) EXCEPT SELECT * FROM told) GROUP BY 1)
    SELECT 'time_not_null' AS rule, 0::BIGINT AS n_violations UNION ALL SELECT 'time_unique', 0::BIGINT
    UNION ALL SELECT 'collection_is_complete', COUNT(*) FROM wrong""")
def b5_snapshot_nested(spark, sf):
    """Monthly collections of the newest state per priority; one lacks a state in January and has a wrong one in February."""
    versions = raw(spark, sf, "orders").groupBy("o_orderpriority", F.col("o_orderdate").cast("date").alias("since")).agg(
        F.max("o_totalprice").alias("largest"))
    states = ct.states_at(versions, ["o_orderpriority"], "since", ["largest"], _month_ends(spark, sf), "month_end")
    month = F.month("month_end")
    told = states.filter(~((month == 1) & (F.col("o_orderpriority") == "1-URGENT"))).withColumn(
        "largest", F.when(month == 2, F.col("largest") + 1).otherwise(F.col("largest")))
    # Five priorities exist, so a collection has five states.
    nested = told.groupBy("month_end").agg(F.collect_list(F.struct("o_orderpriority", "since", "largest")).alias("states"))
    return ct.report(ct.snapshot(nested, "month_end", "states", versions, ["o_orderpriority"], "since", ["largest"]))


@query("b5_snapshot", f"""
    WITH m AS ({_MONTHS}), s AS ({_LATEST}),
         told AS (SELECT LAST_DAY(CAST(o_orderdate AS DATE)) AS month_end, o_custkey, MAX(CAST(o_orderdate AS DATE)) AS since FROM orders GROUP BY 1, 2)
    SELECT s.month_end, COUNT(*) AS n_missing FROM s LEFT JOIN told USING (month_end, o_custkey, since) WHERE told.o_custkey IS NULL GROUP BY 1""")
def b5_snapshot(spark, sf):
    """Snapshots that list only customers active in the month are incomplete; count what each lacks."""
    versions = _versions(spark, sf)
    told = (
        versions.withColumn("month_end", F.last_day("since")).groupBy("month_end", "o_custkey")
        .agg(F.max(F.struct("since", "largest")).alias("s")).select("month_end", "o_custkey", "s.*")
    )
    verdicts = ct.snapshot_verdicts(told, "month_end", versions, ["o_custkey"], "since", ["largest"])
    return verdicts.filter(~F.col("same")).select("month_end", (F.col("n_true") - F.col("n_told")).alias("n_missing"))


@query("b6_ordered", _rules(
    entity_key_not_null="SELECT 1 FROM conversations WHERE conv_id IS NULL",
    time_not_null="SELECT 1 FROM conversations WHERE turn IS NULL", entity_and_time_unique=_dup("conversations", "conv_id", "turn")))
def b6_ordered(spark, sf):
    return ct.report(ct.ordered(raw(spark, sf, "conversations"), ["conv_id"], "turn"))


@query("b7_seq_ordered", _rules(
    time_not_null="SELECT 1 FROM part WHERE p_retailprice IS NULL", entity_key_unique=_dup("part", "p_partkey"), time_unique=_dup("part", "p_retailprice")))
def b7_seq_ordered(spark, sf):
    return ct.report(ct.sequence_ordered(raw(spark, sf, "part"), ["p_partkey"], "p_retailprice"))


#: All items, and copies of each first one whose order does not exist.
_LOST_ITEMS = "SELECT l_orderkey FROM lineitem UNION ALL SELECT -l_orderkey FROM lineitem WHERE l_linenumber = 1"


@query("b8_has_parent", _rules(
    parent_exists=f"SELECT 1 FROM ({_LOST_ITEMS}) WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN (SELECT o_orderkey FROM orders)",
    parent_key_unique=_dup("orders", "o_orderkey")))
def b8_has_parent(spark, sf):
    items = raw(spark, sf, "lineitem")
    lost = items.filter("l_linenumber = 1").withColumn("l_orderkey", -F.col("l_orderkey"))
    return ct.report(ct.has_parent(items.unionByName(lost), ["l_orderkey"], raw(spark, sf, "orders"), ["o_orderkey"]))


#: All pairs, and copies of those with one unit whose supplier does not exist.
_PAIRS = """SELECT DISTINCT l_partkey, l_suppkey FROM lineitem
    UNION ALL SELECT DISTINCT l_partkey, -l_suppkey FROM lineitem WHERE l_quantity = 1"""


@query("b9_link", _rules(
    entity_key_unique=f"SELECT 1 FROM ({_PAIRS}) GROUP BY l_partkey, l_suppkey HAVING COUNT(*) > 1",
    parties_not_null=f"SELECT 1 FROM ({_PAIRS}) WHERE l_partkey IS NULL OR l_suppkey IS NULL",
    pair_unique=f"SELECT 1 FROM ({_PAIRS}) GROUP BY l_partkey, l_suppkey HAVING COUNT(*) > 1",
    party1_exists=f"SELECT 1 FROM ({_PAIRS}) WHERE l_partkey NOT IN (SELECT p_partkey FROM part)",
    party2_exists=f"SELECT 1 FROM ({_PAIRS}) WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)"))
def b9_link(spark, sf):
    items = frame(spark, sf, "lineitem")
    pairs = items.project_distinct("l_partkey", "l_suppkey").df
    lost = items.where(F.col("l_quantity") == 1).project_distinct("l_partkey", "l_suppkey").df.withColumn("l_suppkey", -F.col("l_suppkey"))
    suppliers = raw(spark, sf, "supplier")
    return ct.report(ct.link(
        pairs.unionByName(lost), ["l_partkey", "l_suppkey"], ["l_partkey"], raw(spark, sf, "part"), ["p_partkey"], ["l_suppkey"], suppliers, ["s_suppkey"]
    ))


@query("b9_relates_to", """
    SELECT p_partkey, s_suppkey, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_suppkey = s_suppkey) AS related
    FROM (SELECT l_partkey AS p_partkey, MIN(l_suppkey) + 1 AS s_suppkey FROM lineitem GROUP BY 1)""")
def b9_relates_to(spark, sf):
    items = frame(spark, sf, "lineitem")
    ask = items.aggregate("l_partkey", l_suppkey=ag.least("l_suppkey")).df.withColumn("l_suppkey", F.col("l_suppkey") + 1)
    told = ct.relates_to(items.df, ask, ["l_partkey", "l_suppkey"])
    return told.withColumnsRenamed({"l_partkey": "p_partkey", "l_suppkey": "s_suppkey"})


@query("b10_classify", f"""
    WITH c AS (
        SELECT 'seq_event' AS class, 1 AS rank, (SELECT COUNT(*) FROM ({_dup('events', 'event_id')})) + (SELECT COUNT(*) FROM ({_dup('events', 'ts')}))
               + (SELECT COUNT(*) FROM events WHERE ts IS NULL) AS v
        UNION ALL SELECT 'multi_version', 2, (SELECT COUNT(*) FROM ({_UNCHANGED})) + (SELECT COUNT(*) FROM ({_dup('events', 'user_id', 'ts')}))
               + (SELECT COUNT(*) FROM events WHERE ts IS NULL)
        UNION ALL SELECT 'event', 3, (SELECT COUNT(*) FROM ({_dup('events', 'user_id', 'ts')})) + (SELECT COUNT(*) FROM events WHERE ts IS NULL)
        UNION ALL SELECT 'entity', 7, (SELECT COUNT(*) FROM ({_dup('events', 'user_id')})) + (SELECT COUNT(*) FROM events WHERE user_id IS NULL))
    SELECT class, CAST(v AS BIGINT) AS n_violations, v = 0 AS holds, COALESCE(rank = (SELECT MIN(rank) FROM c WHERE v = 0), FALSE) AS chosen FROM c""")
def b10_classify(spark, sf):
    events = raw(spark, sf, "events")
    return ct.classify({
        "seq_event": ct.sequence(events, ["event_id"], "ts"),
        "multi_version": ct.multi_version(events, ["user_id"], "ts", ["event_type"]),
        "event": ct.event(events, ["user_id"], "ts"),
        "entity": ct.entity(events, ["user_id"]),
    })


@query("b11_integrate", """
    WITH o AS (SELECT o_custkey AS k, COUNT(*) AS n_orders FROM orders GROUP BY 1), e AS (SELECT user_id AS k, COUNT(*) AS n_events FROM events GROUP BY 1),
         c AS (SELECT c_custkey AS k, CAST(c_acctbal AS DOUBLE) AS balance FROM customer)
    SELECT COALESCE(c.k, o.k, e.k) AS customer, COALESCE(balance, 0) AS balance, COALESCE(n_orders, 0) AS n_orders, COALESCE(n_events, 0) AS n_events
    FROM c FULL JOIN o ON c.k = o.k FULL JOIN e ON COALESCE(c.k, o.k) = e.k""")
def b11_integrate(spark, sf):
    customer = frame(spark, sf, "customer").rename({"c_custkey": "customer", "c_acctbal": "balance"}).select("customer", "balance")
    orders = frame(spark, sf, "orders").rename({"o_custkey": "customer"}).aggregate("customer", n_orders=ag.rows())
    events = frame(spark, sf, "events").rename({"user_id": "customer"}).aggregate("customer", n_events=ag.rows())
    return ct.integrate([customer, orders, events], ["customer"]).df


@query("b12_constraints", _rules(
    price_positive="SELECT 1 FROM orders WHERE NOT COALESCE(o_totalprice > 0, FALSE)",
    discount_small="SELECT 1 FROM lineitem WHERE NOT COALESCE(l_discount < 0.1, FALSE)",
    more_items_than_orders="SELECT 1 WHERE NOT ((SELECT COUNT(*) FROM lineitem) > (SELECT COUNT(DISTINCT l_orderkey) FROM lineitem))",
    label_has_document="""SELECT 1 FROM (SELECT doc_id FROM labels UNION ALL SELECT -1 - doc_id FROM labels WHERE toxic = 1)
        WHERE doc_id NOT IN (SELECT doc_id FROM documents)"""))
def b12_constraints(spark, sf):
    items = raw(spark, sf, "lineitem")
    more = ct.whole_collection(items, F.count(F.lit(1)) > F.count_distinct("l_orderkey"))
    labels = raw(spark, sf, "labels").select("doc_id", "toxic")
    lost = labels.filter("toxic = 1").withColumn("doc_id", F.lit(-1) - F.col("doc_id"))
    return ct.report({
        "price_positive": ct.each_row(raw(spark, sf, "orders"), F.col("o_totalprice") > 0),
        "discount_small": ct.each_row(items, F.col("l_discount") < 0.1),
        "more_items_than_orders": more.filter(~F.col("holds")),
        "label_has_document": ct.across(labels.unionByName(lost), ["doc_id"], raw(spark, sf, "documents"), ["doc_id"]),
    })
