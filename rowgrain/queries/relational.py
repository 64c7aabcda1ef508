"""Projection, filter, joins, grouping, order and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowgrain.functions.columns import code, whole_division
from rowgrain.operators import aggregates as ag
from rowgrain.operators import joins as jn
from rowgrain.operators import ordered as od
from rowgrain.operators import sets as st
from rowgrain.operators import traps
from rowgrain.plans import reports
from rowgrain.queries.catalog import frame, query, raw
from rowgrain.sources.tables import source


def as_double(df, *cols):
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


@query("sales_report_safe", """
    WITH items AS (SELECT l_orderkey, SUM(CAST(l_quantity AS DECIMAL(18,2))) AS qty FROM lineitem GROUP BY l_orderkey)
    SELECT o_custkey, COUNT(*) AS n_orders,
           CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_price,
           COALESCE(CAST(SUM(qty) AS DOUBLE), 0) AS total_qty
    FROM orders LEFT JOIN items ON l_orderkey = o_orderkey GROUP BY o_custkey""")
def sales_report_safe(spark, sf):
    report = reports.grouped_then_joined(frame(spark, sf, "orders"), frame(spark, sf, "lineitem"))
    df = as_double(report.df, "total_price", "total_qty")
    return df.withColumn("total_qty", F.coalesce("total_qty", F.lit(0.0)))


# Projection, extension, rename, filter ---------------------------------------

@query("p1_filter", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def p1_filter(spark, sf):
    f = frame(spark, sf, "orders").where((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000))
    return f.select("o_orderkey", "o_custkey", "o_totalprice").expect_grain("o_orderkey").df


@query("p2_collection_filter", "SELECT event_type, COUNT(*) AS n FROM events WHERE value IS NOT NULL AND value < 10 GROUP BY event_type")
def p2_collection_filter(spark, sf):
    return frame(spark, sf, "events").where(F.col("value") < 10).aggregate("event_type", n=ag.rows()).df


@query("p3_project", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def p3_project(spark, sf):
    return frame(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment").df


@query("p4_project_distinct", "SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def p4_project_distinct(spark, sf):
    return frame(spark, sf, "orders").project_distinct("o_custkey", "o_orderstatus").df


@query("p5_extend", """
    SELECT o_orderkey, YEAR(o_orderdate) AS order_year, o_totalprice >= 250000 AS is_large FROM orders""")
def p5_extend(spark, sf):
    f = frame(spark, sf, "orders").extend(
        order_year=F.year("o_orderdate").cast("long"), is_large=F.col("o_totalprice") >= 250000
    )
    return f.select("o_orderkey", "order_year", "is_large").df


@query("p6_rename", "SELECT o_orderkey AS order_key, o_custkey AS buyer FROM orders")
def p6_rename(spark, sf):
    f = frame(spark, sf, "orders").rename({"o_orderkey": "order_key", "o_custkey": "buyer"})
    return f.expect_grain("order_key").select("order_key", "buyer").df


@query("p7_map_first", """
    SELECT o_custkey AS buyer, YEAR(o_orderdate) AS order_year, MIN(o_orderkey) AS first_order FROM orders GROUP BY 1, 2""")
def p7_map_first(spark, sf):
    return frame(spark, sf, "orders").map_rows(
        {"buyer": F.col("o_custkey"), "order_year": F.year("o_orderdate").cast("long"), "first_order": F.col("o_orderkey")},
        grain=["buyer", "order_year"], order=["o_orderkey"],
    ).df


@query("p8_entities", """
    SELECT DISTINCT c_custkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey""")
def p8_entities(spark, sf):
    customer = frame(spark, sf, "customer")
    orders = frame(spark, sf, "orders").rename({"o_custkey": "c_custkey"})
    joined = orders.join(customer, "c_custkey")
    return joined.expect_grain("o_orderkey").entities("c_name", "c_mktsegment", key=["c_custkey"]).df


@query("p10_grain_rows", "SELECT user_id, ts FROM events")
def p10_grain_rows(spark, sf):
    return frame(spark, sf, "events").grain_rows()


@query("p11_factor", """
    SELECT c_nationkey, COUNT(*) AS n_orders, COUNT(DISTINCT c_custkey) AS n_customers
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey""")
def p11_factor(spark, sf):
    wide = frame(spark, sf, "orders").join(frame(spark, sf, "customer"), [("o_custkey", "c_custkey")])
    rest, dim = wide.factor(["o_custkey"], ["c_name", "c_nationkey", "c_mktsegment"])
    return rest.join(dim, "o_custkey").aggregate(
        "c_nationkey", n_orders=ag.rows(), n_customers=ag.different("o_custkey")
    ).df


# Joins -----------------------------------------------------------------------

@query("j1_inner_equijoin", """
    SELECT c_mktsegment, o_orderstatus, COUNT(*) AS n_orders,
           CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_price
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, o_orderstatus""")
def j1_inner_equijoin(spark, sf):
    customer = frame(spark, sf, "customer").rename({"c_custkey": "o_custkey"})
    joined = frame(spark, sf, "orders").join(customer, "o_custkey").expect_grain("o_orderkey")
    out = joined.aggregate(["c_mktsegment", "o_orderstatus"], n_orders=ag.rows(), total_price=ag.total("o_totalprice", decimal=True))
    return as_double(out.df, "total_price")


@query("j1c_two_keys", """
    WITH a AS (SELECT l_returnflag, l_suppkey, MAX(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1, 2),
         b AS (SELECT l_linenumber, l_linestatus, MIN(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2),
         j AS (SELECT * FROM a JOIN b USING (l_suppkey, l_linenumber))
    SELECT COUNT(*) AS n_rows,
           (SELECT COUNT(*) FROM (SELECT DISTINCT l_returnflag, l_suppkey, l_linestatus FROM j)) AS n_first,
           (SELECT COUNT(*) FROM (SELECT DISTINCT l_returnflag, l_linenumber, l_linestatus FROM j)) AS n_second FROM j""")
def j1c_two_keys(spark, sf):
    items = frame(spark, sf, "lineitem")
    a = items.aggregate(["l_returnflag", "l_suppkey"], l_linenumber=ag.greatest("l_linenumber"))
    b = items.aggregate(["l_linenumber", "l_linestatus"], l_suppkey=ag.least("l_suppkey"))
    j = a.join(b, ["l_suppkey", "l_linenumber"])
    first, second = j.grain, j.spec.alternatives[0]
    return j.df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(F.struct(*sorted(first))).alias("n_first"),
        F.count_distinct(F.struct(*sorted(second))).alias("n_second"),
    )


@query("j2_ordered_join", """
    SELECT p_brand, COUNT(*) AS n_items, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""")
def j2_ordered_join(spark, sf):
    items, part = frame(spark, sf, "lineitem"), frame(spark, sf, "part")
    joined = items.join(part, [("l_partkey", "p_partkey")]).expect_grain(*items.grain)
    return as_double(joined.aggregate("p_brand", n_items=ag.rows(), revenue=ag.total("l_extendedprice", decimal=True)).df, "revenue")


@query("j3_natural_join", """
    SELECT r_name, COUNT(*) AS n_customers FROM customer JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def j3_natural_join(spark, sf):
    customer = frame(spark, sf, "customer").rename({"c_nationkey": "nationkey"})
    nation = frame(spark, sf, "nation").rename({"n_nationkey": "nationkey", "n_regionkey": "regionkey"})
    region = frame(spark, sf, "region").rename({"r_regionkey": "regionkey"})
    joined = customer.natural_join(nation).natural_join(region).expect_grain("c_custkey")
    return joined.aggregate("r_name", n_customers=ag.rows()).df


@query("j4_same_grain", """
    WITH a AS (SELECT o_custkey, COUNT(*) AS n_orders FROM orders GROUP BY o_custkey),
         b AS (SELECT o_custkey, MAX(o_totalprice) AS largest FROM orders GROUP BY o_custkey)
    SELECT o_custkey, n_orders, largest FROM a JOIN b USING (o_custkey)""")
def j4_same_grain(spark, sf):
    orders = frame(spark, sf, "orders")
    a = orders.aggregate("o_custkey", n_orders=ag.rows())
    b = orders.aggregate("o_custkey", largest=ag.greatest("o_totalprice"))
    return a.join_same_grain(b, "o_custkey").df


@query("j5_renamed_keys", """
    SELECT o_orderpriority, COUNT(*) AS n_items, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority""")
def j5_renamed_keys(spark, sf):
    items = frame(spark, sf, "lineitem")
    joined = items.join(frame(spark, sf, "orders"), [("l_orderkey", "o_orderkey")]).expect_grain(*items.grain)
    return as_double(joined.aggregate("o_orderpriority", n_items=ag.rows(), qty=ag.total("l_quantity", decimal=True)).df, "qty")


@query("j6_theta_join", """
    WITH band AS (SELECT o_orderpriority AS band, MIN(o_totalprice) AS low, MAX(o_totalprice) AS high
                  FROM orders GROUP BY o_orderpriority)
    SELECT band, o_orderpriority, COUNT(*) AS n FROM orders JOIN band ON o_totalprice > low AND o_totalprice < high
    GROUP BY band, o_orderpriority""")
def j6_theta_join(spark, sf):
    orders = frame(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    bands = (
        orders.aggregate("o_orderpriority", low=ag.least("o_totalprice"), high=ag.greatest("o_totalprice"))
        .rename({"o_orderpriority": "band"})
    )
    joined = orders.range_join(bands, "o_totalprice", "low", "high", closed="neither").expect_grain("o_orderkey", "band")
    return joined.aggregate(["band", "o_orderpriority"], n=ag.rows()).df


@query("j6_range_join", """
    WITH p AS (SELECT event_id AS purchase, user_id, ts AS bought, ts + to_minutes(CAST(FLOOR(value) AS BIGINT)) AS until FROM events WHERE event_type = 'purchase')
    SELECT purchase, COUNT(*) AS n_after, MIN(ts) AS first_after FROM events e JOIN p ON e.user_id = p.user_id AND ts > bought AND ts <= until
    GROUP BY purchase""")
def j6_range_join(spark, sf):
    """What a user did in the minutes after a purchase, as many as its value; windows of very different lengths."""
    events = frame(spark, sf, "events")
    until = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.floor("value").cast("int"))
    windows = (
        events.where(F.col("event_type") == "purchase").extend(until=until)
        .select("event_id", "user_id", "ts", "until").rename({"event_id": "purchase", "ts": "bought"})
    )
    seen = events.select("event_id", "user_id", "ts").range_join(windows, "ts", "bought", "until", closed="high", equal="user_id")
    return seen.expect_grain("event_id", "purchase").aggregate("purchase", n_after=ag.rows(), first_after=ag.least("ts")).df


@query("j7_predicate_join", """
    SELECT event_type, COUNT(*) AS n FROM events JOIN customer ON user_id = c_custkey AND value * 100 > c_acctbal
    GROUP BY event_type""")
def j7_predicate_join(spark, sf):
    joined = frame(spark, sf, "events").theta_join(
        frame(spark, sf, "customer"), F.col("value") * 100 > F.col("c_acctbal"), equal=[("user_id", "c_custkey")]
    )
    return joined.aggregate("event_type", n=ag.rows()).df


@query("j8_product", """
    WITH s AS (SELECT DISTINCT o_orderstatus FROM orders), p AS (SELECT DISTINCT o_orderpriority FROM orders),
         n AS (SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders WHERE o_totalprice > 400000 GROUP BY 1, 2)
    SELECT o_orderstatus, o_orderpriority, COALESCE(n, 0) AS n
    FROM s CROSS JOIN p LEFT JOIN n USING (o_orderstatus, o_orderpriority)""")
def j8_product(spark, sf):
    orders = frame(spark, sf, "orders")
    every = orders.project_distinct("o_orderstatus").product(orders.project_distinct("o_orderpriority"), grid=(2, 2))
    n = orders.where(F.col("o_totalprice") > 400000).aggregate(["o_orderstatus", "o_orderpriority"], n=ag.rows())
    full = every.join(n, ["o_orderstatus", "o_orderpriority"], "left").expect_grain("o_orderstatus", "o_orderpriority")
    return full.df.withColumn("n", F.coalesce("n", F.lit(0)))


@query("j9_full_outer", """
    WITH o AS (SELECT o_custkey, o_totalprice FROM orders UNION ALL SELECT -o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'P'),
         a AS (SELECT o_custkey AS k, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS spent FROM o GROUP BY 1),
         b AS (SELECT user_id AS k, COUNT(*) AS n_events FROM events GROUP BY 1)
    SELECT COALESCE(a.k, b.k) AS customer, CAST(COALESCE(spent, 0) AS DOUBLE) AS spent, COALESCE(n_events, 0) AS n_events
    FROM a FULL JOIN b ON a.k = b.k""")
def j9_full_outer(spark, sf):
    """All orders and all events; copies of some orders under customers that do not exist stay alone, as do most users."""
    orders = raw(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    lost = orders.filter("o_orderstatus = 'P'").withColumns({"o_custkey": -F.col("o_custkey"), "o_orderkey": -F.col("o_orderkey")})
    both = source(orders.unionByName(lost), "o_orderkey", measures=["o_totalprice"])
    a = both.rename({"o_custkey": "customer"}).aggregate("customer", spent=ag.total("o_totalprice", decimal=True))
    b = frame(spark, sf, "events").rename({"user_id": "customer"}).aggregate("customer", n_events=ag.rows())
    return as_double(a.full_join_totals(b, ["customer"]).expect_grain("customer").df, "spent")


@query("j10_left_outer", """
    WITH e AS (SELECT user_id, COUNT(*) AS n_events, MAX(ts) AS last_seen FROM events GROUP BY user_id)
    SELECT c_custkey, c_mktsegment, COALESCE(n_events, 0) AS n_events, last_seen FROM customer LEFT JOIN e ON c_custkey = user_id""")
def j10_left_outer(spark, sf):
    e = frame(spark, sf, "events").aggregate("user_id", n_events=ag.rows(), last_seen=ag.greatest("ts"))
    joined = frame(spark, sf, "customer").join(e, [("c_custkey", "user_id")], "left").expect_grain("c_custkey")
    return joined.select("c_custkey", "c_mktsegment", "n_events", "last_seen").df.fillna(0, ["n_events"])


@query("j11_semi_join", """
    SELECT o_orderkey, o_orderstatus FROM orders WHERE EXISTS
        (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def j11_semi_join(spark, sf):
    returned = frame(spark, sf, "lineitem").where(F.col("l_returnflag") == "R")
    kept = frame(spark, sf, "orders").semi_join(returned, [("o_orderkey", "l_orderkey")]).expect_grain("o_orderkey")
    return kept.select("o_orderkey", "o_orderstatus").df


@query("j12_anti_join", """
    SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def j12_anti_join(spark, sf):
    left = frame(spark, sf, "orders").anti_join(frame(spark, sf, "lineitem"), [("o_orderkey", "l_orderkey")])
    return left.expect_grain("o_orderkey").select("o_orderkey", "o_custkey").df


@query("j13_self_join", """
    WITH n AS (SELECT o_custkey, o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1, 2)
    SELECT a.o_custkey, a.n AS n_r1, b.n AS n_r2 FROM n a JOIN n b ON a.o_custkey = b.o_custkey
    WHERE a.o_orderstatus = 'O' AND b.o_orderstatus = 'F'""")
def j13_self_join(spark, sf):
    n = frame(spark, sf, "orders").aggregate(["o_custkey", "o_orderstatus"], n=ag.rows())
    both = n.where(F.col("o_orderstatus") == "O").join(n.where(F.col("o_orderstatus") == "F"), "o_custkey")
    both.expect_grain("o_custkey", "o_orderstatus_r1", "o_orderstatus_r2")
    return both.df.select("o_custkey", "n_r1", "n_r2")


@query("j14_nongrain_join", """
    SELECT c_nationkey, COUNT(*) AS n_pairs, COUNT(DISTINCT c_custkey) AS n_customers, COUNT(DISTINCT s_suppkey) AS n_suppliers
    FROM customer JOIN supplier ON c_nationkey = s_nationkey GROUP BY 1""")
def j14_nongrain_join(spark, sf):
    """Neither grain is in the join key, so both are needed to tell a result row."""
    joined = frame(spark, sf, "customer").join(frame(spark, sf, "supplier"), [("c_nationkey", "s_nationkey")])
    return joined.expect_grain("c_custkey", "s_suppkey").aggregate(
        "c_nationkey", n_pairs=ag.rows(), n_customers=ag.different("c_custkey"), n_suppliers=ag.different("s_suppkey")
    ).df


@query("j14_join_size", """
    WITH a AS (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, COUNT(*) AS n FROM supplier GROUP BY 1)
    SELECT CAST(SUM(COALESCE(a.n, 0)) AS BIGINT) AS n_left, CAST(SUM(COALESCE(b.n, 0)) AS BIGINT) AS n_right,
           CAST(SUM(COALESCE(a.n, 0) * COALESCE(b.n, 0)) AS BIGINT) AS n_result,
           CAST(COALESCE(SUM(a.n) FILTER (WHERE b.k IS NULL), 0) AS BIGINT) AS left_unmatched,
           CAST(COALESCE(SUM(b.n) FILTER (WHERE a.k IS NULL), 0) AS BIGINT) AS right_unmatched
    FROM a FULL JOIN b ON a.k = b.k""")
def j14_join_size(spark, sf):
    """How large that join is, counted by key without joining."""
    size = traps.join_size(raw(spark, sf, "customer"), raw(spark, sf, "supplier"), [("c_nationkey", "s_nationkey")])
    return size.withColumn("n_result", F.col("n_result").cast("long"))


@query("j15_subset_join", """
    WITH a AS (SELECT o_custkey, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY 1, 2),
         b AS (SELECT o_custkey, o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1, 2)
    SELECT o_orderpriority, o_orderstatus, COUNT(*) AS n_pairs, CAST(SUM(a.n * b.n) AS BIGINT) AS n_products
    FROM a JOIN b USING (o_custkey) GROUP BY 1, 2""")
def j15_subset_join(spark, sf):
    orders = frame(spark, sf, "orders")
    a = orders.aggregate(["o_custkey", "o_orderpriority"], n=ag.rows())
    b = orders.aggregate(["o_custkey", "o_orderstatus"], n=ag.rows())
    j = a.join(b, "o_custkey").expect_grain("o_custkey", "o_orderpriority", "o_orderstatus")
    return j.df.groupBy("o_orderpriority", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.sum(F.col("n_r1") * F.col("n_r2")).alias("n_products")
    )


@query("j16_as_of", """
    SELECT p.event_id, v.ts AS since, v.value AS seen_value
    FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def j16_as_of(spark, sf):
    events = raw(spark, sf, "events")
    bought = events.filter(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    seen = events.filter(F.col("event_type") == "view").select(
        "user_id", F.col("ts").alias("since"), F.col("value").alias("seen_value")
    )
    return od.as_of(bought, seen, ["user_id"], "ts", "since", ["seen_value"]).select("event_id", "since", "seen_value")


# Grouping --------------------------------------------------------------------

@query("a1_group_by", """
    SELECT l_returnflag, l_linestatus, COUNT(*) AS n_items, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty,
           MIN(l_shipdate) AS first_ship, MAX(l_shipdate) AS last_ship
    FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def a1_group_by(spark, sf):
    out = frame(spark, sf, "lineitem").aggregate(
        ["l_returnflag", "l_linestatus"], n_items=ag.rows(), qty=ag.total("l_quantity", decimal=True),
        first_ship=ag.least("l_shipdate"), last_ship=ag.greatest("l_shipdate"),
    )
    return as_double(out.df, "qty")


@query("a2_group_collect", """
    SELECT o_custkey, COUNT(*) AS n_members, MIN(o_orderkey) AS first_member, MAX(o_orderkey) AS last_member
    FROM orders GROUP BY o_custkey""")
def a2_group_collect(spark, sf):
    groups = frame(spark, sf, "orders").select("o_custkey", "o_orderkey").collect_groups(["o_custkey"], ["o_orderkey"])
    last = lambda c: F.element_at(c, -1)
    return groups.df.groupBy("o_custkey").agg(
        F.sum(F.size("members")).cast("long").alias("n_members"),
        F.min(F.col("members")[0]["o_orderkey"]).alias("first_member"),
        F.max(last("members")["o_orderkey"]).alias("last_member"),
    )


@query("a3_count", "SELECT COUNT(*) AS n FROM lineitem")
def a3_count(spark, sf):
    return frame(spark, sf, "lineitem").aggregate([], n=ag.rows()).df


@query("a4_latest", """
    SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def a4_latest(spark, sf):
    orders = frame(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return orders.latest(["o_orderdate", "o_orderkey"], keys=["o_custkey"]).expect_grain("o_custkey").df


@query("a5_group_sum", """
    SELECT l_orderkey, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, COUNT(DISTINCT l_suppkey) AS n_suppliers
    FROM lineitem GROUP BY l_orderkey""")
def a5_group_sum(spark, sf):
    out = frame(spark, sf, "lineitem").aggregate_to(
        ["l_orderkey"], revenue=ag.total("l_extendedprice", decimal=True), n_suppliers=ag.different("l_suppkey")
    )
    return as_double(out.df, "revenue")


@query("a6_distinct_tuples", "SELECT COUNT(*) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)")
def a6_distinct_tuples(spark, sf):
    return ag.distinct_count(raw(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"])


@query("a7_count_if", """
    SELECT o_orderpriority, COUNT(*) AS n, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS n_final,
           COUNT(*) FILTER (WHERE o_totalprice > 300000) AS n_large FROM orders GROUP BY o_orderpriority""")
def a7_count_if(spark, sf):
    return ag.distribution(
        raw(spark, sf, "orders"), ["o_orderpriority"], n_final=F.col("o_orderstatus") == "F", n_large=F.col("o_totalprice") > 300000
    )


@query("a8_rows_per_grain", "SELECT COUNT(*) AS n_keys, CAST(MAX(c) AS BIGINT) AS most FROM (SELECT COUNT(*) AS c FROM events GROUP BY user_id, ts)")
def a8_rows_per_grain(spark, sf):
    per_grain = frame(spark, sf, "events").rows_per_grain()
    return per_grain.agg(F.count(F.lit(1)).alias("n_keys"), F.max("count").alias("most"))


@query("a9_ordered_fold", """
    WITH s AS (SELECT user_id, event_type, LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before,
                      ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
    SELECT user_id, COUNT(*) FILTER (WHERE rn > 1 AND before <> event_type) AS n_changes FROM s GROUP BY user_id""")
def a9_ordered_fold(spark, sf):
    state = lambda first, last, n: F.struct(first.alias("first"), last.alias("last"), n.cast("long").alias("n"))
    none = F.lit(None).cast("string")
    changed = lambda a, b: F.when(a.isNotNull() & b.isNotNull() & (a != b), F.lit(1)).otherwise(F.lit(0))
    folded = ag.ordered_fold(
        raw(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type"),
        start=state(none, none, F.lit(0)),
        step=lambda acc, x: state(F.coalesce(acc["first"], x), x, acc["n"] + changed(acc["last"], x)),
        merge=lambda a, b: state(
            F.coalesce(a["first"], b["first"]), F.coalesce(b["last"], a["last"]), a["n"] + b["n"] + changed(a["last"], b["first"])
        ),
    )
    return folded.select("user_id", F.col("folded.n").alias("n_changes"))


@query("a10_distribution", """
    SELECT n_items, COUNT(*) AS n, COUNT(*) FILTER (WHERE n_parts = n_items) AS all_parts_differ FROM (
        SELECT l_orderkey, COUNT(*) AS n_items, COUNT(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY l_orderkey) GROUP BY n_items""")
def a10_distribution(spark, sf):
    per_order = frame(spark, sf, "lineitem").aggregate("l_orderkey", n_items=ag.rows(), n_parts=ag.different("l_partkey"))
    return ag.distribution(per_order.df, ["n_items"], all_parts_differ=F.col("n_parts") == F.col("n_items"))


# Order, top rows, distinct ---------------------------------------------------

@query("o1_top_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def o1_top_rows(spark, sf):
    top = frame(spark, sf, "orders").top(50, F.col("o_totalprice").desc(), F.col("o_orderkey"))
    return top.select("o_orderkey", "o_totalprice").df


@query("o2_distinct_on", """
    SELECT o_custkey, o_orderstatus, o_orderkey, o_totalprice FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def o2_distinct_on(spark, sf):
    best = frame(spark, sf, "orders").first_per(["o_custkey", "o_orderstatus"], [F.col("o_totalprice").desc(), F.col("o_orderkey")])
    return best.df.select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice")


@query("o3_distinct", "SELECT DISTINCT lang, source FROM documents")
def o3_distinct(spark, sf):
    return frame(spark, sf, "documents").project_distinct("lang", "source").df


@query("o4_shuffle", "SELECT o_orderkey FROM orders")
def o4_shuffle(spark, sf):
    from rowgrain.sources.generate import shuffled

    return shuffled(raw(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 42)


# Set operations --------------------------------------------------------------

def _slices(spark, sf):
    orders = frame(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return orders.where(F.col("o_orderstatus") != "P"), orders.where(F.col("o_orderstatus") != "O")


_SLICES = """
    WITH a AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'P'),
         b AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'O')"""


@query("u1_union", _SLICES + " SELECT * FROM a UNION SELECT * FROM b")
def u1_union(spark, sf):
    return st.union_rows(*_slices(spark, sf), rows_agree=True).expect_grain("o_orderkey").df


@query("u1_intersect", _SLICES + " SELECT * FROM a INTERSECT SELECT * FROM b")
def u1_intersect(spark, sf):
    return st.intersect_rows(*_slices(spark, sf)).df


@query("u1_subtract", _SLICES + " SELECT * FROM a EXCEPT SELECT * FROM b")
def u1_subtract(spark, sf):
    return st.subtract_rows(*_slices(spark, sf)).df


@query("u2_tagged_union", """
    SELECT 'customer' AS party, c_custkey, c_nationkey, NULL AS s_suppkey, NULL AS s_nationkey FROM customer
    UNION ALL SELECT 'supplier', NULL, NULL, s_suppkey, s_nationkey FROM supplier""")
def u2_tagged_union(spark, sf):
    customer = frame(spark, sf, "customer").select("c_custkey", "c_nationkey")
    supplier = frame(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return st.tagged_union("party", customer=customer, supplier=supplier).expect_grain("party", "c_custkey", "s_suppkey").df


@query("u3_shared_columns", "SELECT o_custkey, n_orders FROM (SELECT o_custkey, COUNT(*) AS n_orders FROM orders GROUP BY 1)")
def u3_shared_columns(spark, sf):
    orders = frame(spark, sf, "orders")
    per_customer = orders.aggregate("o_custkey", n_orders=ag.rows())
    per_status = orders.aggregate(["o_custkey", "o_orderstatus"], n_rows=ag.rows(), n_orders=ag.different("o_orderkey"))
    return st.shared_columns(per_status, per_customer).expect_grain("o_custkey").df


@query("u3_all_columns", """
    SELECT o_custkey, o_orderstatus, n_rows, n_orders FROM (SELECT o_custkey, o_orderstatus, COUNT(*) AS n_rows FROM orders GROUP BY 1, 2)
    JOIN (SELECT o_custkey, COUNT(*) AS n_orders FROM orders GROUP BY 1) USING (o_custkey)""")
def u3_all_columns(spark, sf):
    orders = frame(spark, sf, "orders")
    per_customer = orders.aggregate("o_custkey", n_orders=ag.rows())
    per_status = orders.aggregate(["o_custkey", "o_orderstatus"], n_rows=ag.rows())
    return st.all_columns(per_status, per_customer).expect_grain("o_custkey", "o_orderstatus").df


# Scalar functions ------------------------------------------------------------

@query("f_scalar_functions", """
    SELECT o_orderkey, 'O' || LPAD(CAST(o_orderkey AS VARCHAR), 12, '0') AS code, o_orderkey // 7 AS quotient, o_orderkey % 7 AS remainder,
           CAST(o_orderdate AS DATE) + 30 AS due, o_custkey || '|' || o_orderstatus AS text_key, COALESCE(NULLIF(o_orderstatus, 'P'), 'open') AS status,
           (o_custkey, o_orderstatus) = (o_orderkey, 'F') AS same_tuple FROM orders""")
def f_scalar_functions(spark, sf):
    return raw(spark, sf, "orders").select(
        "o_orderkey", code("O", F.col("o_orderkey"), 12).alias("code"), whole_division(F.col("o_orderkey"), 7).alias("quotient"),
        (F.col("o_orderkey") % 7).alias("remainder"), F.date_add(F.col("o_orderdate").cast("date"), 30).alias("due"),
        F.array_join(F.array(F.col("o_custkey").cast("string"), "o_orderstatus"), "|").alias("text_key"),
        F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("open")).alias("status"),
        (F.struct(F.col("o_custkey").alias("a"), F.col("o_orderstatus").alias("b")) == F.struct(F.col("o_orderkey").alias("a"), F.lit("F").alias("b"))).alias("same_tuple"),
    )
