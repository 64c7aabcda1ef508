"""Collections with one row per grain value: changing them and comparing them.

Two overlapping slices of orders play the collections.  In the second one,
urgent orders have another price, so the overlap has conflicts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rowgrain.operators import collections as co
from rowgrain.queries.catalog import query, raw

K = ["o_orderkey"]
COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]


def slices(spark, sf):
    orders = raw(spark, sf, "orders")
    left = orders.filter(F.col("o_orderstatus") != "P").select(*COLS)
    dearer = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") + 1000).otherwise(F.col("o_totalprice"))
    right = orders.filter(F.col("o_orderstatus") != "O").withColumn("o_totalprice", dearer).select(*COLS)
    return left, right


SLICES = """
    WITH a AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'P'),
         b AS (SELECT o_orderkey, o_custkey, o_orderstatus,
                      CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 1000 ELSE o_totalprice END AS o_totalprice
               FROM orders WHERE o_orderstatus <> 'O')
"""
_NOT_IN_A = "o_orderkey NOT IN (SELECT o_orderkey FROM a)"
_NOT_IN_B = "o_orderkey NOT IN (SELECT o_orderkey FROM b)"


@query("c1_empty", "SELECT COUNT(*) AS n FROM orders WHERE o_totalprice < 0")
def c1_empty(spark, sf):
    orders = raw(spark, sf, "orders")
    none = co.empty(spark, orders.schema)
    return none.unionByName(orders.filter(F.col("o_totalprice") < 0)).agg(F.count(F.lit(1)).alias("n"))


@query("c2_lookup", """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    WHERE o_orderkey = (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1)""")
def c2_lookup(spark, sf):
    """Look up the order that turns out to be the largest."""
    orders = raw(spark, sf, "orders")
    largest = orders.orderBy(F.col("o_totalprice").desc(), "o_orderkey").select("o_orderkey").first()
    return co.lookup(orders, K, largest.asDict()).select("o_orderkey", "o_custkey", "o_totalprice")


@query("c2_lookup_many", SLICES + "SELECT * FROM a WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def c2_lookup_many(spark, sf):
    asked = raw(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))
    return co.lookup_many(slices(spark, sf)[0], K, asked)


@query("c3_member", SLICES + """
    SELECT a.*, COALESCE(b.o_custkey = a.o_custkey AND b.o_orderstatus = a.o_orderstatus AND b.o_totalprice = a.o_totalprice, FALSE) AS is_member
    FROM a LEFT JOIN b ON a.o_orderkey = b.o_orderkey""")
def c3_member(spark, sf):
    left, right = slices(spark, sf)
    return co.contains(right, left, K)


@query("c4_insert", SLICES + f"SELECT * FROM a UNION ALL SELECT * FROM b WHERE {_NOT_IN_A}")
def c4_insert(spark, sf):
    left, right = slices(spark, sf)
    return co.insert(left, right, K, ["o_totalprice"])


@query("c5_delete", SLICES + f"SELECT * FROM a WHERE {_NOT_IN_B}")
def c5_delete(spark, sf):
    return co.delete(*slices(spark, sf), K)


@query("c5_upsert", SLICES + f"SELECT * FROM a WHERE {_NOT_IN_B} UNION ALL SELECT * FROM b")
def c5_upsert(spark, sf):
    return co.upsert(*slices(spark, sf), K, ["o_totalprice"])


@query("c6_union", SLICES + f"SELECT * FROM b UNION ALL SELECT * FROM a WHERE {_NOT_IN_B}")
def c6_union(spark, sf):
    return co.union(*slices(spark, sf), K)


@query("c7_intersection", SLICES + "SELECT * FROM a WHERE o_orderkey IN (SELECT o_orderkey FROM b)")
def c7_intersection(spark, sf):
    return co.intersection(*slices(spark, sf), K)


@query("c8_difference", SLICES + f"SELECT * FROM a WHERE {_NOT_IN_B}")
def c8_difference(spark, sf):
    return co.difference(*slices(spark, sf), K)


@query("c9_conflicts", SLICES + """
    SELECT a.o_orderkey, a.o_totalprice AS left_price, b.o_totalprice AS right_price FROM a JOIN b USING (o_orderkey)
    WHERE a.o_totalprice <> b.o_totalprice""")
def c9_conflicts(spark, sf):
    found = co.conflicts(*slices(spark, sf), K)
    return found.select(
        "o_orderkey", F.col("left_row.o_totalprice").alias("left_price"), F.col("right_row.o_totalprice").alias("right_price")
    )


@query("c11_dedup", """
    SELECT user_id, event_type, event_id FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""")
def c11_dedup(spark, sf):
    first = co.dedup(raw(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"])
    return first.select("user_id", "event_type", "event_id")


@query("c12_some_element", SLICES + "SELECT * FROM a ORDER BY o_orderkey LIMIT 1")
def c12_some_element(spark, sf):
    return co.some_element(slices(spark, sf)[0], K)


# Keys with NULL ----------------------------------------------------------------
#
# Documents without a label have NULL for quality.  One row per quality and language; the second collection lacks a
# language, has one the first lacks, and counts characters in some rows, so that keys with NULL agree, differ and miss.

NK = ["quality", "lang"]
NULL_SIDES = """
    WITH g AS (SELECT quality, lang, COUNT(*) AS n, CAST(SUM(n_chars) AS BIGINT) AS chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2),
         a AS (SELECT quality, lang, n FROM g WHERE lang <> 'es'),
         b AS (SELECT quality, lang, CASE WHEN lang = 'en' THEN chars ELSE n END AS n FROM g WHERE lang <> 'de')
"""
_SAME = "a.quality IS NOT DISTINCT FROM b.quality AND a.lang = b.lang"
_ONLY_A = f"SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {_SAME})"
_ONLY_B = f"SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE {_SAME})"


def null_sides(spark, sf):
    labelled = raw(spark, sf, "documents").join(raw(spark, sf, "labels"), "doc_id", "left")
    groups = labelled.groupBy(*NK).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    left = groups.filter(F.col("lang") != "es").select(*NK, "n")
    other = F.when(F.col("lang") == "en", F.col("chars")).otherwise(F.col("n")).alias("n")
    return left, groups.filter(F.col("lang") != "de").select(*NK, other)


@query("c2_lookup_null_keys", NULL_SIDES + f"SELECT * FROM a WHERE EXISTS (SELECT 1 FROM b WHERE {_SAME})")
def c2_lookup_null_keys(spark, sf):
    left, right = null_sides(spark, sf)
    return co.lookup_many(left, NK, right)


@query("c3_member_null_keys", NULL_SIDES + f"SELECT a.*, COALESCE(a.n = b.n, FALSE) AS is_member FROM a LEFT JOIN b ON {_SAME}")
def c3_member_null_keys(spark, sf):
    left, right = null_sides(spark, sf)
    return co.contains(right, left, NK)


@query("c4_insert_null_keys", NULL_SIDES + f"SELECT * FROM a UNION ALL {_ONLY_B}")
def c4_insert_null_keys(spark, sf):
    return co.insert(*null_sides(spark, sf), NK, ["n"])


@query("c5_upsert_null_keys", NULL_SIDES + f"{_ONLY_A} UNION ALL SELECT * FROM b")
def c5_upsert_null_keys(spark, sf):
    return co.upsert(*null_sides(spark, sf), NK, ["n"])


@query("c6_union_null_keys", NULL_SIDES + f"SELECT * FROM b UNION ALL {_ONLY_A}")
def c6_union_null_keys(spark, sf):
    return co.union(*null_sides(spark, sf), NK)


@query("c8_difference_null_keys", NULL_SIDES + _ONLY_A)
def c8_difference_null_keys(spark, sf):
    return co.difference(*null_sides(spark, sf), NK)


@query("c9_conflicts_null_keys", NULL_SIDES + f"""
    SELECT a.quality, a.lang, a.n AS left_n, b.n AS right_n FROM a JOIN b ON {_SAME} WHERE a.n <> b.n""")
def c9_conflicts_null_keys(spark, sf):
    found = co.conflicts(*null_sides(spark, sf), NK)
    return found.select(*NK, F.col("left_row.n").alias("left_n"), F.col("right_row.n").alias("right_n"))


# Comparisons -----------------------------------------------------------------

def compare_sql(n_left, n_right, only_left, only_right):
    return f"""
        SELECT *, only_left = 0 AND only_right = 0 AS equal, only_left = 0 AS subset, only_left = 0 AND only_right > 0 AS proper_subset FROM (
            SELECT ({n_left}) AS n_left, ({n_right}) AS n_right, ({only_left}) AS only_left, ({only_right}) AS only_right)"""


def _sides(a, b):
    return compare_sql(
        f"SELECT COUNT(*) FROM ({a})", f"SELECT COUNT(*) FROM ({b})",
        f"SELECT COUNT(*) FROM (SELECT * FROM ({a}) EXCEPT ALL SELECT * FROM ({b}))",
        f"SELECT COUNT(*) FROM (SELECT * FROM ({b}) EXCEPT ALL SELECT * FROM ({a}))",
    )


@query("r1_equal", SLICES + _sides("SELECT * FROM a", "SELECT * FROM b"))
def r1_equal(spark, sf):
    return co.compare_rows(*slices(spark, sf))


@query("r2_equal_grains", _sides("SELECT DISTINCT o_orderkey FROM orders", "SELECT DISTINCT l_orderkey FROM lineitem"))
def r2_equal_grains(spark, sf):
    return co.compare_keys(raw(spark, sf, "orders"), raw(spark, sf, "lineitem"), ["o_orderkey"], ["l_orderkey"])


@query("r3_equal_entities", _sides("SELECT DISTINCT c_custkey FROM customer", "SELECT DISTINCT o_custkey FROM orders"))
def r3_equal_entities(spark, sf):
    return co.compare_keys(raw(spark, sf, "customer"), raw(spark, sf, "orders"), ["c_custkey"], ["o_custkey"])


@query("r4_same_count", SLICES + "SELECT (SELECT COUNT(*) FROM a) AS n_left, (SELECT COUNT(*) FROM b) AS n_right, (SELECT COUNT(*) FROM a) = (SELECT COUNT(*) FROM b) AS same_count")
def r4_same_count(spark, sf):
    return co.same_count(*slices(spark, sf))


@query("r5_subset", SLICES + _sides("SELECT * FROM a WHERE o_orderstatus = 'O'", "SELECT * FROM a"))
def r5_subset(spark, sf):
    left, _ = slices(spark, sf)
    return co.compare_rows(left.filter(F.col("o_orderstatus") == "O"), left)


@query("r6_subset_grains", _sides("SELECT DISTINCT doc_id FROM labels", "SELECT DISTINCT doc_id FROM documents"))
def r6_subset_grains(spark, sf):
    return co.compare_keys(raw(spark, sf, "labels"), raw(spark, sf, "documents"), ["doc_id"], ["doc_id"])


@query("r7_subset_entities", _sides("SELECT DISTINCT user_id FROM events", "SELECT DISTINCT c_custkey FROM customer"))
def r7_subset_entities(spark, sf):
    return co.compare_keys(raw(spark, sf, "events"), raw(spark, sf, "customer"), ["user_id"], ["c_custkey"])


@query("r8_partition", """
    SELECT 'by_status' AS split, COUNT(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F', 'P')) AS n_missing, 0::BIGINT AS n_foreign, 0::BIGINT AS n_overlapping,
           COUNT(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F', 'P')) = 0 AS is_partition FROM orders
    UNION ALL SELECT 'overlapping', 0::BIGINT, 0::BIGINT, COUNT(*) FILTER (WHERE o_orderstatus = 'F'), COUNT(*) FILTER (WHERE o_orderstatus = 'F') = 0 FROM orders""")
def r8_partition(spark, sf):
    orders = raw(spark, sf, "orders")
    parts = [orders.filter(F.col("o_orderstatus") == s) for s in ("O", "F", "P")]
    by_status = co.partition_check(orders, parts, K).withColumn("split", F.lit("by_status"))
    return by_status.unionByName(
        co.partition_check(orders, list(slices(spark, sf)), K).withColumn("split", F.lit("overlapping"))
    )
