"""Joins of two tables."""

from pyspark.sql import functions as F

from ..joins import asof_join, keyed_join, overlap_join, range_join, theta_join
from .base import query, rounded, source, table


@query("heavy_key_join", """
WITH l AS (SELECT CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE l_partkey END AS k, l_quantity, l_extendedprice FROM lineitem)
SELECT p_brand, p_type, count(*) AS n, sum(l_quantity) AS quantity, round(sum(l_extendedprice), 2) AS price
FROM l JOIN part ON k = p_partkey GROUP BY p_brand, p_type""")
def _heavy_key(spark, sf_dir):
    lines = source(spark, sf_dir, "SELECT CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE l_partkey END AS k, l_quantity, l_extendedprice FROM lineitem")
    joined = keyed_join(lines, table(spark, sf_dir, "part"), [("k", "p_partkey")], rows_per_task=50_000)
    return joined.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"),
                                                   F.round(F.sum("l_extendedprice"), 2).alias("price"))


_LARGE = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 450000"
for _how, _sql in {
    "left": "SELECT c_custkey, c_nationkey, o_orderkey, o_totalprice FROM customer LEFT JOIN o ON c_custkey = o_custkey",
    "semi": "SELECT c_custkey, c_nationkey FROM customer SEMI JOIN o ON c_custkey = o_custkey",
    "anti": "SELECT c_custkey, c_nationkey FROM customer ANTI JOIN o ON c_custkey = o_custkey",
}.items():
    @query(f"{_how}_join_large_orders", f"WITH o AS ({_LARGE}) {_sql}")
    def _large_orders(spark, sf_dir, how=_how):
        customers = source(spark, sf_dir, "SELECT c_custkey, c_nationkey FROM customer")
        return keyed_join(customers, source(spark, sf_dir, _LARGE), [("c_custkey", "o_custkey")], how, rows_per_task=5_000)


@query("full_join_nations", """
WITH c AS (SELECT c_nationkey AS nation, c_custkey FROM customer WHERE c_nationkey < 15 AND c_acctbal > 9000),
s AS (SELECT s_nationkey AS nation, s_suppkey FROM supplier WHERE s_nationkey > 5)
SELECT coalesce(c.nation, s.nation) AS nation, c_custkey, s_suppkey FROM c FULL JOIN s ON c.nation = s.nation""")
def _full_join(spark, sf_dir):
    left = source(spark, sf_dir, "SELECT c_nationkey AS nation, c_custkey FROM customer WHERE c_nationkey < 15 AND c_acctbal > 9000")
    right = source(spark, sf_dir, "SELECT s_nationkey AS nation, s_suppkey FROM supplier WHERE s_nationkey > 5")
    return keyed_join(left, right, "nation", "full", rows_per_task=1_000)


_OPEN = "SELECT o_orderkey, o_custkey, o_orderdate AS opened, o_orderdate + {day} * (o_orderkey % 40) AS done FROM orders"


@query("overlapping_orders", f"""
WITH o AS ({_OPEN.format(day="INTERVAL 1 DAY")})
SELECT a.o_custkey AS customer, a.o_orderkey AS first, b.o_orderkey AS second
FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.opened < b.done AND b.opened < a.done AND a.opened < a.done AND b.opened < b.done
WHERE a.o_orderkey < b.o_orderkey""")
def _overlapping_orders(spark, sf_dir):
    orders = source(spark, sf_dir, _OPEN.format(day="INTERVAL '1' DAY"))
    pairs = overlap_join(orders, orders, ("opened", "done"), ("opened", "done"), "o_custkey", closed=False)
    return pairs.where("o_orderkey < o_orderkey_right").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("first"),
                                                               F.col("o_orderkey_right").alias("second"))


@query("overlapping_balances", """
WITH c AS (SELECT c_acctbal - 10 AS low, c_acctbal + 10 * c_nationkey AS high FROM customer),
s AS (SELECT s_suppkey, s_acctbal - 50 AS low, s_acctbal + CASE WHEN s_suppkey % 9 = 0 THEN 2000 ELSE 50 END AS high FROM supplier)
SELECT s_suppkey, count(*) AS n, round(min(c.low), 4) AS lowest, round(max(c.high), 4) AS highest
FROM c JOIN s ON c.low <= s.high AND s.low <= c.high GROUP BY s_suppkey""")
def _overlapping_balances(spark, sf_dir):
    customers = source(spark, sf_dir, "SELECT c_acctbal - 10 AS low, c_acctbal + 10 * c_nationkey AS high FROM customer")
    suppliers = source(spark, sf_dir, """SELECT s_suppkey, s_acctbal - 50 AS s_low,
        s_acctbal + CASE WHEN s_suppkey % 9 = 0 THEN 2000 ELSE 50 END AS s_high FROM supplier""")
    pairs = overlap_join(customers, suppliers, ("low", "high"), ("s_low", "s_high"), rows_per_task=20_000)
    return rounded(pairs.groupBy("s_suppkey").agg(F.count("*").alias("n"), F.min("low").alias("lowest"), F.max("high").alias("highest")), 4)


_OF = "SELECT event_id, user_id, ts, value FROM events WHERE event_type = '{kind}'"
_SEEN = "SELECT event_id AS seen_id, user_id, ts AS seen, value AS seen_value FROM events WHERE event_type = '{kind}'"


@query("asof_last_view", f"""
SELECT p.event_id, p.user_id, p.ts, v.seen_id, v.seen, v.seen_value
FROM ({_OF.format(kind="purchase")}) p ASOF LEFT JOIN ({_SEEN.format(kind="view")}) v ON p.user_id = v.user_id AND p.ts >= v.seen""")
def _last_view(spark, sf_dir):
    purchases, views = (source(spark, sf_dir, x.format(kind=k)) for x, k in ((_OF, "purchase"), (_SEEN, "view")))
    return asof_join(purchases, views, ("ts", "seen"), "user_id").select("event_id", "user_id", "ts", "seen_id", "seen", "seen_value")


@query("asof_next_error_within_a_day", f"""
SELECT event_id, user_id, ts, CASE WHEN near THEN seen_id END AS seen_id, CASE WHEN near THEN seen END AS seen FROM (
    SELECT p.event_id, p.user_id, p.ts, v.seen_id, v.seen, coalesce(v.seen <= p.ts + INTERVAL 1 DAY, false) AS near
    FROM ({_OF.format(kind="click")}) p ASOF LEFT JOIN ({_SEEN.format(kind="error")}) v ON p.user_id = v.user_id AND p.ts < v.seen)""")
def _next_error(spark, sf_dir):
    clicks, errors = (source(spark, sf_dir, x.format(kind=k)) for x, k in ((_OF, "click"), (_SEEN, "error")))
    found = asof_join(clicks, errors, ("ts", "seen"), "user_id", "forward", F.expr("INTERVAL '1' DAY"), allow_equal=False)
    return found.select("event_id", "user_id", "ts", "seen_id", "seen")


@query("asof_order_before_event", """
SELECT event_id, ts, o_orderkey FROM (SELECT event_id, ts - INTERVAL 9000 DAY AS ts FROM events) e
ASOF LEFT JOIN (SELECT o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_orderdate) o ON e.ts >= o.o_orderdate""")
def _order_before_event(spark, sf_dir):
    shifted = source(spark, sf_dir, "SELECT event_id, ts - INTERVAL '9000' DAY AS ts FROM events")
    found = asof_join(shifted, source(spark, sf_dir, "SELECT o_orderdate, o_orderkey FROM orders"), ("ts", "o_orderdate"))
    return found.select("event_id", "ts", "o_orderkey")


@query("theta_join_poorer_customers", """
SELECT s_suppkey, count(*) AS n, round(max(c_acctbal), 4) AS richest FROM customer JOIN supplier
ON c_nationkey = s_nationkey AND c_acctbal < s_acctbal AND c_custkey > s_suppkey GROUP BY s_suppkey""")
def _poorer_customers(spark, sf_dir):
    pairs = theta_join(table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier"),
                       [("c_acctbal", "<", "s_acctbal"), ("c_custkey", ">", "s_suppkey")], [("c_nationkey", "s_nationkey")], rows_per_bucket=2_000)
    return rounded(pairs.groupBy("s_suppkey").agg(F.count("*").alias("n"), F.max("c_acctbal").alias("richest")), 4)


@query("band_join_orders", """
SELECT c_custkey, count(*) AS n, round(min(o_totalprice), 4) AS lowest, max(o_orderkey) AS last FROM customer
JOIN orders ON o_totalprice BETWEEN c_acctbal * 10 - 50 AND c_acctbal * 10 + 50 GROUP BY c_custkey""")
def _band_join(spark, sf_dir):
    pairs = range_join(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "o_totalprice", F.col("c_acctbal") * 10 - 50,
                       F.col("c_acctbal") * 10 + 50, rows_per_bucket=10_000)
    return rounded(pairs.groupBy("c_custkey").agg(F.count("*").alias("n"), F.min("o_totalprice").alias("lowest"), F.max("o_orderkey").alias("last")), 4)
