"""Grouping sets, distinct aggregates, ranks, neighbours in an order and value-range frames."""

from pyspark.sql import functions as F

from ..functions.ranking import range_frame, ranked, shifted
from ..operators.cubes import cube_sets, distinct_aggregates, grouping_sets, rollup_sets
from .base import query, rounded, source, table

_SEEN = "SELECT o_orderstatus AS status, CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority END AS priority, o_custkey % 10 AS decile, o_totalprice AS price, ln(o_totalprice) AS logged, o_custkey FROM orders"
_SHOWN = """CAST({gid} AS BIGINT) AS grouping_id, count(*) AS n, count(DISTINCT o_custkey) > 0 AS seen, round(sum(price), 2) AS total,
    round(min(price), 2) AS low, round(max(price), 2) AS high, round(avg(logged), 6) AS mean FROM o GROUP BY"""
_ASKED = {"n": (None, "rows"), "seen": ("o_custkey", "approx_distinct"), "total": ("price", "sum"), "low": ("price", "min"), "high": ("price", "max"), "mean": ("logged", "mean")}


def _sets(df, sets):
    found = grouping_sets(df, sets, _ASKED)
    return found.withColumn("seen", F.col("seen") > 0).withColumns({c: F.round(c, 2) for c in ("total", "low", "high")}).withColumn("mean", F.round("mean", 6))


@query("cube_orders", f"WITH o AS ({_SEEN}) SELECT status, priority, decile, {_SHOWN.format(gid='grouping(status, priority, decile)')} CUBE (status, priority, decile)")
def _cube(spark, sf_dir):
    return _sets(source(spark, sf_dir, _SEEN), cube_sets(["status", "priority", "decile"]))


@query("rollup_orders", f"WITH o AS ({_SEEN}) SELECT status, priority, {_SHOWN.format(gid='grouping(status, priority)')} ROLLUP (status, priority)")
def _rollup(spark, sf_dir):
    return _sets(source(spark, sf_dir, _SEEN), rollup_sets(["status", "priority"]))


@query("distinct_lines", """
SELECT l_returnflag, l_linestatus, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, sum(DISTINCT l_quantity) AS quantities,
       round(avg(DISTINCT l_discount), 6) AS discount, max(DISTINCT l_tax) AS tax FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def _distinct_lines(spark, sf_dir):
    return rounded(distinct_aggregates(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], {
        "parts": ("l_partkey", "count"), "suppliers": ("l_suppkey", "count"), "quantities": ("l_quantity", "sum"), "discount": ("l_discount", "mean"), "tax": ("l_tax", "max")}))


@query("rank_quantities", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, rank() OVER w AS place, dense_rank() OVER w AS value_number,
       round(percent_rank() OVER w, 9) AS share, round(cume_dist() OVER w, 9) AS reached FROM lineitem WINDOW w AS (ORDER BY l_quantity)""")
def _rank_quantities(spark, sf_dir):
    lines = source(spark, sf_dir, "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem")
    return rounded(ranked(lines, "l_quantity", {"place": "rank", "value_number": "dense_rank", "share": "percent_rank", "reached": "cume_dist"}), 9)


@query("tiles_of_events", "SELECT event_id, row_number() OVER w AS number, CAST(ntile(13) OVER w AS INTEGER) AS tile FROM events WINDOW w AS (ORDER BY ts)")
def _tiles(spark, sf_dir):
    found = ranked(source(spark, sf_dir, "SELECT event_id, ts FROM events"), "ts", {"number": "row_number"}, {"tile": 13})
    return found.select("event_id", found.number.cast("long").alias("number"), "tile")


@query("neighbours_of_events", """
SELECT event_id, value, lag(value, 1) OVER w AS before, lag(event_type, 4) OVER w AS fourth_before, lead(value, 2) OVER w AS second_after
FROM events WINDOW w AS (ORDER BY ts)""")
def _neighbours(spark, sf_dir):
    events = source(spark, sf_dir, "SELECT event_id, ts, value, event_type FROM events")
    found = shifted(events, "ts", {"before": ("value", 1), "fourth_before": ("event_type", 4), "second_after": ("value", -2)})
    return found.select("event_id", "value", "before", "fourth_before", "second_after")


@query("orders_of_like_price", """
SELECT o_orderkey, count(*) OVER w AS n, max(o_orderkey) OVER w AS last, round(min(o_totalprice) OVER w, 4) AS lowest
FROM orders WINDOW w AS (ORDER BY o_totalprice RANGE BETWEEN 400 PRECEDING AND 250.5 FOLLOWING)""")
def _like_price(spark, sf_dir):
    orders = source(spark, sf_dir, "SELECT o_orderkey, o_totalprice FROM orders")
    found = range_frame(orders, "o_totalprice", 400, 250.5, {"n": "count(*)", "last": "max(o_orderkey)", "lowest": "min(o_totalprice)"})
    return rounded(found.drop("o_totalprice"), 4)
