"""Filters, sorting, sampling, de-duplication, aggregation and reshaping."""

from pyspark.sql import functions as F

from ..functions.values import top_values
from ..plans import apply_steps
from .base import NULLED, NULLED_SEGMENT, PAIRS, query, rounded, source, steps, table

# filters

_LINE = "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE "
for _name, _op, _sql in (("equal", "==", "="), ("not_equal", "!=", "<>"), ("greater", ">", ">"), ("less", "<", "<")):
    steps(f"filter_{_name}", "lineitem", [("filter_rows", {"column": "l_quantity", "operator": _op, "value": "24"})],
          f"{_LINE} l_quantity {_sql} 24", select=["l_orderkey", "l_linenumber", "l_quantity"])
steps("filter_greater_date", "orders",
      [("filter_rows", {"column": "o_orderdate", "operator": ">", "value": "1997-06-15"})],
      "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1997-06-15'",
      select=["o_orderkey", "o_orderdate"])
steps("filter_equal_text", "orders",
      [("filter_rows", {"column": "o_orderpriority", "operator": "==", "value": "1-URGENT"})],
      "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT'",
      select=["o_orderkey", "o_orderpriority"])
steps("filter_contains", "documents",
      [("filter_rows", {"column": "text", "operator": "contains", "value": r"[0-9]{3}-[0-9]+"})],
      "SELECT doc_id, n_chars FROM documents WHERE regexp_matches(text, '[0-9]{3}-[0-9]+')",
      select=["doc_id", "n_chars"])

steps("drop_null_rows_column", NULLED, [("drop_null_rows", {"column": "value"})],
      "SELECT event_id, round(value, 6) AS value FROM events WHERE event_type NOT IN ('error', 'view')",
      select=["event_id", "value"])
_TWO_NULLED = """SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE value END AS a,
              CASE WHEN event_type IN ('view', 'click') THEN NULL ELSE user_id END AS b FROM events"""
steps("drop_null_rows_any", _TWO_NULLED, [("drop_null_rows", {"scope": "any"})],
      """SELECT event_id, round(value, 6) AS a, user_id AS b FROM events
         WHERE event_type NOT IN ('error', 'view', 'click')""")
steps("drop_null_rows_all", _TWO_NULLED.replace("event_id, ", "", 1), [("drop_null_rows", {"scope": "all"})],
      """SELECT round(CASE WHEN event_type = 'error' THEN NULL ELSE value END, 6) AS a,
         CASE WHEN event_type = 'click' THEN NULL ELSE user_id END AS b FROM events WHERE event_type <> 'view'""")
steps("drop_cols_null_threshold",
      """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS mostly,
      CASE WHEN event_type = 'error' THEN value ELSE NULL END AS rarely FROM events""",
      [("drop_cols_null_threshold", {"threshold": 50})],
      """SELECT event_id, round(CASE WHEN event_type = 'error' THEN NULL ELSE value END, 6) AS mostly FROM events""")

# order, limits, samples

@query("sort_ascending", "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders ORDER BY o_totalprice")
def _sort_up(spark, sf_dir):
    df = apply_steps(table(spark, sf_dir, "orders"), [{"type": "sort_column", "params": {"column": "o_totalprice"}}])
    return rounded(df.select("o_orderkey", "o_totalprice"))


steps("sort_descending_nulls_first", NULLED, [("sort_column", {"column": "value", "ascending": False})],
      """SELECT event_id, round(CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE value END, 6) AS value
         FROM events ORDER BY value DESC NULLS FIRST""", select=["event_id", "value"])


@query("first_rows", "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50")
def _first_rows(spark, sf_dir):
    from ..plans.preview import page_of
    return rounded(page_of(table(spark, sf_dir, "orders").orderBy("o_orderkey").select("o_orderkey", "o_totalprice")))


@query("top_values", """SELECT event_type AS value, count(*) AS count FROM events GROUP BY 1
                        ORDER BY 2 DESC, 1 LIMIT 3""")
def _top(spark, sf_dir):
    return top_values(table(spark, sf_dir, "events"), "event_type", 3)


@query("sample_count_size", "SELECT least(2500, count(*)) AS rows, least(2500, count(*)) AS distinct_rows FROM events")
def _sample_count(spark, sf_dir):
    step = {"type": "sample_rows", "params": {"method": "count", "value": 2500, "random_state": 42}}
    sample = apply_steps(table(spark, sf_dir, "events"), [step])
    return sample.agg(F.count("*").alias("rows"), F.count_distinct("event_id").alias("distinct_rows"))


@query("sample_fraction_size", "SELECT CAST(floor(0.15 * count(*)) AS BIGINT) AS rows FROM lineitem")
def _sample_fraction(spark, sf_dir):
    step = {"type": "sample_rows", "params": {"method": "fraction", "value": 0.15}}
    return apply_steps(table(spark, sf_dir, "lineitem"), [step]).agg(F.count("*").alias("rows"))


steps("sample_rows", "events", [("sample_rows", {"value": 100, "random_state": 7})], None)

steps("remove_duplicates", PAIRS, [("remove_duplicates", {})], "SELECT DISTINCT user_id, event_type FROM events")
steps("deduplicate_subset_first", "events",
      [("deduplicate_subset", {"columns": ["user_id", "event_type"], "order_by": "event_id"})],
      """SELECT event_id, user_id, event_type FROM
         (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events)
         WHERE n = 1""", select=["event_id", "user_id", "event_type"])
steps("deduplicate_subset_any", PAIRS, [("deduplicate_subset", {"columns": ["user_id"]}),
                                        ("drop_columns", {"columns": ["event_type"]})],
      "SELECT DISTINCT user_id FROM events")

# aggregation

for _agg, _sql in {"mean": "round(avg(l_extendedprice), 4)", "sum": "round(sum(l_extendedprice), 2)",
                   "count": "count(l_extendedprice)", "min": "min(l_extendedprice)",
                   "max": "max(l_extendedprice)"}.items():
    steps(f"group_{_agg}", "lineitem",
          [("groupby_aggregate", {"group_cols": ["l_returnflag", "l_linestatus"], "agg_col": "l_extendedprice",
                                  "agg_type": _agg})],
          f"""SELECT l_returnflag, l_linestatus, {_sql} AS l_extendedprice FROM lineitem GROUP BY 1, 2""",
          digits=4 if _agg == "mean" else 2)
steps("group_sum_null_key", NULLED_SEGMENT,
      [("groupby_aggregate", {"group_cols": ["seg"], "agg_col": "c_nationkey", "agg_type": "sum"})],
      """SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_mktsegment END AS seg,
         CAST(sum(c_nationkey) AS BIGINT) AS c_nationkey FROM customer GROUP BY 1""")
steps("group_sum_all_null", NULLED,
      [("groupby_aggregate", {"group_cols": ["event_type"], "agg_col": "value", "agg_type": "sum"})],
      """SELECT event_type, round(coalesce(sum(CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE value END), 0), 4)
         AS value FROM events GROUP BY 1""", digits=4)

steps("filter_group_sort", "lineitem",
      [("filter_rows", {"column": "l_quantity", "operator": ">", "value": "10"}),
       ("groupby_aggregate", {"group_cols": ["l_returnflag"], "agg_col": "l_extendedprice", "agg_type": "mean"}),
       ("sort_column", {"column": "l_returnflag"})],
      """SELECT l_returnflag, round(avg(l_extendedprice), 4) AS l_extendedprice FROM lineitem
         WHERE l_quantity > 10 GROUP BY 1 ORDER BY 1""", digits=4)

# reshaping

_STATUS = ("F", "O", "P")
for _fn, _sql, _digits in (("mean", "avg", 6), ("sum", "sum", 2), ("count", "count", 2)):
    _cells = ", ".join(f"round({_sql}(CASE WHEN o_orderstatus = '{s}' THEN o_totalprice END), {_digits}) AS {s}"
                       if _fn != "count" else
                       f"nullif(count(CASE WHEN o_orderstatus = '{s}' THEN o_totalprice END), 0) AS {s}"
                       for s in _STATUS)
    steps(f"pivot_{_fn}", "orders",
          [("pivot_table", {"index": "o_custkey", "columns_col": "o_orderstatus", "values": "o_totalprice",
                            "aggfunc": _fn})],
          f"SELECT o_custkey, {_cells} FROM orders GROUP BY o_custkey", digits=_digits)
steps("melt", "lineitem",
      [("melt", {"id_vars": ["l_orderkey"], "value_vars": ["l_quantity", "l_discount", "l_linenumber"]})],
      """SELECT l_orderkey, 'l_quantity' AS variable, l_quantity AS value FROM lineitem
         UNION ALL SELECT l_orderkey, 'l_discount', l_discount FROM lineitem
         UNION ALL SELECT l_orderkey, 'l_linenumber', CAST(l_linenumber AS DOUBLE) FROM lineitem""")
steps("melt_text", "customer", [("melt", {"id_vars": ["c_custkey"], "value_vars": ["c_name", "c_nationkey"]})],
      """SELECT c_custkey, 'c_name' AS variable, c_name AS value FROM customer
         UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer""")
steps("transpose",
      "SELECT user_id, event_type, value FROM events",
      [("groupby_aggregate", {"group_cols": ["event_type"], "agg_col": "value", "agg_type": "count"}),
       ("transpose", {"order_by": "event_type"})],
      """WITH c AS (SELECT event_type, CAST(count(value) AS VARCHAR) AS n,
         row_number() OVER (ORDER BY event_type) AS i FROM events GROUP BY 1)
         SELECT 'event_type' AS index, max(CASE WHEN i = 1 THEN event_type END) AS column_0,
         max(CASE WHEN i = 2 THEN event_type END) AS column_1, max(CASE WHEN i = 3 THEN event_type END) AS column_2,
         max(CASE WHEN i = 4 THEN event_type END) AS column_3, max(CASE WHEN i = 5 THEN event_type END) AS column_4
         FROM c UNION ALL SELECT 'value', max(CASE WHEN i = 1 THEN n END), max(CASE WHEN i = 2 THEN n END),
         max(CASE WHEN i = 3 THEN n END), max(CASE WHEN i = 4 THEN n END), max(CASE WHEN i = 5 THEN n END) FROM c""")
