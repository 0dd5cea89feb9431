"""Reading, writing and the step document."""

from pyspark.sql import functions as F

from ..functions.statistics import null_counts
from ..plans import apply_steps, from_document, to_document
from ..plans.preview import preview
from ..sources import load
from .base import NULLED, query, rounded, source


@query("read_parquet", "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer")
def _read_parquet(spark, sf_dir):
    return rounded(load(spark, f"{sf_dir}/customer.parquet"))


@query("preview_page", """SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE round(value, 6) END AS value
                          FROM events ORDER BY event_id LIMIT 50""")
def _preview_page(spark, sf_dir):
    df = source(spark, sf_dir, NULLED).select("event_id", "value")
    return rounded(preview(df, [{"type": "sort_column", "params": {"column": "event_id"}}]).page)


@query("preview_null_counts", """SELECT 'event_id' AS column, count(*) AS rows, count(*) - count(event_id) AS nulls FROM events
    UNION ALL SELECT 'value', count(*), count(*) FILTER (event_type IN ('error', 'view')) FROM events""")
def _preview_nulls(spark, sf_dir):
    df = source(spark, sf_dir, NULLED).select("event_id", "value")
    rows, nulls = null_counts(df)
    return spark.createDataFrame([(c, rows, n) for c, n in nulls.items()], "column string, rows bigint, nulls bigint")


@query("columns_after_steps", """SELECT unnest(['o_orderkey', 'o_custkey', 'o_totalprice', 'o_orderdate', 'o_orderpriority',
                                     'o_big']) AS column, count(*) AS filled FROM orders""")
def _columns(spark, sf_dir):
    steps = [{"type": "drop_columns", "params": {"column": "o_orderstatus"}},
             {"type": "custom_formula", "params": {"formula": "o_totalprice > 1000", "new_name": "o_big"}}]
    after = apply_steps(load(spark, f"{sf_dir}/orders.parquet"), steps)
    filled = [F.struct(F.lit(c).alias("column"), F.count(c).alias("filled")) for c in after.columns]
    return after.agg(F.array(*filled).alias("all")).select(F.inline("all"))


@query("step_document", """SELECT l_returnflag, count(*) AS l_quantity FROM lineitem WHERE l_quantity < 30 GROUP BY 1""")
def _document(spark, sf_dir):
    text = to_document([
        {"type": "filter_rows", "params": {"column": "l_quantity", "operator": "<", "value": "30"}},
        {"type": "groupby_aggregate",
         "params": {"group_cols": ["l_returnflag"], "agg_col": "l_quantity", "agg_type": "count"}}])
    return apply_steps(load(spark, f"{sf_dir}/lineitem.parquet"), from_document(text))
