"""Cases at the edges: wide results, repeated keys, odd values, hot keys, files and user steps."""

import uuid

from pyspark.sql import functions as F

from ..charts import chart_data
from ..functions.checkpoints import checkpoint_folder
from ..ml import split_rows, train
from ..ml.history import append_run, delete_run, read_runs
from ..ml.metrics import silhouette
from ..plans import apply_steps, read_steps, write_steps
from ..plans.registry import register
from ..sources import load, save
from .base import query, rounded, source, steps, table


def _scratch(spark, name: str) -> str:
    """A new path in the shared folder."""
    checkpoint_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("split_many_parts", """SELECT doc_id, len(string_split(text, ' ')) AS parts, string_split(text, ' ')[1] AS first,
    list_aggregate(string_split(text, ' '), 'string_agg', ' ') = text AS whole FROM documents""")
def _many_parts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = apply_steps(docs, [{"type": "split_column", "params": {"column": "text", "delimiter": " "}}])
    # put together once, and only the parts a row has: its missing ones are nulls at the end
    parts = F.array_compact(F.array(*[c for c in out.columns if c.startswith("text_split_")]))
    held = out.select("doc_id", "text", "text_split_1", parts.alias("held"))
    return held.select("doc_id", F.size("held").cast("bigint").alias("parts"), F.col("text_split_1").alias("first"),
                       (F.array_join("held", " ") == F.col("text")).alias("whole"))


steps("regex_optional_group", "SELECT c_custkey, c_mktsegment FROM customer",
      [("regex_extraction", {"column": "c_mktsegment", "pattern": "(BUILD)|MACHIN", "new_name": "found"})],
      """SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment LIKE '%BUILD%' THEN 'BUILD' END AS found FROM customer""")

steps("filter_decimal", "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12, 2)) AS price FROM orders",
      [("filter_rows", {"column": "price", "operator": ">", "value": "100000.005"})],
      """SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12, 2)) AS price FROM orders
         WHERE CAST(o_totalprice AS DECIMAL(12, 2)) > CAST(100000.005 AS DECIMAL(18, 3))""")


@query("split_repeated_key", """SELECT count(*) AS rows, CAST(0 AS BIGINT) AS in_both, CAST(0 AS BIGINT) AS in_neither,
    CAST(ceil(round(0.2 * count(*), 9)) AS BIGINT) AS test_rows FROM events""")
def _repeated_key(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    fit, test = split_rows(events, key=["event_type"])
    seen = events.select("event_id", F.lit(0).alias("n"), F.lit(0).alias("t")).unionByName(
        fit.select("event_id", F.lit(1).alias("n"), F.lit(0).alias("t"))).unionByName(test.select("event_id", F.lit(1).alias("n"), F.lit(1).alias("t")))
    each = seen.groupBy("event_id").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    return each.agg(F.count("*").alias("rows"), F.count_if(F.col("n") > 1).alias("in_both"), F.count_if(F.col("n") == 0).alias("in_neither"),
                    F.sum("t").alias("test_rows"))


@query("train_dotted_values", "SELECT count(*) > 0 AS fitted FROM customer")
def _dotted(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("St. "), "c_mktsegment").alias("seg. name"), F.col("c_acctbal").alias("y.z"))
    return train(rows, "linear-regression", "y.z").metrics.select(F.col("mae").isNotNull().alias("fitted"))


@query("train_many_categories", """SELECT CAST(ceil(round(0.2 * count(*), 9)) AS BIGINT) AS predicted, count(*) - 1 AS features FROM customer""")
def _many_categories(spark, sf_dir):
    """Every name is a category of its own, known from all rows."""
    rows = table(spark, sf_dir, "customer").select("c_name", "c_acctbal")
    found = train(rows, "ridge-regression", "c_acctbal", leaky=True)
    # a sparse vector tells its size, a dense one is as long as its values; neither is written out in full
    vector = F.unwrap_udt("features")
    sizes = found.predictions.select("prediction", F.coalesce(vector["size"], F.size(vector["values"])).cast("bigint").alias("features"))
    return sizes.groupBy("features").agg(F.count("prediction").alias("predicted"))


@query("silhouette_all_rows", """WITH p AS (SELECT event_id AS id, value AS x, event_type AS c FROM events),
    s AS (SELECT c, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM p GROUP BY 1),
    d AS (SELECT p.id, p.c = s.c AS own, n, n * x * x - 2 * x * s + q AS t FROM p, s),
    e AS (SELECT id, max(CASE WHEN own THEN t / (n - 1) END) AS a, min(CASE WHEN NOT own THEN t / n END) AS b FROM d GROUP BY 1)
    SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM e""")
def _silhouette(spark, sf_dir):
    kinds = F.array(*[F.lit(t) for t in ("click", "error", "purchase", "signup", "view")])
    points = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.array("value").alias("x"),
                                                   F.array_position(kinds, F.col("event_type")).cast("int").alias("prediction"))
    return rounded(spark.createDataFrame([(silhouette(points),)], "silhouette double"))


steps("ffill_hot_key", """SELECT 1 AS day, event_id, CASE WHEN event_id % 1000 = 0 THEN value END AS value FROM events""",
      [("ffill", {"column": "value"})],
      """SELECT 1 AS day, event_id, round(last_value(CASE WHEN event_id % 1000 = 0 THEN value END IGNORE NULLS)
         OVER (ORDER BY event_id), 6) AS value FROM events""", order_by=["day", "event_id"])


@query("csv_round_trip", "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, o_orderpriority FROM orders")
def _csv(spark, sf_dir):
    orders, path = table(spark, sf_dir, "orders").drop("o_orderdate"), _scratch(spark, "orders") + ".csv"
    save(orders, path)
    return rounded(load(spark, path, orders.schema))


@query("parquet_output", "SELECT * FROM region")
def _output(spark, sf_dir):
    path = _scratch(spark, "region") + ".parquet"
    save(table(spark, sf_dir, "region"), path)
    return load(spark, path)


@query("run_history", "SELECT CAST(1 AS BIGINT) AS run_id, 'mean' AS algorithm, round(avg(value), 6) AS mean, false AS active FROM events "
                      "UNION ALL SELECT 3, 'max', round(max(value), 6), true FROM events")
def _history(spark, sf_dir):
    path = _scratch(spark, "runs")
    row = table(spark, sf_dir, "events").agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max")).first()
    for name in ("mean", "min", "max"):
        append_run(spark, path, name, {}, {"mean": row[name]})
    delete_run(spark, path, 2)
    return rounded(read_runs(spark, path).select("run_id", "algorithm", F.col("metrics")["mean"].alias("mean"), "active"))


@query("stored_document", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey > 2")
def _stored(spark, sf_dir):
    path = _scratch(spark, "steps") + ".json"
    write_steps(path, [{"type": "filter_rows", "params": {"column": "n_regionkey", "operator": ">", "value": 2}},
                       {"type": "drop_columns", "params": {"column": "n_regionkey"}}], spark)
    return apply_steps(table(spark, sf_dir, "nation"), read_steps(path, spark)).select("n_nationkey", "n_name")


@query("user_step", "SELECT s_suppkey, round(s_acctbal * 2, 6) AS s_acctbal FROM supplier")
def _user_step(spark, sf_dir):
    register("catalog_double", lambda df, params: df.withColumn(params["column"], F.col(params["column"]) * 2))
    return rounded(apply_steps(source(spark, sf_dir, "supplier"), [{"type": "catalog_double", "params": {"column": "s_acctbal"}}])
                   .select("s_suppkey", "s_acctbal"))


@query("chart_box_many_groups", """WITH q AS (SELECT l_suppkey, quantile_cont(l_quantity, [0.25, 0.5, 0.75]) AS m FROM lineitem GROUP BY 1)
    SELECT l.l_suppkey, 'l_quantity' AS metric, count(*) AS n, round(m[1], 6) AS q25, round(m[2], 6) AS median, round(m[3], 6) AS q75,
    count(*) FILTER (l_quantity < m[1] - 1.5 * (m[3] - m[1]) OR l_quantity > m[3] + 1.5 * (m[3] - m[1])) AS outliers
    FROM lineitem l JOIN q USING (l_suppkey) GROUP BY l.l_suppkey, m""")
def _box_many(spark, sf_dir):
    boxes = chart_data(table(spark, sf_dir, "lineitem"), "box", ["l_suppkey"], ["l_quantity"])
    return rounded(boxes.select("l_suppkey", "metric", "n", "q25", "median", "q75", "outliers"))


steps("pivot_median", "SELECT o_orderstatus, o_orderpriority, o_totalprice FROM orders",
      [("pivot_table", {"index": "o_orderpriority", "columns_col": "o_orderstatus", "values": "o_totalprice", "aggfunc": "median"})],
      """SELECT o_orderpriority, round(median(o_totalprice) FILTER (o_orderstatus = 'F'), 6) AS F,
         round(median(o_totalprice) FILTER (o_orderstatus = 'O'), 6) AS O, round(median(o_totalprice) FILTER (o_orderstatus = 'P'), 6) AS P
         FROM orders GROUP BY 1""")
