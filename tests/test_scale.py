"""Distribution: several buckets, hot keys, narrow limits, and what the plans look like."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.functions import ordering
from tablewright.functions.quantiles import column_quantiles, grouped_quantiles, nearest_rank


def series(spark, n, seed=1, holes=0.9):
    rng = random.Random(seed)
    rows = [(i, None if rng.random() < holes else rng.random()) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id bigint, v double").repartition(7), dict(rows)


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_row_index_and_carry_over_buckets(spark, buckets):
    df, held = series(spark, 500)
    ordered = ordering.bucketed(df, "id", buckets=buckets)
    assert ordered.df.select("__bucket").distinct().count() <= buckets
    numbered = {r["id"]: r["__row_index"] for r in ordering.with_row_index(ordered).collect()}
    assert numbered == {i: i for i in range(500)}
    last, down = None, {}
    for i in range(500):
        last = held[i] if held[i] is not None else last
        down[i] = last
    found = {r["id"]: r["v"] for r in ordering.carried(ordered, F.col("v"), {"v": False}).collect()}
    assert found == down
    nxt, up = None, {}
    for i in reversed(range(500)):
        nxt = held[i] if held[i] is not None else nxt
        up[i] = nxt
    found = {r["id"]: r["v"] for r in ordering.carried(ordered, F.col("v"), {"v": True}).collect()}
    assert found == up


def test_rolling_over_blocks(spark):
    df, held = series(spark, 300, holes=0.3)
    out = ordering.rolling(df, "id", 25, {"s": F.sum("v"), "n": F.count("v")}, block=30).collect()
    for r in out:
        window = [held[j] for j in range(max(0, r["id"] - 24), r["id"] + 1) if held[j] is not None]
        assert r["n"] == len(window) and (r["s"] is None) == (not window)
        assert not window or abs(r["s"] - sum(window)) < 1e-9
    assert len(out) == 300


def test_hot_order_key_is_spread(spark):
    df = spark.range(4000).select(F.when(F.col("id") < 3000, 5).otherwise(F.col("id")).alias("k"), "id")
    ordered = ordering.bucketed(df, "k", buckets=16)
    sizes = [r["count"] for r in ordered.df.groupBy("__bucket").count().collect()]
    assert max(sizes) < 1000 and sum(sizes) == 4000
    index = [r["__row_index"] for r in ordering.with_row_index(ordered).orderBy("k").collect()]
    assert sorted(index) == list(range(4000))


def test_order_by_text_time_and_nulls(spark):
    rows = [("it's", 1), (None, 0), ("a\\b", 2), ("é", 3), ("", 4)]
    df = spark.createDataFrame(rows, "s string, n int").withColumn("t", F.expr("timestamp_ntz'2024-01-01' + make_interval(0,0,0,n)"))
    for key in ("s", "t", "n"):
        ordered = ordering.bucketed(df, key, buckets=5)
        got = [r[key] for r in ordering.with_row_index(ordered).orderBy("__row_index").collect()]
        assert got == sorted(got, key=lambda v: (v is not None, v))


def test_missing_order_is_refused(spark):
    with pytest.raises(ValueError, match="order_by"):
        ordering.bucketed(spark.range(3), None)


@pytest.mark.parametrize("kind", ["spread", "ties", "hot", "two"])
def test_quantiles_by_narrowing_equal_a_sort(spark, kind):
    rng = np.random.default_rng(5)
    data = {"spread": rng.normal(size=4001), "ties": rng.integers(0, 7, 4000).astype(float),
            "hot": np.where(rng.random(4000) < 0.4, 0.25, rng.random(4000)), "two": np.array([2.0, 1.0])}[kind]
    df = spark.createDataFrame([(float(v),) for v in data], "v double").repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    ordered = np.sort(data)
    for limit in (3, 10**6):
        near = column_quantiles(df, ["v"], probs, "nearest", max_interior=limit)["v"]
        assert near == [ordered[nearest_rank(len(data), p)] for p in probs]
        line = column_quantiles(df, ["v"], probs, "linear", max_interior=limit)["v"]
        assert np.allclose(line, np.quantile(data, probs), rtol=0, atol=1e-12)


def test_quantiles_of_whole_numbers_beyond_double_precision(spark):
    base = 2**60
    df = spark.range(3000).select((F.lit(base) + F.col("id")).alias("v"))
    assert column_quantiles(df, ["v"], [0.5], max_interior=5)["v"] == [base + nearest_rank(3000, 0.5)]


def test_grouped_quantiles_with_hot_groups(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("g"),
                                  ((F.col("id") * 7919) % 3001).cast("double").alias("v"))
    df = df.unionByName(df.limit(1).select(F.lit("empty").alias("g"), F.lit(None).cast("double").alias("v")))
    found = {r["g"]: tuple(r)[1:] for r in grouped_quantiles(df, ["g"], "v", [0.25, 0.5]).collect()}
    groups = {}
    for r in df.collect():
        groups.setdefault(r["g"], []).extend([r["v"]] if r["v"] is not None else [])
    assert found == {g: (len(v), *(float(np.quantile(v, q)) if v else None for q in (0.25, 0.5))) for g, v in groups.items()}


def test_one_order_key_with_nulls_is_split(spark):
    from tablewright.functions.ordering import bucketed
    df = spark.range(40_000).select("id", F.lit(1).alias("day"), F.when(F.col("id") % 1000 == 0, 1.0).alias("v"))
    sizes = [r["count"] for r in bucketed(df, "day", buckets=16).df.groupBy("__bucket").count().collect()]
    assert sum(sizes) == 40_000 and max(sizes) < 2 * 40_000 / 16


def test_broadcast_is_decided_by_bytes(spark):
    from tablewright.functions.lookup import attach, is_small
    long = spark.range(20).select("id", F.repeat(F.lit("x"), 1_000_000).alias("t"))
    assert not is_small(long) and is_small(long.select("id"))
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    words = spark.createDataFrame([("a", 1)], "k string, n int")
    for limit in (0, 1 << 20):
        import tablewright.functions.lookup as lookup
        kept, lookup.BROADCAST_BYTES = lookup.BROADCAST_BYTES, limit
        small, lookup.is_small = lookup.is_small, lambda df, limit=limit: limit > 0
        try:
            assert sorted(map(tuple, attach(rows, words, "k").collect()), key=str) == [("a", 1), ("b", None), (None, None)]
        finally:
            lookup.BROADCAST_BYTES, lookup.is_small = kept, small


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ordered_steps_have_no_single_task_window(spark):
    from tablewright import apply_steps
    df, _ = series(spark, 200)
    for step in ("ffill", "bfill"):
        text = plan(apply_steps(df, [{"type": step, "params": {"column": "v"}}], order_by="id"))
        # the only single partition is the per-bucket summary, below a grouped aggregate
        for block in text.split("Exchange SinglePartition")[1:]:
            assert "HashAggregate(keys=[__bucket" in block or "SortAggregate(key=[__bucket" in block
        assert "hashpartitioning(__bucket" in text


def test_filters_and_columns_reach_the_scan(spark):
    from conftest import SMALL
    from tablewright import apply_steps, load
    steps = [{"type": "filter_rows", "params": {"column": "l_quantity", "operator": ">", "value": "10"}},
             {"type": "groupby_aggregate", "params": {"group_cols": ["l_returnflag"], "agg_col": "l_extendedprice"}}]
    text = plan(apply_steps(load(spark, f"{SMALL}/lineitem.parquet"), steps))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in text
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_returnflag:string>" in text


def test_no_python_in_table_steps(spark):
    from tablewright.catalog import QUERIES
    from conftest import SMALL
    for name in ("ffill", "interpolate", "rolling_mean", "one_hot_encode", "custom_formula", "robust_scale", "chart_kde", "chart_box"):
        text = plan(QUERIES[name](spark, SMALL))
        assert "Python" not in text and "InPandas" not in text, name
