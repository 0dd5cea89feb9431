"""Work that grows no faster than the table: what plans hold, and how many pairs or cells are made."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from tablewright import joins
from tablewright.catalog import QUERIES
from tablewright.functions.ranking import range_frame
from tablewright.joins import ranges
from tablewright.ml.prepare import feature_rules


def test_many_parts_are_put_together_once(spark, tmp_path):
    texts = ["a b c", "d", None, "", " e ", " ".join(str(i) for i in range(1500))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["split_many_parts"](spark, str(tmp_path))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("array(") == 1
    want = [(i, 0 if t is None else len(t.split(" ")), None if t is None else t.split(" ")[0], None if t is None else True) for i, t in enumerate(texts)]
    assert collections.Counter(map(tuple, found.collect())) == collections.Counter(want)


def test_vectors_of_many_values_carry_no_description_of_each(spark):
    df = spark.range(700).select(F.when(F.col("id") % 7 > 0, F.concat(F.lit("n "), F.col("id") % 401)).alias("a.b"), F.expr("if(id % 5 = 0, 0D, if(id % 11 = 0, double('nan'), id))").alias("x"),
                                 F.concat(F.lit("k"), F.col("id") % 3).alias("k"), F.lit("one").alias("one"), (F.col("id") % 2 == 0).alias("flag"), F.col("id").alias("y"))
    rules = feature_rules(df.where("y < 600"), ["a.b", "x", "k", "one", "flag"])
    told, bare = (rules.vectors(df, ["y"], described=d) for d in (True, False))
    assert [repr(r) for r in told.orderBy("y").collect()] == [repr(r) for r in bare.orderBy("y").collect()]
    attributes = [d.schema["features"].metadata["ml_attr"] for d in (told, bare)]
    assert attributes[0]["num_attrs"] == attributes[1]["num_attrs"] and list(attributes[1]) == ["num_attrs"]
    words = feature_rules(df, ["a.b"])
    assert [repr(r) for r in words.vectors(df, ["y"]).orderBy("y").collect()] == [repr(r) for r in words.vectors(df, ["y"], described=False).orderBy("y").collect()]


def test_training_on_many_categories_writes_no_vector_out_in_full(spark, tmp_path):
    spark.range(400).select(F.col("id").alias("c_custkey"), F.concat(F.lit("c"), F.col("id") % 350).alias("c_name"), F.lit(1).alias("c_nationkey"), (F.col("id") * 1.5).alias("c_acctbal"),
                            F.lit("m").alias("c_mktsegment")).write.parquet(f"{tmp_path}/customer.parquet")
    found = QUERIES["train_many_categories"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "unwrap" in plan.lower() and "vector_to_array" not in plan.lower()
    assert [tuple(r) for r in found.select("features", "predicted").collect()] == [(349, 80)]


ODD = [float("nan"), float("inf"), -float("inf"), 1e308, -1e308, 1e17, 2.0**60, 2.0**60 - 128, -0.0, 0.0, None, None, 5e-324]


@pytest.mark.parametrize("below, above", [(0, 0), (100, 0), (-1, 3), (-1, 1), (1e-9, 1e-9), (1e16, 3)])
@pytest.mark.parametrize("rows_per_range", [40, 10**6])
def test_frames_of_odd_values_and_sides(spark, below, above, rows_per_range):
    rng = random.Random(4)
    numbers = [*ODD, *[rng.choice([5.0, float(rng.randrange(30)), rng.uniform(-40, 40), rng.randrange(9) * 0.1, 1e15 + rng.randrange(9)]) for _ in range(150)]]
    rows = [(i, v, rng.choice([None, "a", "b,)"]), rng.randrange(100)) for i, v in enumerate(numbers)]

    def within(x, v):
        if v is None or x is None:
            return v is x
        return v - below <= x <= v + above if abs(v) < float("inf") and x == x else x == v or (x != x and v != v)
    want = {}
    for i, v, _, _ in rows:
        near = [r for r in rows if within(r[1], v)]
        low = min([r[2] for r in near if r[2] is not None], default=None)
        want[i] = (len(near), sum(r[2] is not None for r in near), low, sum(r[3] for r in near) if near else None, max([r[0] for r in near], default=None), sum(r[3] for r in near) / len(near) if near else None)
    asked = {"n": "count(*)", "c": "COUNT(s)", "lo": "min(coalesce(s, s))", "t": "sum(k)", "m": "max( i )", "mean": "avg(k)"}
    found = range_frame(spark.createDataFrame(rows, "i int, v double, s string, k int"), "v", below, above, asked, rows_per_range)
    assert found.columns == ["i", "v", "s", "k", *asked]
    assert {r.i: tuple(r[4:]) for r in found.collect()} == want


def test_frames_are_not_gone_through_row_by_row(spark):
    """100,000 rows of 50,000 rows a frame: five thousand million steps if each frame is read."""
    rows = spark.range(100_000).select((F.col("id") * 0.5).alias("v"))
    found = range_frame(rows, "v", 12_500, 12_499.5, {"n": "count(*)", "t": "sum(v)"})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame" not in plan and found.where("n = 50000 and abs(t - n * (v - 0.25)) < 1e-3").count() == 50_001


def test_few_bytes_that_make_many_pairs_take_several_tasks(spark):
    left, right = spark.range(10_000).select(F.col("id").alias("x")), spark.range(10_000).select(F.col("id").alias("y"))
    pairs = joins.theta_join(left, right, [("x", "<", "y")], rows_per_bucket=1250)
    assert "REPARTITION_BY_NUM" in pairs._jdf.queryExecution().executedPlan().toString()
    made = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == 10_000 * 9_999 // 2 and len(made) >= 2 and max(made) < 0.9 * sum(made)


@pytest.mark.parametrize("rows_per_task", [10, 10**6])
def test_pairs_over_tasks(spark, monkeypatch, rows_per_task):
    monkeypatch.setattr(ranges, "PAIRS_PER_TASK", 100)
    rng = random.Random(7)
    number = lambda: None if rng.random() < 0.1 else 5 if rng.random() < 0.4 else rng.randrange(40)
    left, right = [(rng.choice([None, 1, 2]), number()) for _ in range(80)], [(rng.choice([None, 1, 1]), number()) for _ in range(60)]
    found = joins.theta_join(spark.createDataFrame(left, "k int, x int"), spark.createDataFrame(right, "k int, y int"), [("x", "<=", "y")], "k", rows_per_bucket=7, rows_per_task=rows_per_task)
    want = [(k, x, y) for k, x in left for q, y in right if k is not None and k == q and x is not None and y is not None and x <= y]
    assert collections.Counter(map(tuple, found.collect())) == collections.Counter(want)
