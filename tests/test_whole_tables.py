"""Steps and reports without size switches, caps or driver lists: cases that the former limits would fail."""

import collections
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tablewright import charts, profile
from tablewright.functions import ordering
from tablewright.functions.histograms import bin_table
from tablewright.functions.lookup import is_small
from tablewright.functions.quantiles import grouped_quantiles
from tablewright.functions.values import most_frequent_of


def test_unicode_spaces_in_text_steps(apply):
    rows = [("a b c!",), ("mail u@host rest",), ("https://www.x.org　next",), ("tab\tand\u0085line end?",)]
    plain = apply(rows, "t string", ("remove_special_chars", {"column": "t"})).collect()
    assert [r.t for r in plain] == ["a b c", "mail uhost rest", "httpswwwxorg　next", "tab\tand\u0085line end"]
    found = apply(rows, "t string", ("extract_domain", {"column": "t"})).collect()
    assert [r.t_domain for r in found] == ["", "host", "x.org", ""]


def test_modes_of_many_columns_in_one_pass(spark):
    rows = [(1, "b", 2.0, None), (1, "a", 2.0, None), (3, "a", None, None), (3, "b", float("nan"), None), (None, None, float("nan"), None)]
    df = spark.createDataFrame(rows, "i int, s string, d double, n date").withColumn("a", F.array("i"))
    found = most_frequent_of(df, df.columns)
    assert (found["i"], found["s"], found["d"], found["n"], found["a"]) == (1, "a", 2.0, None, [1])
    assert most_frequent_of(df, []) == {} and most_frequent_of(df.limit(0), ["i"]) == {"i": None}


def test_many_duplicates_stay_in_spark(spark):
    half = spark.range(150_000).select((F.col("id") % 120_000).alias("x"), F.lit("t").alias("t"))
    assert profile.duplicate_rows(half) == 30_000 and profile.duplicate_rows(half.dropDuplicates()) == 0
    assert profile.duplicate_rows(half.union(half)) == 180_000


def test_histogram_bins_by_the_million(spark):
    df = spark.createDataFrame([(float(k),) for k in range(1000)] + [(None,)], "x double")
    found = bin_table(df, {"x": (0.0, 999.0, 3_000_000)})
    assert found.agg(F.count("*"), F.sum("count"), F.max("bin"), F.max("bin_to")).first() == (3_000_000, 1000, 2_999_999, 999.0)
    assert bin_table(df.limit(0), {}).count() == 0
    one = bin_table(spark.createDataFrame([(5,)], "x int"), {"x": (5.0, 5.0, 1)}).collect()
    assert [tuple(r) for r in one] == [("x", 0, 4.5, 5.5, 1)]


@pytest.mark.parametrize("per_bucket", [7, 10**6])
def test_grouped_quantiles(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", per_bucket)
    rng = random.Random(3)
    key = lambda: rng.choice([None, "hot", "hot", "hot", "a", "b"])
    rows = [(key(), rng.choice([None, 1]), None if rng.random() < 0.1 else float(rng.randrange(60))) for _ in range(400)] + [("empty", 1, None)] * 3
    groups = collections.defaultdict(list)
    for a, b, v in rows:
        groups[a, b] += [v] if v is not None else []
    found = grouped_quantiles(spark.createDataFrame(rows, "a string, b int, v double"), ["a", "b"], "v", [0.0, 0.25, 0.5, 1.0]).collect()
    assert len(found) == len(groups)
    for r in found:
        values = sorted(groups[r.a, r.b])
        assert r.n == len(values)
        if values:
            line = lambda p: (lambda at: values[int(at)] + (at % 1) * (values[min(len(values) - 1, int(at) + 1)] - values[int(at)]))(p * (len(values) - 1))
            assert [r.q0, r.q1, r.q2, r.q3] == pytest.approx([line(p) for p in (0, 0.25, 0.5, 1)]) and r.q2 == pytest.approx(statistics.median(values))
        else:
            assert (r.q0, r.q2) == (None, None)


def test_nulls_are_in_no_bin(spark):
    df = spark.createDataFrame([(float(k),) for k in range(10)] + [(None,)] * 30, "x double")
    assert [r.percentage for r in profile.histogram(df).orderBy("bin").collect()] == [20.0] * 5


def test_grouped_quantiles_shuffle_the_values_once(spark, tmp_path):
    spark.range(1000).select((F.col("id") % 5).alias("k"), F.col("id").cast("double").alias("v")).write.parquet(str(tmp_path / "t"))
    plan = grouped_quantiles(spark.read.parquet(str(tmp_path / "t")), ["k"], "v", [0.5])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2  # counts per range, and the values


def test_size_of_a_side(spark):
    assert is_small(spark.range(1000)) and not is_small(spark.range(2_000_000)) and is_small(spark.range(0))
    assert not is_small(spark.createDataFrame([("x" * 100,)] * 50, "t string"), 4000)


def test_chart_box_of_many_groups(spark):
    df = spark.range(3000).select((F.col("id") % 600).cast("string").alias("g"), F.col("id").cast("double").alias("v"))
    assert charts.chart_data(df, "box", ["g"], ["v"]).count() == 600
