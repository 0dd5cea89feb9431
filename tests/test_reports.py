"""Reports and charts on edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright import profile as P
from tablewright.charts import box_outliers, chart_data, check_columns, suggest_chart


def test_column_statistics_edges(spark):
    df = spark.createDataFrame([(1.0, None, "a"), (1.0, None, None)], "k double, n double, s string")
    found = {r["column"]: r for r in P.column_statistics(df).collect()}
    assert (found["k"]["mean"], found["k"]["std"], found["k"]["outliers"]) == (1.0, 0.0, 0)
    assert found["n"]["mean"] is None and found["n"]["nulls"] == 2 and found["s"]["count"] == 1
    one = P.column_statistics(spark.createDataFrame([(5,)], "x int")).first()
    assert (one["median"], one["std"]) == (5.0, 0.0)


def test_histogram_of_a_constant_and_labels(spark):
    rows = P.histogram(spark.createDataFrame([(4.0,), (4.0,)], "x double")).collect()
    assert [r["label"] for r in rows] == ["3.5–3.7", "3.7–3.9", "3.9–4.1", "4.1–4.3", "4.3–4.5"]
    assert [r["percentage"] for r in rows] == [0, 0, 100, 0, 0]
    big = P.histogram(spark.createDataFrame([(0.0,), (5000.0,)], "x double")).collect()
    assert big[0]["label"] == "0e+00–1e+03"


def test_histogram_equals_numpy(spark):
    rng = np.random.default_rng(3)
    for data in (rng.normal(size=2000), rng.integers(0, 10, 2000) / 10.0):
        df = spark.createDataFrame([(float(v),) for v in data], "x double")
        got = chart_data(df, "histogram", ["x"], options={"binningEnabled": True, "binCount": 9}).orderBy("bin").collect()
        counts, cuts = np.histogram(data, bins=9)
        assert [r["count"] for r in got] == counts.tolist()
        assert np.allclose([r["bin_from"] for r in got], cuts[:-1])
        auto = chart_data(df, "histogram", ["x"]).count()
        assert auto == len(np.histogram_bin_edges(data, "auto")) - 1


def test_top_distribution_of_nothing(spark):
    df = spark.createDataFrame([(None,), (None,)], "s string")
    assert P.top_distribution(df, "s").count() == 0
    assert [tuple(r) for r in P.unique_values(df, "s").collect()] == [("NaN", 2, 1)]
    assert [tuple(r) for r in P.class_distribution(df, "s").collect()] == [("NaN", 2, 100.0)]


def test_duplicates_with_few_and_many_repeats(spark):
    df = spark.range(100).select((F.col("id") % 40).alias("a"), F.when(F.col("id") % 2 == 0, None).otherwise("x").alias("b"))
    assert P.duplicate_rows(df) == 60

    assert P.duplicate_rows(df) == 60
    assert P.duplicate_rows(spark.range(10)) == 0


def test_correlation_matrix_equals_numpy(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(200, 30)) + 1e8  # far from 0, where sums of plain squares lose digits
    data[:, 3] = 2.0
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], ", ".join(f"c{i} double" for i in range(30)))
    for width in (4, 30):
        found = {tuple(r)[:2]: r["correlation"] for r in P.correlation_matrix(df.select(*df.columns[:width])).collect()}
        assert len(found) == width * width and found["c3", "c3"] == 0.0 and found["c0", "c0"] == 1.0 and found["c0", "c3"] == 0.0
        expected = np.corrcoef(data[:, [0, 1, 2]].T)
        assert all(abs(found[f"c{i}", f"c{j}"] - expected[i, j]) < 1e-7 for i in range(3) for j in range(3))
    assert P.correlation_matrix(df.select("c0")).count() == 0


def test_report_dispatch(spark):
    df = spark.range(3)
    for kind in ("dataset_summary", "missing_analysis", "datatype_overview", "correlation_matrix"):
        assert P.report(df, kind) is not None
    assert P.report(df, "class_distribution", "id").count() == 3
    for bad in (("class_distribution", None), ("other", None)):
        with pytest.raises(ValueError):
            P.report(df, *bad)


@pytest.fixture
def frame(spark):
    rows = [(i, float(i % 7), f"c{i % 3}") for i in range(60)]
    return spark.createDataFrame(rows, "n bigint, v double, c string").withColumn("t", F.timestamp_seconds("n"))


def test_chart_rules(frame):
    for chart, x, y in (("scatter", ["n"], []), ("scatter", ["c"], ["v"]), ("line", ["c"], ["v"]), ("line", ["n"], ["c"]),
                        ("bar", ["n"], ["c"]), ("heatmap", ["n", "c"], []), ("bar", [], ["v"]), ("bar", ["zz"], []),
                        ("bar", ["n"], ["zz"]), ("count", ["n"] * 6, []), ("bar", ["n"], ["v"] * 11)):
        with pytest.raises(ValueError):
            check_columns(frame, chart, x, y)
    check_columns(frame, "line", ["t"], ["v"])


@pytest.mark.parametrize("x,y,chart", [([], ["v"], "scatter"), (["n"], [], "histogram"), (["c"], [], "bar"), (["t"], [], "bar"),
                                       (["t"], ["v"], "line"), (["v"], ["t"], "line"), (["n"], ["v"], "scatter"),
                                       (["c"], ["v"], "bar"), (["v"], ["c"], "bar"), (["c"], ["c"], "scatter")])
def test_suggested_chart(frame, x, y, chart):
    assert suggest_chart(frame, x, y) == chart


def test_charts_drop_nulls_and_nan(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), (None, 2.0), ("b", None)], "c string, v double")
    assert [tuple(r) for r in chart_data(df, "bar", ["c"], ["v"]).collect()] == [("a", "v", 1.0)]


def test_box_whiskers_and_outliers(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 100]], "v double")
    box = chart_data(df, "box", ["v"]).first()
    assert (box["q25"], box["median"], box["q75"], box["whisker_low"], box["whisker_high"], box["outliers"]) == (2.25, 3.5, 4.75, 1.0, 5.0, 1)
    assert [r["value"] for r in box_outliers(df, ["v"]).collect()] == [100.0]


def test_density_has_unit_area(frame):
    rows = chart_data(frame, "kde", ["v"]).orderBy("x").collect()
    x, d = np.array([r["x"] for r in rows]), np.array([r["density"] for r in rows])
    assert len(rows) == 200 and abs(np.trapezoid(d, x) - 1) < 0.01
    assert chart_data(frame.withColumn("k", F.lit(1.0)), "kde", ["k"]).count() == 0
    joint = chart_data(frame, "density", ["n"], ["v"]).collect()
    assert len(joint) == 1600


def test_hexbin_counts_every_point(frame):
    assert chart_data(frame, "hexbin", ["n"], ["v"]).agg(F.sum("count")).first()[0] == 60


def test_bubble_sizes(frame):
    sizes = [r["size"] for r in chart_data(frame, "bubble", ["n"], ["v", "n"]).collect()]
    assert min(sizes) == 20.0 and max(sizes) == 200.0
    assert math.isclose(chart_data(frame, "bubble", ["n"], ["v"]).first()["size"], 100.0)


def test_unknown_chart_is_a_scatter(frame):
    assert chart_data(frame, "radar", ["n"], ["v"]).count() == 60
