"""Ranks, shifts, value frames, grouping sets and distinct aggregates against Spark's own windows and plain Python."""

import collections
import random

import pytest
from pyspark.sql import Window, functions as F

from tablewright.functions import ordering
from tablewright.functions.ranking import range_frame, ranked, shifted
from tablewright.operators.cubes import approx_distinct, cube_sets, distinct_aggregates, grouping_sets, rollup_sets


def bag(df):
    return collections.Counter(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.fixture
def rows(spark, monkeypatch):
    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", 12)
    rng = random.Random(2)
    data = [(i, None if rng.random() < 0.1 else 5.0 if rng.random() < 0.4 else float(rng.randrange(30)), rng.choice("xy")) for i in range(400)]
    return spark.createDataFrame(data, "i int, v double, s string").repartition(5)


ALL = {"n": "row_number", "r": "rank", "d": "dense_rank", "p": "percent_rank", "c": "cume_dist"}


@pytest.mark.parametrize("order", ["v", ["s", "v"], "i"])
def test_ranks(rows, order):
    names = [order] if isinstance(order, str) else order
    w = Window.orderBy(*names)
    want = rows.select("*", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"), F.percent_rank().over(w).alias("p"), F.cume_dist().over(w).alias("c"))
    found = ranked(rows, order, ALL, {"t": 7})
    assert bag(found.drop("n", "t")) == bag(want)
    numbers = sorted((r.n, r.r, r.t) for r in found.collect())
    assert [n for n, _, _ in numbers] == list(range(1, 401))
    tiles = [t for _, _, t in numbers]
    assert tiles == sorted(tiles) and collections.Counter(tiles) == {1: 58, **{k: 57 for k in range(2, 8)}}


def test_ranks_of_one_value_and_of_nothing(spark, rows):
    same = rows.withColumn("v", F.lit(1))
    found = ranked(same, "v", ALL).agg(F.min("r"), F.max("r"), F.max("d"), F.max("p"), F.min("c"), F.countDistinct("n")).first()
    assert tuple(found) == (1, 1, 1, 0.0, 1.0, 400)
    assert ranked(rows.limit(0), "v", ALL, {"t": 3}).count() == 0
    with pytest.raises(ValueError):
        ranked(rows, "v", {"x": "median"})


def test_no_window_holds_all_rows(rows):
    """What comes to one task was summed up by range before."""
    lines = [line.lstrip(" :+-*()0123456789") for line in ranked(rows, "v", {"r": "rank"})._jdf.queryExecution().executedPlan().toString().splitlines()]
    singles = [k for k, line in enumerate(lines) if line.startswith("Exchange SinglePartition")]
    assert singles
    for k in singles:
        below = next(line for line in lines[k + 1:] if not line.startswith(("Project", "Filter", "Sort ")))
        assert "Aggregate" in below.split("(")[0] and "__bucket" in below


@pytest.mark.parametrize("block", [3, 40, 1000])
def test_shifts(rows, block):
    shifts = {"a": ("v", 1), "b": ("i", 3), "c": ("s", -2)}
    w = Window.orderBy("i")
    want = rows.select("*", F.lag("v", 1).over(w).alias("a"), F.lag("i", 3).over(w).alias("b"), F.lead("s", 2).over(w).alias("c"))
    assert bag(shifted(rows, "i", shifts, block)) == bag(want)


@pytest.mark.parametrize("below, above", [(0, 0), (2, 1), (100, 0), (0.5, 3)])
def test_range_frames(rows, below, above):
    data = [tuple(r) for r in rows.collect()]

    def frame(v):
        return [r for r in data if (r[1] is None) == (v is None) and (v is None or v - below <= r[1] <= v + above)]
    want = collections.Counter()
    for r in data:
        near = frame(r[1])
        values = [x[1] for x in near if x[1] is not None]
        want[(*r, len(near), max(x[0] for x in near), sum(values) if values else None)] += 1
    aggregates = {"n": "count(*)", "m": "max(i)", "t": "sum(v)"}
    assert bag(range_frame(rows, "v", below, above, aggregates, rows_per_range=25)) == want
    with pytest.raises(TypeError):
        range_frame(rows, "s", 1, 1, aggregates)


AGGREGATES = {"n": ("v", "count"), "rows": (None, "rows"), "s": ("v", "sum"), "lo": ("v", "min"), "hi": ("v", "max"), "m": ("v", "mean"), "u": ("i", "approx_distinct")}


def test_grouping_sets(spark, rows):
    df = rows.withColumn("k", F.when(F.col("i") % 3 > 0, F.col("i") % 3)).withColumn("s", F.when(F.col("i") % 11 > 0, F.col("s")))
    for sets in (cube_sets(["s", "k"]), rollup_sets(["s", "k"]), [("k",), ()], [("s",)]):
        found = grouping_sets(df, sets, AGGREGATES)
        keys = [k for k in df.columns if any(k in s for s in sets)]
        assert found.columns == [*keys, "grouping_id", *AGGREGATES]
        want = collections.Counter()
        for s in sets:
            grouped = df.groupBy(*s).agg(F.count("v"), F.count("*"), F.sum("v"), F.min("v"), F.max("v"), F.avg("v"), F.approx_count_distinct("i"))
            gid = sum((k not in s) << (len(keys) - 1 - i) for i, k in enumerate(keys))
            want.update((*[r[k] if k in s else None for k in keys], gid, *[round(x, 9) if isinstance(x, float) else x for x in r[len(s):-1]]) for r in grouped.collect())
        assert collections.Counter(t[:-1] for t in bag(found).elements()) == want
    exact = {r.s: r.u for r in df.groupBy("s").agg(F.countDistinct("i").alias("u")).collect()}
    assert all(abs(r.u - exact[r.s]) <= 0.05 * exact[r.s] for r in grouping_sets(df, [("s",)], AGGREGATES).collect())


def test_grouping_sets_scan_once_and_take_empty_tables(spark, rows, tmp_path):
    rows.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = grouping_sets(df, [("s", "i"), ("s",)], {"n": ("v", "sum")})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert [tuple(r) for r in grouping_sets(df.limit(0), cube_sets(["s"]), {"n": ("v", "count"), "x": ("v", "sum")}).collect()] == [(None, 1, 0, None)]
    with pytest.raises(ValueError):
        grouping_sets(df, [("nothing",)], {"n": ("v", "count")})


def test_distinct_aggregates(spark, rows):
    df = rows.withColumn("k", F.when(F.col("i") % 4 > 0, F.lit("hot")))
    asked = {"n": ("v", "count"), "t": ("v", "sum"), "a": ("v", "mean"), "m": ("s", "count"), "lo": ("s", "min")}
    def want(*by):
        return df.groupBy(*by).agg(F.countDistinct("v"), F.sum_distinct("v"), F.expr("avg(distinct v)"), F.countDistinct("s"), F.min("s"))
    assert bag(distinct_aggregates(df, "k", asked)) == bag(want("k"))
    assert bag(distinct_aggregates(df, ["k", "s"], {"n": ("v", "count")})) == bag(df.groupBy("k", "s").agg(F.countDistinct("v")))
    assert bag(distinct_aggregates(df, [], asked)) == bag(want())
    assert bag(distinct_aggregates(df.limit(0), [], {"n": ("v", "count")})) == {(0,): 1}


def test_sketches_keep_their_error(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 50_021).alias("x"))
    exact = {r.k: r.n for r in df.groupBy("k").agg(F.countDistinct("x").alias("n")).collect()}
    for error in (0.05, 0.01):
        assert all(abs(r.distinct / exact[r.k] - 1) <= 3 * error for r in approx_distinct(df, "k", "x", error).collect())
