"""Joins against brute force: heavy keys, intervals, as-of, inequalities; plans and balance."""

import collections
import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tablewright import joins
from tablewright.functions import ordering


def bag(df):
    return collections.Counter(tuple(r) for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_tasks(monkeypatch):
    """Many ranges on few rows, on two levels."""
    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", 20)
    monkeypatch.setattr(ordering, "COARSE", 4)


@pytest.fixture(scope="module")
def keyed(spark):
    rng = random.Random(1)
    key = lambda: None if rng.random() < 0.05 else 7 if rng.random() < 0.5 else rng.randrange(40)
    left = [(key(), i, "same" if i % 3 else f"l{i}") for i in range(300)]
    right = [(key(), i * 2, f"r{i}") for i in range(120)]
    return (left, right, spark.createDataFrame(left, "k int, v int, s string").repartition(5),
            spark.createDataFrame(right, "k int, v int, `odd name` string").repartition(4))


def brute_keyed(left, right, how):
    pairs = [(a, b) for a in left for b in right if a[0] is not None and a[0] == b[0]]
    inner = [(*a, *b[1:]) for a, b in pairs]
    with_match = {id(a) for a, _ in pairs}
    alone = [a for a in left if id(a) not in with_match]
    if how == "semi":
        return collections.Counter(a for a in left if id(a) in with_match)
    if how == "anti":
        return collections.Counter(alone)
    out = inner + ([(*a, None, None) for a in alone] if how != "inner" else [])
    if how == "full":
        met = {id(b) for _, b in pairs}
        out += [(b[0], None, None, *b[1:]) for b in right if id(b) not in met]
    return collections.Counter(out)


@pytest.mark.parametrize("rows_per_task", [8, 70, 10**6])
@pytest.mark.parametrize("how", ["inner", "left", "full", "semi", "anti"])
def test_keyed_join(keyed, how, rows_per_task):
    left, right, a, b = keyed
    found = joins.keyed_join(a, b, "k", how, rows_per_task=rows_per_task)
    assert bag(found) == brute_keyed(left, right, how)
    assert found.columns == ["k", "v", "s"] + (["v_right", "odd name"] if how in ("inner", "left", "full") else [])


def test_keyed_join_keys_of_other_names_and_condition(keyed):
    left, right, a, b = keyed
    b = b.withColumnRenamed("k", "other").withColumnRenamed("v", "w")
    found = joins.keyed_join(a, b, [("k", "other")], condition=lambda x, y: x("v") < y("w"), rows_per_task=20)
    assert bag(found) == collections.Counter((*x, *y[1:]) for x in left for y in right if x[0] is not None and x[0] == y[0] and x[1] < y[1])
    for bad in (dict(on=[]), dict(on="k", how="cross"), dict(on="k", how="left", condition=lambda x, y: x("v") < y("w"))):
        with pytest.raises(ValueError):
            joins.keyed_join(a, a, **bad)


def test_keyed_join_splits_a_key_on_half_the_rows(spark):
    """No partition of the join holds much more than a task's rows of either side, also when all rows are alike."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(0, 40_000, 1, 16).select(F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id") % 997 + 10).alias("k"), F.lit(1).alias("x"))
        right = spark.range(0, 2000, 1, 4).select((F.col("id") % 1200).alias("k"), F.col("id").alias("y"))
        found = joins.keyed_join(left, right, "k", rows_per_task=2000)
        per_task = found.where("k = 5").groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in per_task) == 20_000 * right.where("k = 5").count()
        assert len(per_task) >= 4 and max(r["count"] for r in per_task) <= 0.5 * sum(r["count"] for r in per_task)
        shown = plan(found)
        assert "NestedLoop" not in shown and "Cartesian" not in shown
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty_sides(keyed, spark):
    _, _, a, b = keyed
    none = b.limit(0)
    assert joins.keyed_join(a, none, "k").count() == 0 and joins.keyed_join(a, none, "k", "left").count() == 300
    assert joins.keyed_join(a.limit(0), b, "k", "full").count() == 120
    assert joins.overlap_join(a, none.withColumn("e", F.col("v")), ("v", "v"), ("v", "e")).count() == 0
    assert joins.theta_join(a, none, [("v", "<", "v")]).count() == 0
    assert joins.asof_join(a, none, "v", "k").count() == 300 and joins.asof_join(a.limit(0), b, "v", "k").count() == 0


def spans(rng, n, kinds=(0, 1, 5, 300)):
    rows = []
    for i in range(n):
        s = rng.randrange(-500, 500) if rng.random() < 0.7 else 42
        rows.append((rng.choice("ab"), s, s + rng.choice(kinds) * rng.randrange(0, 4), i))
    return rows + [("a", None, 3, -1), ("b", 3, None, -2), ("a", 9, 1, -3), (None, 0, 10, -4)]


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("rows_per_task", [15, 10**6])
@pytest.mark.parametrize("kinds", [(0,), (1,), (0, 1, 5, 300)])
def test_overlap_join(spark, closed, rows_per_task, kinds):
    rng = random.Random(3)
    left, right = spans(rng, 120, kinds), spans(rng, 90, kinds)
    a, b = spark.createDataFrame(left, "k string, s int, e int, i int"), spark.createDataFrame(right, "k string, s int, e int, i int")

    def meets(x, y):
        if None in (x[1], x[2], y[1], y[2]) or x[1] > x[2] or y[1] > y[2]:
            return False
        return (x[1] <= y[2] and y[1] <= x[2]) if closed else (x[1] < y[2] and y[1] < x[2] and x[1] < x[2] and y[1] < y[2])
    for on in ((), "k"):
        found = joins.overlap_join(a, b, ("s", "e"), ("s", "e"), on, closed, rows_per_task=rows_per_task)
        want = collections.Counter((*x, *(y[1:] if on else y)) for x, y in itertools.product(left, right)
                                   if meets(x, y) and (not on or x[0] is not None and x[0] == y[0]))
        assert bag(found) == want
        shown = plan(found)
        assert "NestedLoop" not in shown and "Cartesian" not in shown


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz", "double", "decimal(20,3)"])
def test_overlap_join_of_other_types(spark, kind):
    rng = random.Random(4)
    days = [(rng.randrange(0, 400), rng.randrange(0, 30)) for _ in range(60)]
    base = spark.createDataFrame([(s, s + n) for s, n in days], "s int, e int")
    if kind.startswith(("date", "time")):
        cast = lambda c: F.date_add(F.lit("1969-06-01").cast("date"), F.col(c)).cast(kind)
    else:
        cast = lambda c: (F.col(c) / 7).cast(kind)
    df = base.select(cast("s").alias("s"), cast("e").alias("e"))
    rows = [tuple(r) for r in df.collect()]
    found = joins.overlap_join(df, df, ("s", "e"), ("s", "e"))
    assert bag(found) == collections.Counter((*x, *y) for x in rows for y in rows if x[0] <= y[1] and y[0] <= x[1])


CONDITIONS = [[("x", "<", "y")], [("x", ">=", "y")], [("x", ">", "y"), ("w", "<=", "y")], [("x", "<=", "y"), ("w", ">", "z")], [("x", "<", "y"), ("w", "<", "y")]]


@pytest.mark.parametrize("conditions", CONDITIONS)
@pytest.mark.parametrize("on", [(), "k"])
def test_theta_join(spark, conditions, on):
    rng = random.Random(5)
    number = lambda: None if rng.random() < 0.05 else 50 if rng.random() < 0.3 else rng.randrange(100)
    left = [(rng.randrange(3), number(), number()) for _ in range(70)]
    right = [(rng.randrange(3), number(), None if rng.random() < 0.1 else float(rng.randrange(100))) for _ in range(60)]
    a, b = spark.createDataFrame(left, "k int, x int, w int"), spark.createDataFrame(right, "k int, y long, z double")
    found = joins.theta_join(a, b, conditions, on, rows_per_bucket=7, rows_per_task=10)
    test = {"<": lambda p, q: p < q, "<=": lambda p, q: p <= q, ">": lambda p, q: p > q, ">=": lambda p, q: p >= q}
    at = {"x": 1, "w": 2, "y": 1, "z": 2}

    def holds(x, y):
        values = [(x[at[p]], op, y[at[q]]) for p, op, q in conditions]
        return all(p is not None and q is not None and test[op](p, q) for p, op, q in values)
    assert bag(found) == collections.Counter((*x, *(y[1:] if on else y)) for x, y in itertools.product(left, right) if holds(x, y) and (not on or x[0] == y[0]))
    shown = plan(found)
    assert "NestedLoop" not in shown and "Cartesian" not in shown


def test_range_join_visits_only_cells_that_can_match(spark):
    left, right = spark.range(2000).select(F.col("id").alias("x")), spark.range(2000).select(F.col("id").alias("y"))
    found = joins.range_join(left, right, "y", F.col("x") - 3, F.col("x") + 3, rows_per_bucket=50)
    assert found.count() == sum(min(1999, x + 3) - max(0, x - 3) + 1 for x in range(2000))
    with pytest.raises(ValueError):
        joins.range_join(left, right, "y")
    with pytest.raises(ValueError):
        joins.theta_join(left, right, [("x", "=", "y")])


def test_range_join_mixed_types_and_nan(spark):
    left = spark.createDataFrame([(1.5,), (float("nan"),), (None,), (1e30,), (-1e30,)], "x double")
    right = spark.createDataFrame([(k,) for k in range(5)], "y int")
    assert bag(joins.theta_join(left, right, [("x", "<", "y")], rows_per_bucket=1)) == collections.Counter(
        [(1.5, k) for k in (2, 3, 4)] + [(-1e30, k) for k in range(5)])


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("allow_equal", [True, False])
@pytest.mark.parametrize("tolerance", [None, 6])
def test_asof_join(spark, small_tasks, direction, allow_equal, tolerance):
    rng = random.Random(6)
    key = lambda: None if rng.random() < 0.05 else "hot" if rng.random() < 0.5 else rng.choice("abc")
    time = lambda: None if rng.random() < 0.05 else rng.randrange(120)
    left = [(key(), time(), i % 50) for i in range(260)]
    right = [(key(), time(), i % 4, f"r{i}") for i in range(90)]
    a, b = spark.createDataFrame(left, "k string, t int, v int"), spark.createDataFrame(right, "k string, t int, v int, s string")
    found = joins.asof_join(a, b, "t", "k", direction, None if tolerance is None else F.lit(tolerance), allow_equal)
    assert found.columns == ["k", "t", "v", "t_right", "v_right", "s"]

    def match(x):
        if x[0] is None or x[1] is None:
            return (None,) * 3
        ok = [y for y in right if y[0] == x[0] and y[1] is not None and (y[1] == x[1] and allow_equal or (y[1] < x[1] if direction == "backward" else y[1] > x[1]))]
        ok = [y for y in ok if tolerance is None or abs(y[1] - x[1]) <= tolerance]
        return max(ok, key=lambda y: (y[1] if direction == "backward" else -y[1], *y[2:]))[1:] if ok else (None,) * 3
    assert bag(found) == collections.Counter((*x, *match(x)) for x in left)


def test_asof_join_of_times_without_keys(spark, small_tasks):
    day = dt.datetime(2024, 1, 1)
    left = spark.createDataFrame([(day + dt.timedelta(hours=h),) for h in range(0, 60, 7)], "at timestamp_ntz")
    right = spark.createDataFrame([(day + dt.timedelta(hours=h), h) for h in range(5, 50, 9)], "seen timestamp_ntz, h int")
    found = joins.asof_join(left, right, ("at", "seen"), tolerance=F.expr("interval 5 hours"))
    want = {h: max((x for x in range(5, 50, 9) if h - 5 <= x <= h), default=None) for h in range(0, 60, 7)}
    assert {r["at"]: r["h"] for r in found.collect()} == {day + dt.timedelta(hours=h): x for h, x in want.items()}
    with pytest.raises(TypeError):
        joins.asof_join(left, right, ("at", "h"))


def test_the_order_sample_does_not_grow(spark, small_tasks):
    """Bounds in the plan stay few while ranges grow with the rows; ranges stay balanced and in order."""
    df = spark.range(0, 4000, 1, 6).select((F.col("id") * 7919 % 4001).alias("x"))
    ordered = ordering.bucketed(df, "x")
    ranges = ordered.df.groupBy(ordering.BUCKET).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy(ordering.BUCKET).collect()
    assert len(ranges) > 100 and max(r.n for r in ranges) < 200
    assert all(a.high <= b.low for a, b in zip(ranges, ranges[1:]))
    indexed = ordering.with_row_index(ordered).select("x", ordering.INDEX).collect()
    assert [x for x, _ in sorted(indexed, key=lambda r: r[1])] == sorted(x for x, _ in indexed)
