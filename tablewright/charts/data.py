"""The data behind each chart type.

Every chart first keeps its columns and drops rows with a null or NaN among them;
then, where the type supports it, come Top-N categories, aggregation and sorting.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import col, data_type, is_numeric
from ..functions.density import density_curves, density_surface
from ..functions.histograms import bin_table
from ..functions.lookup import broadcast_if_small
from ..functions.quantiles import grouped_quantiles, mixed_quantiles
from ..functions.statistics import pearson
from ..functions.values import top_values
from .rules import SUPPORTS, check_columns, suggest_chart

# fixed values: defaults of the drawing options
HISTOGRAM_BINS, HEX_GRID, BUBBLE_SIZES, PLAIN_BUBBLE, WHISKER = 10, 20, (20.0, 200.0), 100.0, 1.5

_AGGREGATES = {"mean": F.avg, "median": None, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def chart_data(df: DataFrame, chart: str, x: list[str], y: list[str] | None = None,
               options: dict | None = None) -> DataFrame:
    """The table a chart is drawn from; ``chart`` may be "auto"."""
    x, y, options = list(x), list(y or []), options or {}
    if chart == "auto":
        chart = suggest_chart(df, x, y)
    if chart not in SUPPORTS:
        chart = "scatter"
    check_columns(df, chart, x, y)
    return _BUILDERS[chart](_prepare(df, chart, x, y, options), x, y, options)


def _medians(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The median of each column per key, all columns ranked in one pass."""
    long = df.select(col(key).alias("__key"), F.inline(F.array(*[
        F.struct(F.lit(i).alias("__column"), col(c).cast("double").alias("__value")) for i, c in enumerate(columns)])))
    marks = grouped_quantiles(long, ["__key", "__column"], "__value", [0.5])
    return marks.groupBy(F.col("__key").alias(key)).agg(*[F.max(F.when(F.col("__column") == i, F.col("q0"))).alias(c)
                                                          for i, c in enumerate(columns)])


def _prepare(df: DataFrame, chart: str, x: list[str], y: list[str], options: dict) -> DataFrame:
    used = list(dict.fromkeys(x + y))
    out, can = df.select(*[col(c) for c in used]).dropna(), SUPPORTS[chart]
    if "topN" in can and options.get("topNCount"):
        out = _top_categories(out, x[0], int(options["topNCount"]))
    how = options.get("aggregationMethod", "none")
    numeric = [c for c in y if is_numeric(df, c)]
    if "aggregation" in can and how != "none" and numeric:
        if how == "median":
            return _medians(out, x[0], numeric)
        out = out.groupBy(col(x[0])).agg(*[_AGGREGATES[how](col(c)).alias(c) for c in numeric])
    return out


def _top_categories(df: DataFrame, name: str, n: int) -> DataFrame:
    """Rows of the most frequent values of a column."""
    top = top_values(df, name, n).select(F.col("value").alias(name))
    return df.join(broadcast_if_small(top), name, "left_semi").select(*[col(c) for c in df.columns])


def _sorted(df: DataFrame, options: dict, x: str, first_y: str | None, otherwise: str | None = None) -> DataFrame:
    order = options.get("sortOrder", "none")
    if order == "none":
        return df.orderBy(col(otherwise)) if otherwise else df
    key = col(first_y if first_y in df.columns and is_numeric(df, first_y) else x)
    return df.orderBy(key.asc() if order == "asc" else key.desc())


def _long(df: DataFrame, x: str, y: list[str]) -> DataFrame:
    """(x, metric, value) rows, values as doubles."""
    values = [F.struct(F.lit(c).alias("metric"), col(c).cast("double").alias("value")) for c in y if c in df.columns]
    return df.select(col(x), F.inline(F.array(*values)))


def _counts(df: DataFrame, x: str) -> DataFrame:
    return df.groupBy(col(x)).agg(F.count(F.lit(1)).alias("count"))


def _scatter(df, x, y, options):
    if all(is_numeric(df, c) for c in y):
        return _long(df, x[0], y)
    points = [F.struct(F.lit(c).alias("metric"), col(c).cast("string").alias("value")) for c in y]
    return df.select(col(x[0]), F.inline(F.array(*points)))


def _line(df, x, y, options):
    """The mean of each y per x, in order of x."""
    return df.groupBy(col(x[0])).agg(*[F.avg(col(c)).alias(c) for c in y]).orderBy(col(x[0]))


def _bar(df, x, y, options):
    """The mean per x and metric, or counts per x."""
    if not y:
        return _sorted(_counts(df, x[0]), options, x[0], "count")
    means = _long(df, x[0], y).groupBy(col(x[0]), "metric").agg(F.avg("value").alias("value"))
    return _sorted(means, options, x[0], "value")


def _stacked_bar(df, x, y, options):
    """Each value with the base it stands on: the metrics listed before it on the same row."""
    if not y:
        counts = _counts(df, x[0])
        return counts.select(col(x[0]), F.lit("count").alias("metric"), F.col("count").cast("double").alias("value"),
                             F.lit(0.0).alias("base"))
    parts, base = [], F.lit(0.0)
    for c in y:
        value = col(c).cast("double")
        parts.append(F.struct(F.lit(c).alias("metric"), value.alias("value"), base.alias("base")))
        base = base + value
    return _sorted(df, options, x[0], y[0]).select(col(x[0]), F.inline(F.array(*parts)))


def _area(df, x, y, options):
    return df.orderBy(col(x[0]))


def _count(df, x, y, options):
    return _sorted(_counts(df, x[0]), options, x[0], "count")


def _bubble(df, x, y, options):
    """Points with a size between 20 and 200 by the second y; all alike without one."""
    height = col(y[0] if y else x[0]).cast("double").alias("value")
    if len(y) < 2:
        return df.select(col(x[0]), height, F.lit(PLAIN_BUBBLE).alias("size"))
    low, high = df.agg(F.min(col(y[1])), F.max(col(y[1]))).first()
    small, large = BUBBLE_SIZES
    if low is None or low == high:
        return df.select(col(x[0]), height, F.lit(small).alias("size"))
    share = (col(y[1]).cast("double") - F.lit(float(low))) / F.lit(float(high) - float(low))
    return df.select(col(x[0]), height, (F.lit(small) + share * F.lit(large - small)).alias("size"))


def _automatic_bins(n: int, low: float, high: float, quartiles: list, whole_numbers: bool) -> int:
    """The larger bin count of Sturges' rule and the Freedman-Diaconis rule."""
    if n == 0 or low == high:
        return 1
    sturges = (high - low) / (math.log2(n) + 1)
    robust = 2.0 * (quartiles[1] - quartiles[0]) / n ** (1 / 3)
    width = min(robust, sturges) if robust else sturges
    if whole_numbers and width < 1:
        width = 1.0
    return max(1, math.ceil((high - low) / width))


def _histogram(df, x, y, options):
    """Bin ranges and counts per x column, empty bins included."""
    numeric = [c for c in x if is_numeric(df, c)]
    exprs = [e for i, c in enumerate(numeric) for e in (
        F.count(col(c)).alias(f"n{i}"), F.min(col(c)).cast("double").alias(f"lo{i}"), F.max(col(c)).cast("double").alias(f"hi{i}"))]
    row = df.agg(*exprs).first()
    shape = {c: (row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(numeric) if row[f"n{i}"]}
    if options.get("binningEnabled"):
        bins = {c: int(options.get("binCount", HISTOGRAM_BINS)) for c in shape}
    else:
        marks = mixed_quantiles(df, {c: [(0.25, "linear"), (0.75, "linear")] for c in shape}, {c: s[0] for c, s in shape.items()})
        bins = {c: _automatic_bins(*s, marks[c], isinstance(data_type(df, c), T.IntegralType)) for c, s in shape.items()}
    return bin_table(df, {c: (s[1], s[2], bins[c]) for c, s in shape.items()})


def _groups(df: DataFrame, x: list[str], y: list[str]) -> tuple[DataFrame, list[str]]:
    """(x, metric, value) with its keys; without y, x itself is the only metric."""
    if y:
        return _long(df, x[0], y), [x[0], "metric"]
    return df.select(F.lit(x[0]).alias("metric"), col(x[0]).cast("double").alias("value")), ["metric"]


def _with_fences(values: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    marks = grouped_quantiles(values, keys, "value", [0.25, 0.5, 0.75])
    reach = (F.col("q2") - F.col("q0")) * WHISKER
    marks = marks.withColumns({"low_fence": F.col("q0") - reach, "high_fence": F.col("q2") + reach})
    return marks, values.join(broadcast_if_small(marks), keys)


def _box(df, x, y, options):
    """Quartiles, whiskers at the last value within 1.5 ranges, and the number of outliers per group."""
    values, keys = _groups(df, x, y)
    _, near = _with_fences(values, keys)
    inside = F.col("value").between(F.col("low_fence"), F.col("high_fence"))
    boxes = near.groupBy(*[col(k) for k in keys], "n", "q0", "q1", "q2").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"), F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"))
    boxes = boxes.withColumnsRenamed({"q0": "q25", "q1": "median", "q2": "q75"})
    return _sorted(boxes, options, x[0] if y else "metric", "median")


def box_outliers(df: DataFrame, x: list[str], y: list[str] | None = None, options: dict | None = None) -> DataFrame:
    """All values a box chart draws as single points."""
    y = list(y or [])
    check_columns(df, "box", x, y)
    values, keys = _groups(_prepare(df, "box", x, y, options or {}), x, y)
    _, near = _with_fences(values, keys)
    outside = ~F.col("value").between(F.col("low_fence"), F.col("high_fence"))
    return near.filter(outside).select(*[col(k) for k in keys], "value")


def _violin(df, x, y, options):
    """The density curve of each group with its quartiles."""
    values, keys = _groups(df, x, y)
    marks = grouped_quantiles(values, keys, "value", [0.25, 0.5, 0.75])
    curves = density_curves(values, "value", keys)
    marks = marks.withColumnsRenamed({"q0": "q25", "q1": "median", "q2": "q75"})
    return curves.withColumnRenamed("x", "at").join(broadcast_if_small(marks), keys)


def _heatmap(df, x, y, options):
    """Correlation of every pair of the chosen columns."""
    names = list(dict.fromkeys(x + y))
    found = pearson(df.select(*[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)]))
    rows = [(a, b, found[i, j]) for i, a in enumerate(names) for j, b in enumerate(names)]
    return df.sparkSession.createDataFrame(rows, "column_a string, column_b string, correlation double")


def _density(df, x, y, options):
    return density_surface(df, x[0], y[0]) if y else density_curves(df, x[0])


def _hexbin(df, x, y, options):
    """Counts per hexagon: each point goes to the nearer of two offset rectangular lattices."""
    nx = int(options.get("binCount", HEX_GRID)) if options.get("binningEnabled") else HEX_GRID
    ny = int(nx / math.sqrt(3))
    a, b = col(x[0]).cast("double"), col(y[0] if y else x[0]).cast("double")
    row = df.agg(F.min(a), F.max(a), F.min(b), F.max(b)).first()
    if row[0] is None:
        return df.sparkSession.createDataFrame([], "x double, y double, count bigint")
    (left, wide), (bottom, tall) = _lattice(row[0], row[1], nx), _lattice(row[2], row[3], ny)
    u, v = (a - F.lit(left)) / F.lit(wide), (b - F.lit(bottom)) / F.lit(tall)
    corner = F.rint(u), F.rint(v)
    middle = F.floor(u) + F.lit(0.5), F.floor(v) + F.lit(0.5)
    nearer = _gap(u, v, corner) < _gap(u, v, middle)
    cell = F.when(nearer, F.struct(corner[0].alias("i"), corner[1].alias("j"))).otherwise(
        F.struct(middle[0].alias("i"), middle[1].alias("j")))
    counted = df.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("count"))
    return counted.select((F.col("cell.i") * F.lit(wide) + F.lit(left)).alias("x"),
                          (F.col("cell.j") * F.lit(tall) + F.lit(bottom)).alias("y"), "count")


def _lattice(low: float, high: float, cells: int) -> tuple[float, float]:
    """Origin and step over a range widened a little, so that no point lies on the edge."""
    if low == high:
        low, high = low - 0.5, high + 0.5
    pad = 1e-9 * (high - low)
    return low - pad, (high - low + 2 * pad) / cells


def _gap(u: Column, v: Column, at: tuple[Column, Column]) -> Column:
    return (u - at[0]) * (u - at[0]) + (v - at[1]) * (v - at[1]) * 3.0


_BUILDERS = {
    "scatter": _scatter, "line": _line, "histogram": _histogram, "bar": _bar, "stacked_bar": _stacked_bar,
    "horizontal_bar": _bar, "area": _area, "bubble": _bubble, "box": _box, "violin": _violin, "heatmap": _heatmap,
    "count": _count, "density": _density, "kde": _density, "hexbin": _hexbin,
}
