"""What a table and its columns look like.

Column statistics of all columns share their passes: one aggregate for counts and
moments, the exact quantile search, one for what depends on quantiles.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import as_text, col, numeric_columns
from ..functions.histograms import bin_counts, edges
from ..functions.quantiles import mixed_quantiles
from ..functions.statistics import null_counts, pearson
from ..functions.values import top_values, value_counts
from ..operators.outliers import fences

# fixed values: how many values the reports list
TOP_DISTRIBUTION, TOP_CLASSES, TOP_UNIQUE, SAMPLE_VALUES, HISTOGRAM_BINS = 5, 30, 100, 3, 5
MISSING_TEXT = "NaN"  # fixed value: how a null value is shown



def _tidy(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A report of one row per column (or bin) from finished statistics."""
    return df.sparkSession.createDataFrame(rows, schema)


def _number(value):
    """Finite float or ``None``."""
    return None if value is None or not math.isfinite(value) else float(value)


def overview(df: DataFrame) -> DataFrame:
    """Rows, columns, numeric and other columns, total nulls."""
    numeric = len(numeric_columns(df))
    nulls = F.lit(0).cast("bigint")
    for c in df.columns:
        nulls = nulls + F.count_if(col(c).isNull())
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"),
                  F.lit(numeric).alias("numeric_columns"), F.lit(len(df.columns) - numeric).alias("other_columns"),
                  nulls.alias("nulls"))


def _moments(df: DataFrame, columns: list[str]) -> tuple[int, dict[str, dict]]:
    exprs = []
    for i, c in enumerate(columns):
        x = col(c)
        exprs.append(F.count(x).alias(f"count{i}"))
        if c in numeric_columns(df):
            d = x.cast("double")
            exprs += [F.avg(d).alias(f"mean{i}"), F.stddev_samp(d).alias(f"std{i}"), F.min(d).alias(f"min{i}"),
                      F.max(d).alias(f"max{i}"), F.skewness(d).alias(f"skew{i}")]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *exprs).first().asDict()
    names = ("count", "mean", "std", "min", "max", "skew")
    return row["rows"], {c: {n: row.get(f"{n}{i}") for n in names} for i, c in enumerate(columns)}


def column_statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Type, counts, moments, median and outliers beyond the quartile fences, one row per column."""
    columns = columns or df.columns
    rows, found = _moments(df, columns)
    numeric = [c for c in columns if c in numeric_columns(df) and found[c]["count"]]
    marks = mixed_quantiles(df, {c: [(0.25, "nearest"), (0.5, "linear"), (0.75, "nearest")] for c in numeric},
                            {c: found[c]["count"] for c in numeric})
    outside = _outside(df, {c: fences(m[0], m[2]) for c, m in marks.items()})
    types = dict(df.dtypes)
    out = []
    for c in columns:
        s = found[c]
        line = [c, types[c], s["count"], rows - s["count"]]
        if c in marks:
            line += [_number(v) or 0.0 for v in (s["mean"], marks[c][1], s["std"], s["min"], s["max"])]
            line += [_number(s["skew"]), outside[c]]
        else:
            line += [None] * 7
        out.append(tuple(line))
    return _tidy(df, out, "column string, type string, count bigint, nulls bigint, mean double, median double, "
                          "std double, min double, max double, skewness double, outliers bigint")


def _outside(df: DataFrame, limits: dict[str, tuple[float, float]]) -> dict[str, int]:
    if not limits:
        return {}
    tests = [F.count_if((col(c) < lo) | (col(c) > hi)).alias(f"o{i}") for i, (c, (lo, hi)) in enumerate(limits.items())]
    row = df.agg(*tests).first()
    return {c: row[f"o{i}"] for i, c in enumerate(limits)}


def _edge_label(a: float, b: float) -> str:
    kind = ".1f" if abs(a) < 1000 and abs(b) < 1000 else ".0e"
    return f"{a:{kind}}–{b:{kind}}"


def histogram(df: DataFrame, columns: list[str] | None = None, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins of numeric columns as label and percent of the non-null values."""
    columns = [c for c in columns or df.columns if c in numeric_columns(df)]
    _, found = _moments(df, columns)
    cuts = {c: edges(s["min"], s["max"], bins) for c, s in found.items() if s["count"]}
    counted = bin_counts(df, cuts)
    out = [(c, i, _edge_label(e[i], e[i + 1]), 100.0 * counted.get((c, i), 0) / found[c]["count"])
           for c, e in cuts.items() for i in range(bins)]
    return _tidy(df, out, "column string, bin int, label string, percentage double")


def _shown(df: DataFrame, name: str):
    return F.coalesce(as_text(df, name), F.lit(MISSING_TEXT))


def top_distribution(df: DataFrame, column: str, k: int = TOP_DISTRIBUTION) -> DataFrame:
    """The most frequent values with their percent of the non-null rows."""
    known = df.agg(F.count(col(column))).first()[0]
    top = top_values(df, column, k)
    if not known:
        top = top.limit(0)
    return top.select(_shown(top, "value").alias("label"), (F.col("count") * 100.0 / F.lit(max(known, 1))).alias("percentage"))


def unique_values(df: DataFrame, column: str, k: int = TOP_UNIQUE, approximate: bool = False) -> DataFrame:
    """The most frequent values and, on every row, how many distinct ones there are (null is one)."""
    distinct = F.approx_count_distinct(col(column)) if approximate else None
    if distinct is None:
        total = value_counts(df, column).count()
    else:
        row = df.agg(distinct.alias("n"), F.max(col(column).isNull()).alias("hole")).first()
        total = row["n"] + int(bool(row["hole"]))
    top = top_values(df, column, k)
    return top.select(_shown(top, "value").alias("value"), "count", F.lit(total).cast("bigint").alias("total_unique"))


def class_distribution(df: DataFrame, column: str, k: int = TOP_CLASSES) -> DataFrame:
    """The most frequent values with their percent of all rows."""
    rows = df.count()
    top = top_values(df, column, k)
    return top.select(_shown(top, "value").alias("value"), "count",
                      (F.col("count") * 100.0 / F.lit(max(rows, 1))).alias("percentage"))


def duplicate_rows(df: DataFrame) -> int:
    """Rows beyond the first of each set of equal rows.

    Rows with a hash of their own cannot be copies: only the rows behind repeated hashes are compared in full.
    """
    keys = [F.xxhash64(*[col(c) for c in df.columns]).alias("__h1"), F.hash(*[col(c) for c in df.columns]).alias("__h2")]
    repeated = df.select(*keys).groupBy("__h1", "__h2").count().filter(F.col("count") > 1)
    rows = df.select("*", *keys).join(repeated, ["__h1", "__h2"], "left_semi")
    copies = rows.groupBy(*[col(c) for c in df.columns]).agg((F.count(F.lit(1)) - 1).alias("extra"))
    return copies.agg(F.coalesce(F.sum("extra"), F.lit(0))).first()[0]


def type_counts(df: DataFrame) -> dict[str, int]:
    """Columns per type."""
    kinds = [t for _, t in df.dtypes]
    return {t: kinds.count(t) for t in dict.fromkeys(kinds)}


def dataset_summary(df: DataFrame) -> DataFrame:
    """Rows, columns, duplicate rows and columns per type as (item, value)."""
    lines = [("rows", df.count()), ("columns", len(df.columns)), ("duplicate_rows", duplicate_rows(df))]
    lines += [(f"type {t}", n) for t, n in type_counts(df).items()]
    return _tidy(df, lines, "item string, value bigint")


def describe(df: DataFrame) -> DataFrame:
    """Counts, moments, extremes and nearest-rank quartiles of every numeric column."""
    numeric = numeric_columns(df)
    rows, found = _moments(df, numeric)
    marks = mixed_quantiles(df, {c: [(q, "nearest") for q in (0.25, 0.5, 0.75)] for c in numeric},
                            {c: found[c]["count"] for c in numeric})
    out = []
    for c in numeric:
        s, (a, b, d) = found[c], [None if v is None else float(v) for v in marks[c]]
        values = [_number(v) for v in (s["mean"], s["std"], s["min"], a, b, d, s["max"])]
        out.append((c, s["count"], rows - s["count"], *values))
    return _tidy(df, out, "column string, count bigint, null_count bigint, mean double, std double, min double, "
                          "p25 double, p50 double, p75 double, max double")


def missing_analysis(df: DataFrame) -> DataFrame:
    """Nulls per column, most first."""
    rows, nulls = null_counts(df)
    out = sorted(((c, n, 100.0 * n / rows) for c, n in nulls.items()), key=lambda r: -r[1]) if rows else []
    return _tidy(df, out, "column string, nulls bigint, percentage double")


def datatype_overview(df: DataFrame) -> DataFrame:
    """Type and the smallest distinct values of every column.

    The next smallest value is a plain minimum over what lies above the last one, so
    no column's values are ever gathered.
    """
    sortable = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    samples: dict[str, list] = {c: [] for c in df.columns}
    last: dict[str, object] = {}
    live = sortable
    for _ in range(SAMPLE_VALUES):
        if not live:
            break
        lows = [F.min(col(c) if c not in last else F.when(col(c) > F.lit(last[c]), col(c))) for c in live]
        row = df.agg(*[m.alias(f"v{i}") for i, m in enumerate(lows)],
                     *[m.cast("string").alias(f"t{i}") for i, m in enumerate(lows)]).first()
        found = {c: (row[f"v{i}"], row[f"t{i}"]) for i, c in enumerate(live) if row[f"v{i}"] is not None}
        for c, (value, text) in found.items():
            samples[c].append(text)
            last[c] = value
        live = list(found)
    return _tidy(df, [(c, t, samples[c]) for c, t in df.dtypes], "column string, dtype string, sample_values array<string>")


def correlation_matrix(df: DataFrame) -> DataFrame:
    """Pearson correlation of every numeric pair, nulls read as 0.0, an undefined one shown as 0.0."""
    names = numeric_columns(df)
    if len(names) < 2:
        return _tidy(df, [], "column_a string, column_b string, correlation double")
    filled = df.select(*[F.coalesce(col(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(names)])
    found = pearson(filled)
    return _tidy(df, [(a, b, found[i, j]) for i, a in enumerate(names) for j, b in enumerate(names)],
                 "column_a string, column_b string, correlation double")


def report(df: DataFrame, kind: str, column: str | None = None) -> DataFrame:
    """One report by name."""
    whole = {"dataset_summary": dataset_summary, "missing_analysis": missing_analysis,
             "datatype_overview": datatype_overview, "correlation_matrix": correlation_matrix}
    if kind in whole:
        return whole[kind](df)
    if kind == "class_distribution":
        if column not in df.columns:
            raise ValueError("class_distribution needs an existing column")
        return class_distribution(df, column)
    raise ValueError(f"unknown report {kind!r}")
