"""One-pass column statistics and correlation."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, functions as F

from .columns import col, is_bad


def moments(df: DataFrame, columns: list[str], *names: str) -> dict[str, dict]:
    """Requested aggregates (avg, stddev_samp, min, max, count, var_samp) for all columns in one pass."""
    if not columns:
        return {}
    exprs = [getattr(F, fn)(col(c)).alias(f"{fn}_{i}") for i, c in enumerate(columns) for fn in names]
    row = df.agg(*exprs).first()
    return {c: {fn: row[f"{fn}_{i}"] for fn in names} for i, c in enumerate(columns)}


def safe_correlation(a: Column, b: Column) -> Column:
    """Pearson correlation over rows with both values; null when either is constant."""
    both = a.isNotNull() & b.isNotNull()
    x = F.when(both, a.cast("double"))
    y = F.when(both, b.cast("double"))
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.try_divide(F.covar_pop(x, y), F.when(spread > 0, spread))


def correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> dict[tuple[str, str], float | None]:
    """Correlation of each pair, all in one aggregate; a column holding any null has none.

    This follows array semantics (a missing value poisons the whole column).
    """
    if not pairs:
        return {}
    names = list(dict.fromkeys(c for p in pairs for c in p))
    holes = [F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(names)]
    corrs = [safe_correlation(col(a), col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]
    row = df.agg(*holes, *corrs).first()
    clean = {c: row[f"n{i}"] == 0 for i, c in enumerate(names)}
    return {p: row[f"r{i}"] if clean[p[0]] and clean[p[1]] else None for i, p in enumerate(pairs)}


def null_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    """Row count and nulls per column, one pass over the table."""
    exprs = [F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *exprs).first()
    return row["rows"], {c: row[f"n{i}"] for i, c in enumerate(df.columns)}


def pearson(df: DataFrame) -> dict[tuple[int, int], float]:
    """Correlations of all column pairs of an all-double table without nulls; 0.0 where one is constant.

    One distributed product of the centred columns, whatever their number.
    """
    vectors = df.select(array_to_vector(F.array(*[col(c) for c in df.columns])).alias("v"))
    spread = df.agg(F.count(F.lit(1)).alias("rows"), *[F.stddev_pop(col(c)).alias(f"s{i}") for i, c in enumerate(df.columns)]).first()
    p = len(df.columns)
    flat = [is_bad(spread[f"s{i}"]) or spread[f"s{i}"] in (0.0, float("inf")) for i in range(p)]
    if all(flat):
        return {(i, j): 0.0 for i in range(p) for j in range(p)}
    matrix = Correlation.corr(vectors, "v").first()[0].toArray()
    return {(i, j): 0.0 if flat[i] or flat[j] else 1.0 if i == j else (0.0 if is_bad(float(matrix[i][j])) else float(matrix[i][j]))
            for i in range(p) for j in range(p)}
