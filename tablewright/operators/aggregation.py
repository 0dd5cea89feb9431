"""Grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col, is_floating
from ..plans.registry import table_step


def skipping_nan(df: DataFrame, name: str, fn) -> Column:
    """min or max that prefers real numbers over NaN."""
    c = col(name)
    return F.coalesce(fn(F.when(~F.isnan(c), c)), fn(c)) if is_floating(df, name) else fn(c)


@table_step("groupby_aggregate")
def groupby_aggregate(df: DataFrame, params: dict) -> DataFrame:
    """One row per key (null is a key); the result keeps the aggregated column's name."""
    keys, name, kind = params.get("group_cols") or [], params.get("agg_col"), params.get("agg_type", "mean")
    if not keys or name not in df.columns:
        return df
    aggregates = {
        "mean": lambda: F.avg(col(name)),
        "sum": lambda: F.coalesce(F.sum(col(name)), F.lit(0)),
        "count": lambda: F.count(col(name)),
        "min": lambda: skipping_nan(df, name, F.min),
        "max": lambda: skipping_nan(df, name, F.max),
    }
    if kind not in aggregates:
        return df
    return df.groupBy(*[col(k) for k in keys]).agg(aggregates[kind]().alias(name))
