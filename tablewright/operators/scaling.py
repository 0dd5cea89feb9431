"""Scaling of numeric columns; statistics of all columns come from shared passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import col, named_columns, with_columns
from ..functions.quantiles import column_quantiles, mixed_quantiles
from ..functions.statistics import moments
from ..plans.registry import table_step


def _range(df: DataFrame, params: dict) -> dict:
    return {c: (m["min"], m["max"]) for c, m in moments(df, named_columns(df, params), "min", "max").items()}


@table_step("min_max_scale", fit=_range, streams=True)
def min_max_scale(df: DataFrame, params: dict, ranges: dict) -> DataFrame:
    """To [0, 1]; a constant column becomes 0.0 in every row."""
    return with_columns(df, {c: _scaled(c, low, None if low is None else high - low)
                             for c, (low, high) in ranges.items()})


def _spread(df: DataFrame, params: dict) -> dict:
    found = moments(df, named_columns(df, params), "avg", "stddev_samp")
    return {c: (m["avg"], m["stddev_samp"]) for c, m in found.items()}


@table_step("standardize", fit=_spread, streams=True)
def standardize(df: DataFrame, params: dict, spreads: dict) -> DataFrame:
    """Zero mean and unit sample deviation; a constant column becomes 0.0 in every row."""
    return with_columns(df, {c: _scaled(c, mean, sd) for c, (mean, sd) in spreads.items()})


def _quartiles(df: DataFrame, params: dict):
    name = params.get("column")
    if name not in df.columns:
        return None
    return mixed_quantiles(df, {name: [(0.25, "nearest"), (0.5, "linear"), (0.75, "nearest")]})[name]


@table_step("robust_scale", fit=_quartiles, streams=True)
def robust_scale(df: DataFrame, params: dict, quartiles) -> DataFrame:
    """Median to zero, interquartile range to one; a zero range gives 0.0 in every row."""
    if quartiles is None or quartiles[0] is None:
        return df
    low, middle, high = quartiles
    return df.withColumn(params["column"], _scaled(params["column"], middle, high - low))


def _scaled(name: str, center, width):
    if center is None or width is None:
        return F.lit(None).cast("double")
    if width == 0:
        return F.lit(0.0)
    return (col(name).cast("double") - F.lit(float(center))) / F.lit(float(width))


def _tails(df: DataFrame, params: dict):
    name = params.get("column")
    if name not in df.columns:
        return None
    probs = [float(params.get("lower_q", 0.01)), float(params.get("upper_q", 0.99))]
    return column_quantiles(df, [name], probs)[name]


@table_step("cap_clip", fit=_tails, streams=True)
def cap_clip(df: DataFrame, params: dict, tails) -> DataFrame:
    """Pull values beyond two quantiles back to them; nulls stay null."""
    if tails is None or tails[0] is None:
        return df
    name = params["column"]
    c, low, high = col(name), F.lit(tails[0]), F.lit(tails[1])
    return df.withColumn(name, F.when(c < low, low).when(c > high, high).otherwise(c))
