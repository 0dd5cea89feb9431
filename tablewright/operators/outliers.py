"""Outlier flags and removal."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import col
from ..functions.quantiles import column_quantiles
from ..functions.statistics import moments
from ..plans.registry import table_step

IQR_REACH = 1.5  # fixed value: fence distance in interquartile ranges


def fences(low, high) -> tuple[float, float] | None:
    """The range of ordinary values around two quartiles."""
    if low is None:
        return None
    reach = IQR_REACH * (float(high) - float(low))
    return float(low) - reach, float(high) + reach


def _iqr_fences(df: DataFrame, params: dict):
    name = params.get("column")
    if name not in df.columns:
        return None
    return fences(*column_quantiles(df, [name], [0.25, 0.75])[name])


def _deviation(df: DataFrame, params: dict):
    name = params.get("column")
    if name not in df.columns:
        return None
    m = moments(df, [name], "avg", "stddev_samp")[name]
    usable = m["stddev_samp"] is not None and m["stddev_samp"] > 0
    return (float(m["avg"]), float(m["stddev_samp"])) if usable else None


def _zscore(name: str, spread):
    mean, sd = spread
    return F.abs((col(name).cast("double") - F.lit(mean)) / F.lit(sd))


@table_step("detect_iqr", fit=_iqr_fences, streams=True)
def detect_iqr(df: DataFrame, params: dict, limits) -> DataFrame:
    if limits is None:
        return df
    c = col(params["column"])
    return df.withColumn(f"{params['column']}_outlier_iqr",
                         ((c < limits[0]) | (c > limits[1])).cast("int"))


@table_step("detect_zscore", fit=_deviation, streams=True)
def detect_zscore(df: DataFrame, params: dict, spread) -> DataFrame:
    """Flags beyond ``threshold`` deviations; without any spread no column is added."""
    if spread is None:
        return df
    name = params["column"]
    far = _zscore(name, spread) > float(params.get("threshold", 3.0))
    return df.withColumn(f"{name}_outlier_z", far.cast("int"))


def _limits(df: DataFrame, params: dict):
    return (_iqr_fences if params.get("method", "iqr") == "iqr" else _deviation)(df, params)


@table_step("remove_outliers", fit=_limits, streams=True)
def remove_outliers(df: DataFrame, params: dict, limits) -> DataFrame:
    """Keep ordinary rows; rows with a null go too, unless there is nothing to measure by."""
    if limits is None:
        return df
    name = params["column"]
    if params.get("method", "iqr") == "iqr":
        return df.filter(col(name).between(*limits))
    return df.filter(_zscore(name, limits) <= float(params.get("threshold", 3.0)))
