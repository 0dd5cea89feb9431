"""Filling missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.columns import col, data_type, is_numeric, literal_for, named_columns, with_columns
from ..functions.ordering import INDEX, bucketed, carried, with_row_index
from ..functions.quantiles import column_quantiles
from ..functions.statistics import moments
from ..functions.values import most_frequent_of
from ..plans.registry import table_step


def _fill_values(df: DataFrame, params: dict) -> dict:
    names, strategy = named_columns(df, params), params.get("strategy", "mean")
    numeric = [c for c in names if is_numeric(df, c)]
    if strategy == "mean":
        return {c: m["avg"] for c, m in moments(df, numeric, "avg").items()}
    if strategy == "median":
        return {c: q[0] for c, q in column_quantiles(df, numeric, [0.5], "linear").items()}
    if strategy == "mode":
        return most_frequent_of(df, names)
    if strategy == "constant" and params.get("value") is not None:
        return {c: params["value"] for c in names}
    return {}


@table_step("fill_null", fit=_fill_values, streams=True)
def fill_null(df: DataFrame, params: dict, values: dict) -> DataFrame:
    """Nulls become the mean (default), median, lowest mode or a constant; NaN stays.

    A mean or median makes the column double.
    """
    averaged = params.get("strategy", "mean") in ("mean", "median")
    new = {}
    for name, value in values.items():
        if value is None or name not in df.columns:
            continue
        if averaged:
            new[name] = F.coalesce(col(name).cast("double"), F.lit(float(value)))
        elif params.get("strategy") == "mode":
            new[name] = F.coalesce(col(name), F.lit(value).cast(data_type(df, name)))
        else:
            new[name] = F.coalesce(col(name), _constant(df, name, value))
    return with_columns(df, new)


def _constant(df: DataFrame, name: str, value):
    dtype = data_type(df, name)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        raise ValueError(f"cannot fill {name!r} with a constant")
    return literal_for(dtype, value)


@table_step("ffill")
def ffill(df: DataFrame, params: dict) -> DataFrame:
    """The last known value, carried down in row order."""
    return _carry(df, params, backward=False)


@table_step("bfill")
def bfill(df: DataFrame, params: dict) -> DataFrame:
    """The next known value, carried up in row order."""
    return _carry(df, params, backward=True)


def _carry(df: DataFrame, params: dict, backward: bool) -> DataFrame:
    name = params.get("column")
    if name not in df.columns:
        return df
    ordered = bucketed(df, params.get("order_by"))
    return ordered.restore(carried(ordered, col(name), {name: backward}))


@table_step("interpolate")
def interpolate(df: DataFrame, params: dict) -> DataFrame:
    """Straight line by row position between known neighbours; open ends stay null."""
    name = params.get("column")
    if name not in df.columns:
        return df
    ordered = bucketed(df, params.get("order_by"))
    known = F.when(col(name).isNotNull(), F.struct(col(name).cast("double").alias("v"), F.col(INDEX).alias("i")))
    both = carried(ordered, known, {"__before": False, "__after": True}, with_row_index(ordered))
    before, after = F.col("__before"), F.col("__after")
    share = F.try_divide((F.col(INDEX) - before["i"]).cast("double"), (after["i"] - before["i"]).cast("double"))
    line = before["v"] + (after["v"] - before["v"]) * share
    return ordered.restore(both.withColumn(name, F.coalesce(col(name).cast("double"), line)))
