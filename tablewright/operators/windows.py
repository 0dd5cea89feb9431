"""Rolling statistics over row-count windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import col
from ..functions.ordering import rolling
from ..plans.registry import table_step

_OPERATIONS = {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum}


@table_step("rolling_window")
def rolling_window(df: DataFrame, params: dict) -> DataFrame:
    """mean, std or sum over the current row and the ``window - 1`` before it, nulls skipped."""
    name, size = params.get("column"), int(params.get("window", 3))
    op = params.get("operation", "mean")
    if name not in df.columns or op not in _OPERATIONS:
        return df
    new = params.get("new_name") or f"{name}_rolling_{op}_{size}"
    return rolling(df, params.get("order_by"), size, {new: _OPERATIONS[op](col(name))})
