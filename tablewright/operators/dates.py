"""Parts of dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import col, is_temporal, with_columns
from ..plans.registry import row_step

# fixed values: part names; days of the week count from Monday = 0
PARTS = {
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "dayofweek": F.weekday,
    "hour": F.hour,
    "quarter": F.quarter,
    "minute": F.minute,
    "second": F.second,
}


@row_step("date_parts")
def date_parts(df: DataFrame, params: dict) -> DataFrame:
    name = params.get("column")
    if name not in df.columns:
        raise ValueError(f"no column {name!r} to take date parts from")
    if not is_temporal(df, name):
        raise ValueError(f"column {name!r} is not a date or timestamp; change its type first")
    wanted = params.get("parts", ["year", "month", "day"])
    return with_columns(df, {f"{name}_{p}": PARTS[p](col(name)) for p in wanted if p in PARTS})
