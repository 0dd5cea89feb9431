"""Sorting, sampling and de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import col, named_columns
from ..functions.ordering import order_columns
from ..functions.sampling import sample_exactly
from ..plans.registry import table_step


@table_step("sort_column")
def sort_column(df: DataFrame, params: dict) -> DataFrame:
    """Sort by one column; nulls come first either way."""
    name = params.get("column")
    if name not in df.columns:
        return df
    c = col(name)
    return df.orderBy(c.asc_nulls_first() if params.get("ascending", True) else c.desc_nulls_first())


@table_step("sample_rows")
def sample_rows(df: DataFrame, params: dict) -> DataFrame:
    """A seeded sample of an exact size, the same under any partitioning."""
    value, seed = float(params.get("value", 100)), int(params.get("random_state", 42))
    rows = df.count()
    wanted = min(int(value), rows) if params.get("method", "count") == "count" else int(min(value, 1.0) * rows)
    return sample_exactly(df, wanted, seed, rows)


@table_step("remove_duplicates")
def remove_duplicates(df: DataFrame, params: dict) -> DataFrame:
    """Distinct rows; refused on a stream, where it would have to remember every row."""
    return df.dropDuplicates()


@table_step("deduplicate_subset")
def deduplicate_subset(df: DataFrame, params: dict) -> DataFrame:
    """One row per key; with ``order_by`` the first row, otherwise any.

    ``min_by`` combines on the map side, so a hot key costs one row per task.
    """
    keys = [c for c in params.get("columns") or [] if c in df.columns]
    if not keys:
        return df
    if not params.get("order_by"):
        return df.dropDuplicates(keys)
    order = order_columns(params["order_by"])
    rank = F.struct(*[col(c) for c in order], F.xxhash64(*[col(c) for c in df.columns]))
    row = F.struct(*[col(c) for c in df.columns])
    first = df.groupBy(*[col(k).alias(f"__key{i}") for i, k in enumerate(keys)]).agg(F.min_by(row, rank).alias("__row"))
    return first.select("__row.*")
