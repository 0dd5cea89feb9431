"""Row and column filters."""

from __future__ import annotations

from functools import reduce
import operator

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import as_text, col, comparison_literal, data_type
from ..functions.ordering import INDEX, bucketed, order_columns, with_row_index
from ..functions.statistics import null_counts
from ..plans.registry import row_step, table_step
from .text import java_pattern

_TESTS = {"==": operator.eq, "!=": operator.ne, ">": operator.gt, "<": operator.lt}


@row_step("filter_rows")
def filter_rows(df: DataFrame, params: dict) -> DataFrame:
    """Keep rows passing one test; the value is read as the column's type. Null never passes."""
    name, op, value = params.get("column"), params.get("operator"), params.get("value")
    if name not in df.columns or value is None:
        return df
    if op == "contains":
        return df.filter(as_text(df, name).rlike(java_pattern(str(value))))
    if op not in _TESTS:
        return df
    return df.filter(_TESTS[op](col(name), comparison_literal(data_type(df, name), value)))


@row_step("drop_null_rows")
def drop_null_rows(df: DataFrame, params: dict) -> DataFrame:
    """Drop rows by nulls only; NaN is a value."""
    scope, name = params.get("scope", "column"), params.get("column")
    if scope == "column":
        return df.filter(col(name).isNotNull()) if name in df.columns else df
    present = [col(c).isNotNull() for c in df.columns]
    if scope == "any":
        return df.filter(reduce(operator.and_, present))
    return df.filter(reduce(operator.or_, present)) if scope == "all" else df


def _sparse_columns(df: DataFrame, params: dict) -> list[str]:
    limit = float(params.get("threshold", 50)) / 100
    rows, nulls = null_counts(df)
    return [c for c, n in nulls.items() if rows and n / rows > limit]


@table_step("drop_cols_null_threshold", fit=_sparse_columns, streams=True)
def drop_cols_null_threshold(df: DataFrame, params: dict, sparse: list[str]) -> DataFrame:
    return df.drop(*sparse)


@table_step("drop_rows_index")
def drop_rows_index(df: DataFrame, params: dict) -> DataFrame:
    """Drop the rows at zero-based positions ``start`` to ``end``, both included."""
    start, end = params.get("start"), params.get("end")
    if start is None or end is None:
        return df
    ordered = bucketed(df, order_columns(params.get("order_by")))
    numbered = with_row_index(ordered)
    kept = numbered.filter((F.col(INDEX) < int(start)) | (F.col(INDEX) > int(end)))
    return ordered.restore(kept)
