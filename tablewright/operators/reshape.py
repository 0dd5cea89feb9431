"""Long to wide and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.columns import as_text, col, is_numeric
from ..functions.ordering import INDEX, bucketed, order_columns, with_row_index
from ..functions.quantiles import grouped_quantiles
from ..functions.values import sorted_values
from ..plans.registry import table_step

_AGGREGATES = {"mean": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "median": None}


def _pivot_values(df: DataFrame, params: dict) -> list | None:
    index, across, value = params.get("index"), params.get("columns_col"), params.get("values")
    if not {index, across, value} <= set(df.columns):
        return None
    return sorted_values(_pivot_rows(df, params), across)


def _pivot_rows(df: DataFrame, params: dict) -> DataFrame:
    rows = df.filter(col(params["index"]).isNotNull() & col(params["columns_col"]).isNotNull())
    if params.get("aggfunc", "mean") in ("sum", "count"):
        return rows
    return rows.filter(col(params["values"]).isNotNull())


@table_step("pivot_table", fit=_pivot_values)
def pivot_table(df: DataFrame, params: dict, across: list | None) -> DataFrame:
    """One row per index value and one column per value of ``columns_col``; gaps are null."""
    if across is None:
        return df
    index, kind = params["index"], params.get("aggfunc", "mean")
    if kind not in _AGGREGATES:
        raise ValueError(f"unknown aggfunc {kind!r}")
    value = col(params["values"])
    if kind == "median":
        rows = _pivot_rows(df, params).select(col(index).alias("__index"), col(params["columns_col"]).alias("__across"),
                                              value.cast("double").alias("__value"))
        cells = grouped_quantiles(rows, ["__index", "__across"], "__value", [0.5]).withColumnRenamed("q0", "__cell")
        return _picked(cells, index, across)
    cell = F.coalesce(F.sum(value), F.lit(0)) if kind == "sum" else _AGGREGATES[kind](value)
    # two steps, so that an absent combination stays null while an empty sum is 0
    cells = (_pivot_rows(df, params).groupBy(col(index).alias("__index"), col(params["columns_col"]).alias("__across"))
             .agg(cell.alias("__cell")))
    return _picked(cells, index, across)


def _picked(cells: DataFrame, index: str, across: list) -> DataFrame:
    picks = [F.max(F.when(F.col("__across") == F.lit(v), F.col("__cell"))).alias(str(v)) for v in across]
    return cells.groupBy(F.col("__index").alias(index)).agg(*picks)


@table_step("melt", streams=True)
def melt(df: DataFrame, params: dict) -> DataFrame:
    """Columns to (variable, value) rows; values become double if all numeric, else text."""
    ids = [c for c in params.get("id_vars") or [] if c in df.columns]
    values = [c for c in params.get("value_vars") or [] if c in df.columns]
    if not ids and not values:
        return df
    values = values or [c for c in df.columns if c not in ids]
    types = {df.schema[c].dataType.simpleString() for c in values}
    if len(types) > 1:
        numeric = all(is_numeric(df, c) for c in values)
        df = df.withColumns({c: col(c).cast("double") if numeric else as_text(df, c) for c in values})
    return df.unpivot([col(c) for c in ids], [col(c) for c in values], "variable", "value")


@table_step("transpose")
def transpose(df: DataFrame, params: dict) -> DataFrame:
    """Columns become rows headed by ``index``; row i becomes ``column_i``.

    The result is as wide as the table is long; ``max_rows`` refuses longer tables. Cells
    are numbered and regrouped by column, and only the number of rows reaches the driver.
    """
    order = order_columns(params.get("order_by"))
    numeric = all(isinstance(f.dataType, T.NumericType) for f in df.schema.fields)
    whole = all(isinstance(f.dataType, T.IntegralType) for f in df.schema.fields)
    kind = "bigint" if whole else "double" if numeric else "string"
    rows, most = df.count(), params.get("max_rows")
    if most is not None and rows > int(most):
        raise ValueError(f"cannot transpose {rows} rows, more than max_rows")
    if not rows:
        names = F.array(*[F.struct(F.lit(c).alias("index")) for c in df.columns])
        return df.sparkSession.range(1).select(F.inline(names))
    cells = F.array(*[F.struct(F.lit(j).alias("at"), F.lit(c).alias("index"), col(c).cast(kind).alias("value"))
                      for j, c in enumerate(df.columns)])
    numbered = with_row_index(bucketed(df, order)).select(F.col(INDEX).alias("row"), F.inline(cells))
    lists = (numbered.groupBy("at", "index").agg(F.sort_array(F.collect_list(F.struct("row", "value"))).alias("cells"))
             .orderBy("at"))
    return lists.select("index", *[F.get("cells", F.lit(i))["value"].alias(f"column_{i}") for i in range(rows)])
