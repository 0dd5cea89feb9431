"""Projections and column arithmetic."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.columns import as_text, col, data_type, named_columns, natural_log, with_columns
from ..functions.formula import formula_column
from ..plans.registry import row_step, table_step

# fixed values: type names a step may ask for
TYPES = {
    "int64": T.LongType(),
    "float64": T.DoubleType(),
    "object": T.StringType(),
    "str": T.StringType(),
    "string": T.StringType(),
    "bool": T.BooleanType(),
    "datetime": T.TimestampNTZType(),
}


@row_step("drop_columns")
def drop_columns(df: DataFrame, params: dict) -> DataFrame:
    return df.drop(*named_columns(df, params))


@row_step("rename_column")
def rename_column(df: DataFrame, params: dict) -> DataFrame:
    renames = params.get("columns") or {params.get("oldName"): params.get("newName")}
    present = {old: new for old, new in dict(renames).items() if old in df.columns and new}
    return df.withColumnsRenamed(present) if present else df


@row_step("reorder_column")
def reorder_column(df: DataFrame, params: dict) -> DataFrame:
    name, names = params.get("column"), list(df.columns)
    if name not in names:
        return df
    at = names.index(name)
    target = {"start": 0, "end": len(names) - 1, "left": max(at - 1, 0),
              "right": min(at + 1, len(names) - 1)}.get(params.get("direction"), at)
    names.insert(target, names.pop(at))
    return df.select(*[col(c) for c in names])


@row_step("duplicate_column")
def duplicate_column(df: DataFrame, params: dict) -> DataFrame:
    name, new = params.get("column"), params.get("new_name")
    return df.withColumn(new, col(name)) if name in df.columns and new else df


@row_step("change_datatype")
def change_datatype(df: DataFrame, params: dict) -> DataFrame:
    """Strict cast (bad input fails the query); ``errors="null"`` gives nulls instead.

    Text to datetime always gives null for what cannot be read.
    """
    target = TYPES.get(params.get("dtype"))
    if target is None:
        return df
    new = {}
    for name in named_columns(df, params):
        if isinstance(target, T.TimestampNTZType):
            new[name] = as_text(df, name).try_cast(target)
        elif params.get("errors") == "null":
            new[name] = col(name).try_cast(target)
        else:
            new[name] = col(name).cast(target)
    return with_columns(df, new)


@row_step("merge_columns")
def merge_columns(df: DataFrame, params: dict) -> DataFrame:
    first, second, new = params.get("column"), params.get("column2"), params.get("new_name")
    if not new or not {first, second} <= set(df.columns):
        return df
    glue = F.lit(params.get("separator", " "))
    return df.withColumn(new, F.concat(as_text(df, first), glue, as_text(df, second)))


def _parts(df: DataFrame, params: dict):
    delimiter = params.get("delimiter", ",")
    return F.split(as_text(df, params["column"]), re.escape(delimiter) if delimiter else "")


def _most_parts(df: DataFrame, params: dict):
    if params.get("column") not in df.columns:
        return 0
    return df.agg(F.max(F.size(_parts(df, params)))).first()[0] or 0


@table_step("split_column", fit=_most_parts, streams=True)
def split_column(df: DataFrame, params: dict, most: int) -> DataFrame:
    """Numbered parts of a text; a row with fewer parts has nulls at the end."""
    if not most or most < 0:
        return df
    name = params["column"]
    # split once per row, not once per part
    split = df.withColumn("__parts", _parts(df, params))
    return split.select(*[col(c) for c in df.columns if c not in (new := [f"{name}_split_{i + 1}" for i in range(most)])],
                        *[F.get("__parts", F.lit(i)).alias(n) for i, n in enumerate(new)])


@row_step("interaction_terms")
def interaction_terms(df: DataFrame, params: dict) -> DataFrame:
    first, second = params.get("column"), params.get("column2")
    if not {first, second} <= set(df.columns):
        return df
    return df.withColumn(params.get("new_name") or f"{first}_x_{second}", col(first) * col(second))


@row_step("log_transform")
def log_transform(df: DataFrame, params: dict) -> DataFrame:
    name = params.get("column")
    if name not in df.columns:
        return df
    return df.withColumn(name, natural_log(col(name) + F.lit(float(params.get("shift", 1)))))


@row_step("sqrt_transform")
def sqrt_transform(df: DataFrame, params: dict) -> DataFrame:
    name = params.get("column")
    return df.withColumn(name, F.sqrt(col(name))) if name in df.columns else df


@row_step("power_transform")
def power_transform(df: DataFrame, params: dict) -> DataFrame:
    name = params.get("column")
    if name not in df.columns:
        return df
    return df.withColumn(name, F.pow(col(name).cast("double"), F.lit(float(params.get("exponent", 2)))))


@row_step("custom_formula")
def custom_formula(df: DataFrame, params: dict) -> DataFrame:
    """A new column from an arithmetic, comparison or boolean formula; errors are raised."""
    formula, new = params.get("formula"), params.get("new_name")
    if not formula or not new:
        return df
    return df.withColumn(new, formula_column(df, formula))


@row_step("toggle_bool")
def toggle_bool(df: DataFrame, params: dict) -> DataFrame:
    flip = [c for c in named_columns(df, params) if isinstance(data_type(df, c), T.BooleanType)]
    return with_columns(df, {c: ~col(c) for c in flip})


@row_step("flag_null")
def flag_null(df: DataFrame, params: dict) -> DataFrame:
    name = params.get("column")
    return df.withColumn(f"{name}_isnull", col(name).isNull().cast("int")) if name in df.columns else df
