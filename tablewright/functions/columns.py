"""Small column builders and parameter helpers."""

from __future__ import annotations

import decimal
import math

from pyspark.sql import Column, DataFrame, functions as F, types as T

TRUE_WORDS = {"true", "1", "yes", "y", "t"}  # fixed value: texts read as boolean true

TEXT = "string"


def col(name: str) -> Column:
    """Reference a column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def spare_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns, made longer until the table has none of them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def named_columns(df: DataFrame, params: dict) -> list[str]:
    """The existing columns a step names, through ``columns`` or ``column``."""
    wanted = params.get("columns") or [params.get("column")]
    have = set(df.columns)
    return list(dict.fromkeys(c for c in wanted if c in have))


def with_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Add or replace columns in one projection, keeping positions."""
    return df.withColumns(new) if new else df


def data_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(data_type(df, name), T.NumericType)


def is_floating(df: DataFrame, name: str) -> bool:
    return isinstance(data_type(df, name), (T.DoubleType, T.FloatType))


def is_temporal(df: DataFrame, name: str) -> bool:
    return isinstance(data_type(df, name), (T.TimestampType, T.TimestampNTZType, T.DateType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def as_text(df: DataFrame, name: str) -> Column:
    return col(name) if isinstance(data_type(df, name), T.StringType) else col(name).cast(TEXT)


def finite(df: DataFrame, name: str) -> Column:
    """NaN and infinities become null, as at a result boundary."""
    c = col(name)
    if not is_floating(df, name):
        return c
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def literal_for(dtype: T.DataType, value) -> Column:
    """A user value (often text from a form) as a literal of a column's type."""
    if isinstance(dtype, T.BooleanType):
        truth = value if isinstance(value, bool) else str(value).strip().lower() in TRUE_WORDS
        return F.lit(truth)
    if isinstance(dtype, T.IntegralType):
        return F.lit(int(float(value)) if not isinstance(value, int) else int(value)).cast(dtype)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.lit(float(value)).cast(dtype)
    if isinstance(dtype, T.StringType):
        return F.lit(str(value))
    return F.lit(str(value)).cast(dtype)


def comparison_literal(dtype: T.DataType, value) -> Column:
    """Like ``literal_for`` but an integer column keeps a fractional bound."""
    if isinstance(dtype, T.NumericType) and not isinstance(value, bool):
        number = float(value)
        whole = number.is_integer() and isinstance(dtype, T.IntegralType)
        if whole:
            return F.lit(int(value) if isinstance(value, (int, str)) and _is_int(value) else int(number))
        if isinstance(dtype, T.DecimalType):
            return F.lit(decimal.Decimal(str(value)))  # in the bound's own scale
        return F.lit(number)
    return literal_for(dtype, value)


def _is_int(value) -> bool:
    try:
        int(value)
    except (TypeError, ValueError):
        return False
    return True


def natural_log(c: Column) -> Column:
    """IEEE logarithm: zero gives -inf and negatives NaN, where Spark's ``ln`` gives null."""
    x = c.cast("double")
    return (F.when(x > 0, F.log(x)).when(x == 0, F.lit(float("-inf")))
            .when(x.isNotNull(), F.lit(float("nan"))))


def ieee_divide(a: Column, b: Column) -> Column:
    """Double division with inf/NaN for a zero divisor instead of an ANSI error."""
    x, y = a.cast("double"), b.cast("double")
    over_zero = (F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf")))
                 .when(x.isNotNull(), F.lit(float("nan"))))
    return F.when(y == 0, over_zero).otherwise(F.try_divide(x, y))


def stretch(value: float | None) -> float | None:
    """Python float for a fitted statistic; NaN stays NaN, None stays None."""
    return None if value is None else float(value)


def is_bad(value) -> bool:
    return value is None or (isinstance(value, float) and math.isnan(value))
