"""Categories to numbers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import as_text, col, data_type, named_columns
from ..functions.checkpoints import settled
from ..functions.lookup import attach, row_bytes
from ..functions.ordering import INDEX, bucketed, with_row_index
from ..functions.values import sorted_values
from ..plans.registry import row_step, table_step

# categories that are written into the plan: so many, and so many bytes
INLINE_CATEGORIES, INLINE_BYTES = 200, 16_384
CODE = "__code"


def _categories(df: DataFrame, params: dict) -> dict[str, list]:
    if df.isEmpty():
        return {}
    return {c: sorted_values(df, c) for c in named_columns(df, params)}


@table_step("one_hot_encode", fit=_categories, streams=True)
def one_hot_encode(df: DataFrame, params: dict, categories: dict[str, list]) -> DataFrame:
    """A 0/1 column per value after the first in sorted order; the source goes, null gives nulls."""
    if not categories:
        return df
    kept = [col(c) for c in df.columns if c not in categories]
    flags = [(col(c) == F.lit(v)).cast("int").alias(f"{c}_{v}")
             for c, values in categories.items() for v in values[1:]]
    names = [c for c in df.columns if c not in categories] + [f"{c}_{v}" for c, values in categories.items() for v in values[1:]]
    twice = sorted({n for n in names if names.count(n) > 1}) if len(set(names)) < len(names) else []
    if twice:
        raise ValueError(f"one_hot_encode would make the columns {twice} twice; rename the existing ones first")
    return df.select(*kept, *flags)


@dataclass
class Codes:
    """Sorted categories with their codes: inline when few, otherwise a table."""
    count: int
    values: list | None = None
    table: DataFrame | None = None


def category_codes(df: DataFrame, params: dict) -> Codes | None:
    name = params.get("column")
    if name not in df.columns:
        return None
    distinct = df.filter(col(name).isNotNull()).select(col(name)).distinct()
    few = distinct.limit(INLINE_CATEGORIES + 1)
    size = few.agg(F.count(F.lit(1)), F.sum(row_bytes(few))).first()
    if size[0] <= INLINE_CATEGORIES and (size[1] or 0) <= INLINE_BYTES:
        values = distinct.orderBy(col(name)).collect()
        return Codes(len(values), values=[r[0] for r in values])
    # written once: ranking reads the values several times, and so would every use of the codes
    distinct = settled(distinct)
    ranked = with_row_index(bucketed(distinct, name))
    table = settled(ranked.select(col(name), F.col(INDEX).cast("int").alias(CODE)))
    return Codes(distinct.count(), table=table)


def with_code(df: DataFrame, name: str, codes: Codes) -> DataFrame:
    """Add the code of the column's value as ``CODE``."""
    if codes.values is None:
        return attach(df, codes.table, name)
    return df.withColumn(CODE, _inline_code(df, name, codes.values))


def _inline_code(df: DataFrame, name: str, values: list) -> Column:
    if not values:
        return F.lit(None).cast("int")
    known = F.array(*[F.lit(v).cast(data_type(df, name)) for v in values])
    return (F.nullif(F.array_position(known, col(name)), F.lit(0)) - 1).cast("int")


@table_step("label_encode", fit=category_codes, streams=True)
def label_encode(df: DataFrame, params: dict, codes: Codes | None) -> DataFrame:
    """Codes 0, 1, ... in sorted order of the values; null stays null."""
    if codes is None:
        return df
    name = params["column"]
    coded = with_code(df, name, codes)
    return coded.select(*[F.col(CODE).alias(c) if c == name else col(c) for c in df.columns])


@row_step("ordinal_encode")
def ordinal_encode(df: DataFrame, params: dict) -> DataFrame:
    """Position in a comma-separated list; anything else, null included, is -1."""
    name = params.get("column")
    ranks = [w.strip() for w in str(params.get("order") or "").split(",") if w.strip()]
    if name not in df.columns or not ranks:
        return df
    listed = F.array(*[F.lit(w) for w in ranks])
    place = F.coalesce(F.array_position(listed, as_text(df, name)), F.lit(0)) - 1
    return df.withColumn(name, place.cast("int"))


@table_step("binary_encode", fit=category_codes, streams=True)
def binary_encode(df: DataFrame, params: dict, codes: Codes | None) -> DataFrame:
    """The label code as bit columns, lowest bit first, in place of the source.

    With a single category there is nothing to tell apart: the source stays and a
    constant zero bit is added.
    """
    if codes is None:
        return df
    name = params["column"]
    if codes.count <= 1:
        return df.withColumn(f"{name}_bin_0", F.lit(0))
    coded = with_code(df, name, codes)
    bits = [F.shiftright(F.col(CODE), i).bitwiseAND(F.lit(1)).cast("bigint").alias(f"{name}_bin_{i}")
            for i in range((codes.count - 1).bit_length())]
    return coded.select(*[col(c) for c in df.columns if c != name], *bits)
