"""Joining a table to a dictionary with one row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .columns import col

#: a side is broadcast when it is counted to take at most so many bytes
BROADCAST_BYTES = 8 << 20
FIXED = 16  # bytes counted for a value of fixed width, with its place in a row


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes; values of varying width are measured by their text."""
    total = F.lit(FIXED)
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            total = total + FIXED + F.coalesce(F.octet_length(col(f.name)), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            total = total + FIXED + F.coalesce(F.octet_length(F.to_json(F.struct(col(f.name)))), F.lit(0))
        else:
            total = total + FIXED
    return total.cast("bigint")


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether all rows together take at most ``limit`` bytes: one sum, of which a task hands on a number."""
    return (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when the table is measured to be small; otherwise leave the join to Spark."""
    return F.broadcast(df) if is_small(df, limit) else df


def attach(df: DataFrame, dictionary: DataFrame, key: str) -> DataFrame:
    """Left join ``dictionary(key, ...)``, unique in ``key``.

    A dictionary measured to be small is broadcast. A larger one takes a plain join, of
    which Spark splits the partitions of hot keys; rows without a key stay out of it.
    """
    if is_small(dictionary):
        return df.join(F.broadcast(dictionary), key, "left")
    known = df.filter(col(key).isNotNull()).join(dictionary, key, "left")
    new = [f for f in dictionary.schema.fields if f.name != key]
    blank = df.filter(col(key).isNull()).select(*[col(c) for c in df.columns], *[F.lit(None).cast(f.dataType).alias(f.name) for f in new])
    return known.unionByName(blank)
