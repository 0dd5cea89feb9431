"""Frequent and distinct values of a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .columns import col


def value_counts(df: DataFrame, name: str) -> DataFrame:
    """One row per value (null included) with its count; counts combine before the shuffle."""
    return df.groupBy(col(name).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def top_values(df: DataFrame, name: str, k: int) -> DataFrame:
    """The ``k`` most frequent values; ties go to the smaller value."""
    return value_counts(df, name).orderBy(F.desc("count"), F.asc_nulls_last("value")).limit(k)


def most_frequent(df: DataFrame, name: str):
    """The most frequent non-null value, the lowest on a tie, or ``None``."""
    return most_frequent_of(df, [name])[name]


def most_frequent_of(df: DataFrame, names: list[str]) -> dict:
    """``most_frequent`` of several columns in one pass: values are counted by column and value."""
    if not names:
        return {}
    fields = [F.struct(F.lit(i).alias("i"), *[(col(c) if k == i else F.lit(None).cast(df.schema[c].dataType)).alias(f"v{k}") for k, c in enumerate(names)])
              for i in range(len(names))]
    present = [F.when(col(c).isNotNull(), f) for c, f in zip(names, fields)]
    values = [F.col(f"v{k}") for k in range(len(names))]
    counts = df.select(F.inline(F.array_compact(F.array(*present)))).groupBy("i", *values).agg(F.count("*").alias("n"))
    best = counts.groupBy("i").agg(F.min(F.struct((-F.col("n")).alias("n"), *values)).alias("best")).collect()
    found = {r["i"]: r["best"][f"v{r['i']}"] for r in best}
    return {c: found.get(i) for i, c in enumerate(names)}


def sorted_values(df: DataFrame, name: str) -> list:
    """The distinct non-null values in order, for results that have a column for each of them."""
    found = df.filter(col(name).isNotNull()).select(col(name).alias("value")).distinct().orderBy("value").collect()
    return [r["value"] for r in found]
