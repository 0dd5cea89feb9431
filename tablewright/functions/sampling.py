"""Seeded samples of exact size, chosen by hash so partitioning does not matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .columns import col
from .quantiles import values_at_ranks

HASH = "__sample_hash"


def row_hash(df: DataFrame, seed: int, key: list[str] | None = None) -> Column:
    return F.xxhash64(F.lit(seed), *[col(c) for c in (key or df.columns)])


def split_exactly(df: DataFrame, wanted: int, seed: int, rows: int,
                  key: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The ``wanted`` rows with the smallest hashes, and the others.

    The cut-off is an order statistic of the hashes, so a large part is a filter and
    not a sort. ``key`` may name columns that identify a row; rows it leaves tied with the
    cut-off are told apart by all their columns. What is still tied are copies of each
    other, of which each part gets a number.
    """
    if wanted <= 0:
        return df.limit(0), df
    if wanted >= rows:
        return df, df.limit(0)
    hashed = df.withColumn(HASH, row_hash(df, seed, key))
    h = F.col(HASH)
    cutoff = values_at_ranks(hashed, [(h, rows, wanted - 1)])[0]
    sizes = hashed.agg(F.count_if(h < cutoff).alias("below"), F.count_if(h == cutoff).alias("tied")).first()
    taken = wanted - sizes["below"]
    if taken == sizes["tied"]:
        return hashed.filter(h <= cutoff).drop(HASH), hashed.filter(h > cutoff).drop(HASH)
    tied = hashed.filter(h == cutoff).drop(HASH)
    if key:
        mine, others = split_exactly(tied, taken, seed, sizes["tied"])
    else:
        mine, others = tied.limit(taken), tied.limit(sizes["tied"] - taken)
    return (hashed.filter(h < cutoff).drop(HASH).unionByName(mine),
            hashed.filter(h > cutoff).drop(HASH).unionByName(others))


def sample_exactly(df: DataFrame, wanted: int, seed: int, rows: int, key: list[str] | None = None) -> DataFrame:
    """The ``wanted`` rows with the smallest hashes."""
    return split_exactly(df, wanted, seed, rows, key)[0]
