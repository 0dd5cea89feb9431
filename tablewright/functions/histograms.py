"""Equal-width histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .columns import col


def edges(low: float, high: float, bins: int) -> list[float]:
    """Bin edges over [low, high]; a single value gets half a unit on either side."""
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    return [low + i * width for i in range(bins)] + [high]


def bin_number(x: Column, cuts: list[float]) -> Column:
    """As ``bin_of``, from the edges."""
    return bin_of(x, cuts[0], cuts[-1], len(cuts) - 1)


def bin_of(x: Column, low: float, high: float, bins: int) -> Column:
    """Zero-based bin of a value inside the edges: closed on the left, the last bin on both sides; none for null and NaN.

    Found by division, then put right by one if rounding crossed an edge.
    """
    width = (high - low) / bins
    guess = F.least(F.floor((x - F.lit(low)) / F.lit((high - low)) * bins), F.lit(bins - 1)).cast("int" if bins < 2**31 else "long")
    left = F.lit(low) + guess * F.lit(width)
    right = F.lit(low) + (guess + 1) * F.lit(width)
    moved = F.when(x < left, guess - 1).when((x >= right) & (guess < bins - 1), guess + 1).otherwise(guess)
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(moved, F.lit(0)))


def bin_table(df: DataFrame, shapes: dict[str, tuple[float, float, int]]) -> DataFrame:
    """``(column, bin, bin_from, bin_to, count)`` of every bin of columns with ``(lowest, highest, bins)``, empty bins included.

    Only occupied bins are counted; all are made in Spark, so their number costs the driver nothing.
    """
    spark = df.sparkSession
    known = {c: ((low - 0.5, high + 0.5) if low == high else (low, high), bins) for c, (low, high, bins) in shapes.items()}
    shape = spark.createDataFrame([(c, e[0], e[1], n) for c, (e, n) in known.items()], "column string, low double, high double, bins long")
    stretch = 1 << 16
    parts = shape.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1, F.lit(stretch).cast("long"))))
    every = parts.withColumn("bin", F.explode(F.sequence("first", F.least(F.col("first") + stretch - 1, F.col("bins") - 1))))
    tags = [F.struct(F.lit(c).alias("column"), bin_of(col(c).cast("double"), *e, n).cast("long").alias("bin")) for c, (e, n) in known.items()]
    counted = df.select(F.inline(F.array(*tags))).filter(F.col("bin").isNotNull()).groupBy("column", "bin").agg(F.count("*").alias("count")) if tags else \
        spark.createDataFrame([], "column string, bin long, count long")
    width = (F.col("high") - F.col("low")) / F.col("bins")
    to = F.when(F.col("bin") == F.col("bins") - 1, F.col("high")).otherwise(F.col("low") + (F.col("bin") + 1) * width)
    return every.join(counted, ["column", "bin"], "left").select(
        "column", F.col("bin").cast("int").alias("bin"), (F.col("low") + F.col("bin") * width).alias("bin_from"), to.alias("bin_to"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def bin_counts(df: DataFrame, cuts: dict[str, list[float]]) -> dict[tuple[str, int], int]:
    """Rows per (column, bin) for all columns in one pass; only bin totals leave the tasks."""
    if not cuts:
        return {}
    tags = [F.struct(F.lit(c).alias("column"), bin_number(col(c).cast("double"), e).alias("bin"))
            for c, e in cuts.items()]
    rows = (df.select(F.inline(F.array(*tags))).filter(F.col("bin").isNotNull())
            .groupBy("column", "bin").count().collect())
    return {(r["column"], r["bin"]): r["count"] for r in rows}
