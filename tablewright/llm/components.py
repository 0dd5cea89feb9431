"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import stored


def _minima(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _round(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node to its smallest one, then every smaller neighbour to the smallest.

    Only minima meet in a group; a hub's edges pass through a plain join, which Spark may split.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = (both.where("v > u").join(_minima(both), "u")
             .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
    least = _minima(large)
    small = (large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node that is not itself the smallest of its component.

    Edges with a null end and loops are left out. Each round is written to the shared folder; the loop ends when a
    round changes no edge.
    """
    now = stored(edges.where(f"{a} != {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
                 "edges")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen, now = state, stored(_round(now), "edges")
