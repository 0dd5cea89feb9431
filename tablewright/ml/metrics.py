"""How good predictions are."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import col
from .neighbors import BLOCK, euclidean

SEED = 42
#: rows of a block that a task compares with another block
BLOCK_ROWS = 4_000
#: blocks of a table before they grow to five times as many rows
LEAST_BLOCKS = 16


def regression_metrics(predictions: DataFrame, label: str = "label", prediction: str = "prediction", prefix: str = "") -> DataFrame:
    """mae, mse, rmse and r2 from one aggregate."""
    y, error = col(label).cast("double"), col(label) - col(prediction)
    sums = predictions.agg(F.avg(F.abs(error)).alias("mae"), F.avg(error * error).alias("mse"), F.var_pop(y).alias("var"))
    perfect = F.when(F.col("mse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    r2 = F.when(F.col("var") == 0, perfect).otherwise(1 - F.try_divide(F.col("mse"), F.col("var")))
    return sums.select(F.col("mae").alias(f"{prefix}mae"), F.col("mse").alias(f"{prefix}mse"),
                       F.sqrt("mse").alias(f"{prefix}rmse"), r2.alias(f"{prefix}r2"))


def confusion_matrix(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Counts per (actual, predicted), all label pairs present, in label order: the result has the square of the labels."""
    cells = predictions.groupBy(col(label).cast("double").alias("actual"), col(prediction).cast("double").alias("predicted")).count()
    names = cells.select(F.explode(F.array("actual", "predicted")).alias("name")).distinct()
    listed = names.agg(F.array_sort(F.collect_set("name")).alias("names"))
    pairs = listed.select(F.explode("names").alias("actual"), "names").select("actual", F.explode("names").alias("predicted"))
    found = pairs.join(cells, ["actual", "predicted"], "left")
    return found.select("actual", "predicted", F.coalesce("count", F.lit(0)).cast("bigint").alias("count")).orderBy("actual", "predicted")


def classification_metrics(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1; an undefined part counts as zero."""
    cells = predictions.groupBy(col(label).cast("double").alias("a"), col(prediction).cast("double").alias("p")).count()
    sides = cells.select(F.inline(F.array(
        F.struct(F.col("a").alias("c"), F.col("count").alias("actual"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("a") == F.col("p"), F.col("count")).otherwise(0).alias("right")),
        F.struct(F.col("p").alias("c"), F.lit(0).cast("bigint").alias("actual"), F.col("count").alias("predicted"),
                 F.lit(0).cast("bigint").alias("right")))))
    per = sides.groupBy("c").agg(*[F.sum(n).alias(n) for n in ("actual", "predicted", "right")])
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(F.col("right"), F.col("predicted")), zero)
    recall = F.coalesce(F.try_divide(F.col("right"), F.col("actual")), zero)
    f1 = F.coalesce(F.try_divide(2 * F.col("right"), F.col("predicted") + F.col("actual")), zero)
    total = F.sum("actual")
    return per.agg((F.sum("right") / total).alias("accuracy"), (F.sum(precision * F.col("actual")) / total).alias("precision"),
                   (F.sum(recall * F.col("actual")) / total).alias("recall"), (F.sum(f1 * F.col("actual")) / total).alias("f1"))


def silhouette(points: DataFrame) -> float | None:
    """Mean silhouette of all ``points(id, x, prediction)`` in squared Euclidean distance.

    A row's mean squared distance to a cluster follows from the cluster's size, sum and
    sum of squares, so one aggregate and one pass do; the centres are one row per cluster.
    """
    norm = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    wide = points.select("prediction", F.col("x").cast("array<double>").alias("x"))
    sums = (wide.select("prediction", norm.alias("sq"), F.posexplode("x").alias("at", "v"))
            .groupBy("prediction", "at").agg(F.sum("v").alias("s"), F.count("*").alias("n"), F.sum("sq").alias("q"))
            .groupBy("prediction").agg(F.array_sort(F.collect_list(F.struct("at", "s"))).alias("sums"), F.max("n").alias("n"),
                                       F.max(F.when(F.col("at") == 0, F.col("q"))).alias("q")).collect())
    total = sum(r["n"] for r in sums)
    if len(sums) < 2 or len(sums) >= total:
        return None
    scored = wide.withColumn("__sq", norm)
    own, others = F.lit(None).cast("double"), []
    single = F.lit(False)
    for r in sums:
        centre = F.array(*[F.lit(float(c["s"])) for c in r["sums"]])
        dot = F.aggregate(F.zip_with("x", centre, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        whole = F.col("__sq") * F.lit(r["n"]) - 2 * dot + F.lit(float(r["q"]))  # summed squared distances to the cluster
        mine = F.col("prediction") == F.lit(r["prediction"])
        own = F.when(mine, whole / F.lit(max(1, r["n"] - 1))).otherwise(own)
        others.append(F.when(~mine, whole / F.lit(r["n"])))
        single = single | (mine & F.lit(r["n"] == 1))
    near = F.least(*others)
    scale = F.greatest(own, near)
    score = F.when(single | (scale <= 0), 0.0).otherwise((near - own) / scale)
    return scored.select(score.alias("s")).agg(F.avg("s")).first()[0]


def sampled_silhouette(points: DataFrame, rows: int, seed: int = SEED) -> float | None:
    """Mean Euclidean silhouette of ``points(id, x, prediction)``, on a seeded sample of ``rows`` if there are more.

    Every row is compared with every row of the sample, which each task holds: the caller bounds it.
    """
    sample = points.select("id", "x", "prediction").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(rows)
    held = sample.select("x", "prediction").collect()
    labels = np.array([r["prediction"] for r in held])
    names, sizes = np.unique(labels, return_counts=True)
    if len(names) < 2 or len(names) >= len(held):
        return None
    x = np.array([r["x"] for r in held], dtype="float64")
    member = (labels[:, None] == names[None, :]).astype("float64")

    def score(batches):
        for b in batches:
            s = []
            for row, label in zip(b["x"], b["prediction"]):
                sums = np.sqrt(((x - np.asarray(row)) ** 2).sum(axis=1)) @ member
                own = int(np.searchsorted(names, label))
                if sizes[own] == 1:
                    s.append(0.0)
                    continue
                a = sums[own] / (sizes[own] - 1)
                others = np.delete(sums / sizes, own).min()
                s.append((others - a) / max(a, others) if max(a, others) > 0 else 0.0)
            yield pd.DataFrame({"s": s})

    scored = sample.repartition(points.sparkSession.sparkContext.defaultParallelism, "id").mapInPandas(score, "s double")
    return scored.agg(F.avg("s")).first()[0]


def euclidean_silhouette(points: DataFrame, block_rows: int = BLOCK_ROWS) -> float | None:
    """Mean silhouette of all ``points(id, x, prediction)`` in plain Euclidean distance.

    Every row is compared with every row: blocks of about ``block_rows`` distinct points meet in tasks, which hand on one sum
    per row and cluster. Equal points of one cluster are compared once and counted as often as they occur.
    """
    keys = [F.xxhash64(F.lit(k), "x", "prediction").alias(f"k{k}") for k in (1, 2)]
    distinct = (points.select(F.col("x").cast("array<double>").alias("x"), "prediction").groupBy("x", "prediction")
                .agg(F.count(F.lit(1)).alias("w")).select("x", "prediction", "w", *keys))
    size = distinct.agg(F.count(F.lit(1)), F.sum("w"), F.count_distinct("prediction")).first()
    if size[2] < 2 or size[2] >= size[1]:
        return None
    # a row is copied once per block, so large tables have larger blocks and no more than keep all tasks busy
    blocks = min(math.ceil(size[0] / block_rows), max(LEAST_BLOCKS, math.ceil(size[0] / (5 * block_rows))))
    numbers, own = F.sequence(F.lit(0), F.lit(blocks - 1)), F.pmod("k1", F.lit(blocks)).cast("int")
    left = distinct.select("k1", "k2", "x", own.alias("a"), F.explode(numbers).alias("b"))
    right = distinct.select("x", "prediction", "w", own.alias("b"), F.explode(numbers).alias("a"))

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"k1": [], "k2": [], "cluster": [], "s": []})
        names, at = np.unique(b["prediction"].to_numpy(), return_inverse=True)
        order = np.argsort(at, kind="stable")
        starts = np.searchsorted(at[order], np.arange(len(names)))
        x, y = (np.array(v.tolist(), dtype="float64") for v in (a["x"], b["x"].iloc[order]))
        weights = b["w"].to_numpy(dtype="float64")[order]
        s = np.concatenate([np.add.reduceat(euclidean(x[i:i + BLOCK], y) * weights, starts, axis=1) for i in range(0, len(x), BLOCK)])
        return pd.DataFrame({"k1": np.repeat(a["k1"].to_numpy(), len(names)), "k2": np.repeat(a["k2"].to_numpy(), len(names)),
                             "cluster": np.tile(names, len(x)), "s": s.ravel()})

    kind = dict(points.dtypes)["prediction"]
    parts = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(sums, f"k1 long, k2 long, cluster {kind}, s double")
    sizes = distinct.groupBy(F.col("prediction").alias("cluster")).agg(F.sum("w").alias("n"))
    total = parts.groupBy("k1", "k2", "cluster").agg(F.sum("s").alias("s")).join(sizes, "cluster")
    mine = F.col("cluster") == F.col("prediction")
    rows = (total.join(distinct.select("k1", "k2", "prediction", "w"), ["k1", "k2"]).groupBy("k1", "k2").agg(
        F.max("w").alias("w"), F.max(F.when(mine, F.col("n"))).alias("n"),
        F.max(F.when(mine, F.try_divide(F.col("s"), F.col("n") - 1))).alias("inner"),
        F.min(F.when(~mine, F.col("s") / F.col("n"))).alias("near")))
    scale = F.greatest("inner", "near")
    score = F.when((F.col("n") == 1) | (scale <= 0), 0.0).otherwise((F.col("near") - F.col("inner")) / scale)
    return rows.agg(F.sum(score * F.col("w")) / F.sum("w")).first()[0]


def clustering_metrics(points: DataFrame, inertia: float | None = None, sample: int | None = None,
                       euclidean: bool = False) -> DataFrame:
    """Clusters without noise, inertia if known, and the silhouette of ``points(id, x, prediction)``.

    The silhouette is that of all rows, in squared distances or with ``euclidean`` in plain ones, which compares all
    pairs of rows; ``sample`` asks for plain distances within a sample.
    """
    clusters = points.filter(F.col("prediction") >= 0).select("prediction").distinct().count()
    if sample is not None:
        score = sampled_silhouette(points, sample)
    else:
        score = euclidean_silhouette(points) if euclidean else silhouette(points)
    return points.sparkSession.createDataFrame([(clusters, inertia, score)], "clusters bigint, inertia double, silhouette double")
