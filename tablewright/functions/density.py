"""Gaussian kernel densities on a fixed grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .columns import col
from .lookup import broadcast_if_small

GRID_1D, GRID_2D, REACH = 200, 40, 3.0  # points per curve, cells per side, bandwidths beyond the data
FEW_VALUES = 0.1


def _grid(low, high, points: int):
    return low + (high - low) * F.col("step") / F.lit(points - 1)


def density_curves(df: DataFrame, value: str, keys: list[str] | None = None, points: int = GRID_1D) -> DataFrame:
    """Density of a double column per group: keys, x, density. Bandwidth is ``n^(-1/5) * sd``.

    Group statistics are one aggregate; each row then adds its kernel to the fixed
    grid of its group and sums combine before the shuffle. Repeated values are
    counted first where that shrinks the table much. A group without spread has no curve.
    """
    keys = keys or []
    by = [col(k) for k in keys]
    v = col(value)
    sizes = df.groupBy(*by).agg(F.count(v).alias("n"), F.stddev_samp(v).alias("sd"), F.min(v).alias("low"), F.max(v).alias("high"))
    shape = df.agg(F.count(v).alias("n"), F.approx_count_distinct(F.struct(*by, v)).alias("d")).first()
    weighted = df.select(*by, v.cast("double").alias("v"), F.lit(1).alias("w"))
    if shape["n"] and shape["d"] < FEW_VALUES * shape["n"]:
        weighted = weighted.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("w"))
    stats = sizes.withColumn("bw", F.pow(F.col("n"), F.lit(-0.2)) * F.col("sd")).filter(F.col("bw") > 0)
    stats = stats.select(*by, "n", "bw", (F.col("low") - REACH * F.col("bw")).alias("start"),
                         (F.col("high") + REACH * F.col("bw")).alias("stop"))
    if keys:
        near = weighted.join(broadcast_if_small(stats), keys)
    else:
        row = stats.first()
        if row is None:
            return df.sparkSession.createDataFrame([], "x double, density double")
        near = weighted.withColumns({c: F.lit(row[c]) for c in ("n", "bw", "start", "stop")})
    spread = near.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = _grid(F.col("start"), F.col("stop"), points)
    kernel = F.col("w") * F.exp(-0.5 * F.pow((x - F.col("v")) / F.col("bw"), F.lit(2)))
    summed = spread.filter(F.col("v").isNotNull()).groupBy(*by, "n", "bw", "start", "stop", "step").agg(F.sum(kernel).alias("k"))
    scale = F.col("n") * F.col("bw") * F.sqrt(2 * F.pi())
    return summed.select(*by, x.alias("x"), (F.col("k") / scale).alias("density"))


def density_surface(df: DataFrame, x: str, y: str, cells: int = GRID_2D) -> DataFrame:
    """Joint density (x, y, density) at the centres of a cells-by-cells grid.

    Rows are first counted per cell, so the kernel work does not grow with the
    table. The kernel's covariance is that of the data times ``n^(-1/3)``.
    """
    a, b = col(x).cast("double"), col(y).cast("double")
    pairs = df.select(a.alias("x"), b.alias("y")).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    row = pairs.agg(F.count(F.lit(1)).alias("n"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"),
                    F.covar_samp("x", "y").alias("vxy"), F.min("x").alias("x0"), F.max("x").alias("x1"),
                    F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    shrink = row["n"] ** (-1 / 3) if row["n"] else 0.0
    vx, vy, vxy = ((v or 0.0) * shrink for v in (row["vx"], row["vy"], row["vxy"]))
    det = vx * vy - vxy * vxy
    if det <= 0:
        return df.sparkSession.createDataFrame([], "x double, y double, density double")
    starts, widths = [], []
    for low, high, var in ((row["x0"], row["x1"], vx), (row["y0"], row["y1"], vy)):
        pad = REACH * var ** 0.5
        starts.append(low - pad)
        widths.append((high - low + 2 * pad) / cells)

    def cell(c, axis):
        return F.least(F.floor((c - F.lit(starts[axis])) / F.lit(widths[axis])), F.lit(cells - 1)).cast("int")

    def centre(c, axis):
        return F.lit(starts[axis]) + (c + F.lit(0.5)) * F.lit(widths[axis])

    counted = pairs.groupBy(cell(F.col("x"), 0).alias("i"), cell(F.col("y"), 1).alias("j")).agg(F.count(F.lit(1)).alias("w"))
    targets = F.sequence(F.lit(0), F.lit(cells * cells - 1))
    spread = counted.withColumn("t", F.explode(targets))
    gi, gj = F.floor(F.col("t") / cells).cast("int"), (F.col("t") % cells).cast("int")
    dx, dy = (gi - F.col("i")) * F.lit(widths[0]), (gj - F.col("j")) * F.lit(widths[1])
    form = (dx * dx * F.lit(vy) - 2 * dx * dy * F.lit(vxy) + dy * dy * F.lit(vx)) / F.lit(det)
    summed = spread.groupBy("t").agg(F.sum(F.col("w") * F.exp(-0.5 * form)).alias("k"))
    scale = row["n"] * 2 * 3.141592653589793 * det ** 0.5
    return summed.select(centre(gi, 0).alias("x"), centre(gj, 1).alias("y"), (F.col("k") / F.lit(scale)).alias("density"))
