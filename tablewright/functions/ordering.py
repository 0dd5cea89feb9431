"""Row order at scale: global row numbers, carried values and rolling frames.

A window without ``PARTITION BY`` sends the whole table to one task. Here the
order key is cut into value ranges ("buckets") from a small sample of keys, so
windows run per bucket in parallel; what a bucket needs from its neighbours (row
offsets, last value seen) comes from a summary with one row per bucket. Up to
``COARSE`` bounds are literals in the plan, whatever the number of rows. Larger tables
cut each of these ranges again, by a table with one row of bounds per range. A
bucket is a pure function of the key, so a recomputed task always gives the same rows. Ties in the caller's key are broken by a row
hash, which also spreads a hot key value over several buckets.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .checkpoints import settled
from .columns import col

ROWS_PER_BUCKET = 1_000_000
MIN_BUCKETS = 8
SAMPLES_PER_BUCKET = 32
#: ranges whose bounds the driver draws and writes into the plan, and ranges each of them is cut into at most
COARSE, FINE = 512, 512
ROLLING_BLOCK = 500_000

KEY, BUCKET, INDEX, CUTS = "__order_key", "__bucket", "__row_index", "__cuts"


@dataclass
class Ordered:
    """A table with its order key and bucket columns attached."""
    df: DataFrame
    columns: list[str]

    def window(self):
        return Window.partitionBy(BUCKET).orderBy(KEY)

    def restore(self, df: DataFrame | None = None) -> DataFrame:
        return (df or self.df).select(*[col(c) for c in self.columns])


def order_columns(order_by) -> list[str]:
    names = [order_by] if isinstance(order_by, str) else list(order_by or [])
    if not names:
        raise ValueError("this step depends on row order: give order_by")
    return names


def order_key(order_by: list[str], tie_break: list[str]) -> Column:
    """A totally ordered struct: the caller's columns (nulls first), then a hash."""
    return F.struct(*[col(c).alias(f"k{i}") for i, c in enumerate(order_by)],
                    F.xxhash64(*[col(c) for c in tie_break]).alias("h"))


def bucketed(df: DataFrame, order_by, tie_break: list[str] | None = None,
             buckets: int | None = None) -> Ordered:
    """Attach the order key and a range bucket that balances rows.

    ``tie_break`` names the columns hashed to order rows with equal keys (all by
    default); naming only the columns that matter keeps the summary scans narrow.
    """
    names = order_columns(order_by)
    keyed = df.withColumn(KEY, order_key(names, tie_break or df.columns))
    rows = df.count()
    wanted = buckets or max(MIN_BUCKETS, math.ceil(rows / ROWS_PER_BUCKET))
    coarse, fine = min(wanted, COARSE), min(FINE, math.ceil(wanted / COARSE))
    bounds = range_bounds(keyed, KEY, coarse, rows)
    numbered = keyed.withColumn(BUCKET, range_bucket(F.col(KEY), bounds))
    if fine > 1:
        cuts = _fine_bounds(numbered, fine, coarse * fine * SAMPLES_PER_BUCKET / max(1, rows))
        # at most COARSE rows with under FINE bounds each
        numbered = numbered.join(F.broadcast(cuts), BUCKET, "left").withColumn(
            BUCKET, F.col(BUCKET) * fine + _reached(F.col(KEY), F.coalesce(F.col(CUTS), F.array().cast(cuts.schema[CUTS].dataType)), fine)).drop(CUTS)
    return Ordered(numbered, df.columns)


def range_bounds(keyed: DataFrame, key: str, buckets: int, rows: int) -> list[str]:
    """SQL literals of the bucket bounds, from a sample of about ``SAMPLES_PER_BUCKET`` struct keys per bucket.

    Rows are drawn where they are read, in proportion to the count already taken; the
    quantiles of their keys are the bounds. Only balance depends on the sample, never results.
    """
    share = buckets * SAMPLES_PER_BUCKET / max(1, rows)
    keys = keyed.select(F.col(key))
    ranked = (keys if share >= 1 else keys.sample(False, share, 7)).orderBy(key).collect()
    step = len(ranked) / buckets
    keys = [ranked[int(i * step)][key] for i in range(1, buckets) if ranked]
    types = [f.dataType for f in keyed.schema[key].dataType.fields]
    texts = ["struct(" + ", ".join(_sql_literal(v, t) for v, t in zip(k, types)) + ")" for k in keys]
    return list(dict.fromkeys(texts))


def _fine_bounds(numbered: DataFrame, fine: int, share: float) -> DataFrame:
    """``(bucket, cuts)``: bounds that part each range into ``fine`` ones, from a sample of its keys, written once."""
    drawn = (numbered if share >= 1 else numbered.sample(False, share, 8)).select(BUCKET, KEY)
    ranked = drawn.groupBy(BUCKET).agg(F.array_sort(F.collect_list(KEY)).alias("drawn"))
    places = F.transform(F.sequence(F.lit(1), F.lit(fine - 1)), lambda i: F.get("drawn", F.floor(i * F.size("drawn") / fine).cast("int")))
    return settled(ranked.select(BUCKET, places.alias(CUTS)))


def _sql_literal(value, dtype: T.DataType) -> str:
    kind = dtype.simpleString()
    if value is None:
        return f"CAST(NULL AS {kind})"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (dt.datetime, dt.date)):
        text = value.isoformat(sep=" ") if isinstance(value, dt.datetime) else value.isoformat()
        return f"CAST('{text}' AS {kind})"
    if isinstance(value, str):
        text = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{text}'"
    if isinstance(value, (int, float, decimal.Decimal)):
        return f"CAST('{value}' AS {kind})"
    raise TypeError(f"cannot order by a column of type {kind}")


def range_bucket(key: Column, bounds: list[str]) -> Column:
    """How many bounds lie at or below the key."""
    if not bounds:
        return F.lit(0)
    return _reached(key, F.expr("array(" + ", ".join(bounds) + ")"), len(bounds) + 1)


def _reached(key: Column, cuts: Column, fewer: int) -> Column:
    """How many of the sorted cuts, fewer than ``fewer``, lie at or below the key, by halving."""
    steps = [1 << i for i in reversed(range((fewer - 1).bit_length()))]

    def advance(found, step):
        ahead = found + step
        fits = (ahead <= F.size(cuts)) & (F.get(cuts, ahead - 1) <= key)
        return F.when(fits, ahead).otherwise(found)

    found = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), advance)
    # always that number; naming the partition keeps Spark 4.1 from inferring filters for the other side of a join on it,
    # which in a new session can miss that the lambda refers to the key, and fail
    return F.when(F.spark_partition_id() >= 0, found).otherwise(F.lit(0))


def _earlier(reverse: bool = False):
    """All buckets before (or after) the current one; the summary has one row per bucket."""
    order = F.desc(BUCKET) if reverse else F.asc(BUCKET)
    return Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def with_row_index(ordered: Ordered, start: int = 0) -> DataFrame:
    """Add the zero-based global position as ``INDEX``, keeping key and bucket."""
    sizes = ordered.df.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("__rows"))
    offsets = sizes.select(BUCKET, F.coalesce(F.sum("__rows").over(_earlier()), F.lit(0)).alias("__offset"))
    numbered = ordered.df.withColumn("__local", F.row_number().over(ordered.window()))
    # one row per bucket
    return (numbered.join(F.broadcast(offsets), BUCKET)
            .withColumn(INDEX, F.col("__offset") + F.col("__local") - 1 + start)
            .drop("__offset", "__local"))


def carried(ordered: Ordered, value: Column, backward: dict[str, bool], df: DataFrame | None = None) -> DataFrame:
    """Add the nearest non-null ``value`` at or before each row, or at or after it where ``backward``.

    ``backward`` maps each new column to its direction; all share one summary of the buckets.
    """
    df = (ordered.df if df is None else df).withColumn("__v", value)
    seen = F.when(F.col("__v").isNotNull(), F.col(KEY))
    picks = {True: F.min_by, False: F.max_by}
    edges = df.groupBy(BUCKET).agg(*[picks[back]("__v", seen).alias(f"__edge{i}") for i, back in enumerate(backward.values())])
    carries = [F.last(f"__edge{i}", ignorenulls=True).over(_earlier(reverse=back)).alias(f"__carry{i}")
               for i, back in enumerate(backward.values())]
    # one row per bucket
    out = df.join(F.broadcast(edges.select(BUCKET, *carries)), BUCKET)
    for i, (name, back) in enumerate(backward.items()):
        # a frame that grows row by row costs one step per row; one that shrinks is rescanned
        order = F.desc(KEY) if back else F.asc(KEY)
        frame = Window.partitionBy(BUCKET).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        near = F.last("__v", ignorenulls=True).over(frame)
        out = out.withColumn(name, F.coalesce(near, F.col(f"__carry{i}")))
    return out.drop("__v", *[f"__carry{i}" for i in range(len(backward))])


def rolling(df: DataFrame, order_by, window: int, aggregates: dict[str, Column],
            tie_break: list[str] | None = None, block: int = ROLLING_BLOCK) -> DataFrame:
    """Aggregates over the current row and the ``window - 1`` rows before it.

    Rows are numbered, cut into blocks of consecutive positions, and the last
    ``window - 1`` rows of a block are also lent to the next one.
    """
    ordered = bucketed(df, order_by, tie_break)
    numbered = with_row_index(ordered).drop(KEY, BUCKET)
    block = max(block, window)
    own = F.floor(F.col(INDEX) / block)
    tail = F.col(INDEX) % block >= block - (window - 1)
    homes = F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))
    spread = numbered.withColumn("__own", own).withColumn("__block", F.explode(homes))
    frame = Window.partitionBy("__block").orderBy(INDEX).rowsBetween(-(window - 1), 0)
    rolled = spread.withColumns({n: a.over(frame) for n, a in aggregates.items()})
    return rolled.filter(F.col("__block") == F.col("__own")).drop("__block", "__own", INDEX)
