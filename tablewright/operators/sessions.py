"""Sessions of a whole table: rows of a key that follow one another within a gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import col, spare_names
from ..functions.ordering import BUCKET, KEY, bucketed


def numbered_sessions(df: DataFrame, time: str, gap: Column, by, name: str = "session") -> DataFrame:
    """The rows with a time and all keys, and ``name``: the number of their session, ascending by keys and time.

    A session begins where the row before of the same keys lies farther back than ``gap``. Rows are put in one order
    of keys and time and cut into ranges of it, so a key with many rows fills several; the time before and the number
    of sessions begun are carried from range to range.
    """
    keys = [by] if isinstance(by, str) else list(by or [])
    known = df
    for k in [*keys, time]:
        known = known.filter(col(k).isNotNull())
    ordered = bucketed(known, [*keys, time])
    here, first, last, begins, offset = spare_names(df, "here", "first", "last", "begins", "offset")
    at = F.struct(*[col(c).alias(f"k{i}") for i, c in enumerate([*keys, time])])
    along = Window.orderBy(BUCKET)
    # the row before in the order: the one before in the range, or the last one of the range before (a row per range)
    edges = ordered.df.groupBy(BUCKET).agg(F.max_by(at, KEY).alias(last)).select(BUCKET, F.lag(last).over(along).alias(last))
    rows = ordered.df.withColumns({here: F.lag(at).over(ordered.window()), first: F.row_number().over(ordered.window()) == 1}).join(F.broadcast(edges), BUCKET)
    previous = F.when(F.col(first), F.col(last)).otherwise(F.col(here))
    same = previous.isNotNull()
    for i, k in enumerate(keys):
        same = same & (previous[f"k{i}"] == col(k))
    goes_on = F.coalesce(same & (col(time) <= previous[f"k{len(keys)}"] + gap), F.lit(False))
    rows = rows.withColumn(begins, (~goes_on).cast("long"))
    counts = rows.groupBy(BUCKET).agg(F.sum(begins).alias("n"))
    offsets = counts.select(BUCKET, (F.sum("n").over(along) - F.col("n")).alias(offset))
    running = F.sum(begins).over(ordered.window().rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(F.broadcast(offsets), BUCKET).select(*[col(c) for c in df.columns], (F.col(offset) + running).alias(name))


def sessions(df: DataFrame, time: str, gap: Column, aggregates: dict[str, Column], by) -> DataFrame:
    """Aggregates per session: ``session_start``, ``last_seen``, the keys and the aggregates. See ``numbered_sessions``."""
    keys = [by] if isinstance(by, str) else list(by or [])
    number, = spare_names(df, "session")
    found = numbered_sessions(df, time, gap, keys, number).groupBy(number).agg(
        F.min(col(time)).alias("session_start"), F.max(col(time)).alias("last_seen"), *[F.first(col(k)).alias(k) for k in keys],
        *[a.alias(n) for n, a in aggregates.items()])
    return found.drop(number)
