"""Event-time aggregates, sessions and de-duplication on streams, with state that a watermark bounds.

A watermark needs times with a zone; times without one are read in the session's zone and handed on without it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from ..functions.columns import col, spare_names

#: keys over which late rows are looked for; a stream without keys of its own is spread over them
SPREAD = 64


def _checked(stream: DataFrame, time: str) -> None:
    if not stream.isStreaming:
        raise ValueError("this table is not a stream")
    if time not in stream.columns:
        raise ValueError(f"no column {time!r}")


def _marked(stream: DataFrame, time: str, wait: str) -> DataFrame:
    return stream.withColumn(time, col(time).cast("timestamp")).withWatermark(time, wait)


def _as_before(stream: DataFrame, time: str, shown: Column) -> Column:
    return shown.cast(stream.schema[time].dataType)


def _names(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by or [])


def window_aggregates(stream: DataFrame, time: str, size: str, aggregates: dict[str, Column], by=(), slide: str | None = None,
                      wait: str = "10 minutes") -> DataFrame:
    """Aggregates per window of event time and keys ``by``: ``window_start, window_end``, the keys and the aggregates.

    Windows are ``size`` long and begin every ``slide`` (by default one after another); a row is in every window that
    covers it. A window is handed on once, when the watermark, ``wait`` behind the latest time seen, has passed its
    end; its state is then dropped. Rows behind the watermark are left out of windows that are gone; ``late_rows``
    shows them. Rows without a time are in no window, null keys are keys. For append mode.
    """
    _checked(stream, time)
    window = F.window(col(time), size, slide) if slide else F.window(col(time), size)
    grouped = _marked(stream, time, wait).groupBy(window.alias("window"), *[col(k) for k in _names(by)])
    found = grouped.agg(*[a.alias(n) for n, a in aggregates.items()])
    ends = [_as_before(stream, time, F.col(f"window.{x}")).alias(f"window_{x}") for x in ("start", "end")]
    return found.select(*ends, *[col(c) for c in found.columns if c != "window"])


def session_aggregates(stream: DataFrame, time: str, gap, aggregates: dict[str, Column], by, wait: str = "10 minutes") -> DataFrame:
    """Aggregates per session of the keys ``by``: ``session_start``, ``last_seen``, the keys and the aggregates.

    A session goes on while the next row of its keys comes within ``gap`` (text, or a column for a gap per row); rows
    that come out of order join sessions they lie between. It is handed on once, when the watermark has passed its end
    plus the gap, and its state is dropped then. Rows without a time or key are in no session. For append mode.
    """
    _checked(stream, time)
    keys = _names(by)
    if not keys:
        raise ValueError("sessions need keys")
    known = _marked(stream, time, wait)
    for k in keys:
        known = known.filter(col(k).isNotNull())
    seen = "__last_seen"
    grouped = known.groupBy(F.session_window(col(time), gap).alias("session"), *[col(k) for k in keys])
    found = grouped.agg(F.max(col(time)).alias(seen), *[a.alias(n) for n, a in aggregates.items()])
    ends = [_as_before(stream, time, c).alias(n) for c, n in ((F.col("session.start"), "session_start"), (F.col(seen), "last_seen"))]
    return found.select(*ends, *[col(c) for c in [*keys, *aggregates]])


def distinct_rows(stream: DataFrame, keys, time: str, wait: str = "10 minutes") -> DataFrame:
    """The first row of each key; repeats that come while the watermark is within ``wait`` of it are left out.

    A key's state is dropped when the watermark has passed its time plus ``wait``: state holds the keys of that
    stretch, not all keys. A repeat whose time is farther away than ``wait`` is a new row. Null keys are keys.
    """
    _checked(stream, time)
    once = _marked(stream, time, wait).dropDuplicatesWithinWatermark(_names(keys))
    return once.withColumn(time, _as_before(stream, time, col(time)))


def late_rows(stream: DataFrame, time: str, wait: str = "10 minutes") -> DataFrame:
    """The rows that come behind the watermark, with ``behind`` in seconds: what the aggregates leave out.

    A stream of its own with the same watermark; it keeps no state. Rows without a time are never late.
    """
    _checked(stream, time)
    import pandas as pd
    columns = stream.columns
    marked = _marked(stream.filter(col(time).isNotNull()), time, wait)
    shape = StructType([*marked.schema.fields]).add("behind", "double")

    def late(key, batches, state):
        mark = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        for rows in batches:
            at = rows[time]
            at = at if at.dt.tz is None else at.dt.tz_convert("UTC").dt.tz_localize(None)
            behind = (mark - at).dt.total_seconds()
            yield rows.assign(behind=behind)[behind > 0][[*columns, "behind"]]
    part, = spare_names(stream, "part")
    spread = marked.withColumn(part, F.pmod(F.xxhash64(*[col(c) for c in columns]), F.lit(SPREAD)))
    found = spread.groupBy(part).applyInPandasWithState(late, shape, "nothing boolean", "append", "NoTimeout")
    return found.withColumn(time, _as_before(stream, time, col(time)))
