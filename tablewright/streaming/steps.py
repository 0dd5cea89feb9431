"""Row-wise steps on a stream, and fitted steps with statistics taken from a batch beforehand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans import FittedSteps, apply_steps


def stream_steps(stream: DataFrame, steps: list[dict] | FittedSteps) -> DataFrame:
    """Apply steps to a stream.

    A plain list may hold only steps that work row by row. ``fit_steps(batch, steps)``
    gives fitted ones, which then scale, fill, encode or flag the stream with the
    batch's statistics. Steps over the whole table or its order are refused.
    """
    if not stream.isStreaming:
        raise ValueError("this table is not a stream; use apply_steps")
    return steps.transform(stream) if isinstance(steps, FittedSteps) else apply_steps(stream, steps)


def write_stream(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append the stream to Parquet files; the checkpoint folder makes each row arrive exactly once."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(path)
