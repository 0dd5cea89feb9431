"""Streams: the events arrive in slices of time, are aggregated with state, and what was handed on is the result."""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.checkpoints import checkpoint_folder
from ..operators.sessions import sessions
from ..streaming import distinct_rows, session_aggregates, window_aggregates, write_stream
from .base import query, rounded, table

SLICES, FILES = 4, 4


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, removed when the driver's file system closes."""
    checkpoint_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def arriving(df: DataFrame, time: str) -> DataFrame:
    """The table as a stream of files, one slice of time after the other."""
    spark = df.sparkSession
    path = _folder(spark, "arriving")
    low, high = df.agg(F.min(time), F.max(time)).first()
    for k in range(SLICES):
        begin, end = (low + (high - low) * x / SLICES for x in (k, k + 1))
        slice_ = df.where((F.col(time) >= F.lit(begin)) & ((F.col(time) < F.lit(end)) if k + 1 < SLICES else F.lit(True)))
        slice_.repartition(FILES).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", FILES).parquet(path)


def finished(stream: DataFrame) -> DataFrame:
    """What the stream hands on until its input ends."""
    spark = stream.sparkSession
    out = _folder(spark, "handed-on")
    write_stream(stream, out, _folder(spark, "progress")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("stream_windows", """
WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total
           FROM events GROUP BY ALL)
SELECT window_start, window_start + INTERVAL 6 HOUR AS window_end, event_type, n, total FROM w
WHERE window_start + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def _windows(spark, sf_dir):
    stream = arriving(table(spark, sf_dir, "events"), "ts")
    return rounded(finished(window_aggregates(stream, "ts", "6 hours", {"n": F.count("*"), "total": F.sum("value")}, "event_type", wait="1 hour")), 4)


@query("stream_sliding_windows", """
WITH s AS (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 6 HOUR AS window_start FROM events, range(4) AS r(k)),
w AS (SELECT window_start, count(*) AS n, max(value) AS most, count(DISTINCT user_id) > 0 AS used FROM s GROUP BY window_start)
SELECT window_start, window_start + INTERVAL 24 HOUR AS window_end, n, most FROM w
WHERE window_start + INTERVAL 24 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def _sliding(spark, sf_dir):
    stream = arriving(table(spark, sf_dir, "events"), "ts")
    return finished(window_aggregates(stream, "ts", "24 hours", {"n": F.count("*"), "most": F.max("value")}, slide="6 hours", wait="1 hour"))


_SESSIONS = """
WITH e AS (SELECT user_id, ts, value, ts > lag(ts) OVER w + INTERVAL 90 MINUTE OR lag(ts) OVER w IS NULL AS begins FROM events
           WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(CAST(begins AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS number FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) AS last_seen, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, number"""


@query("sessions_of_users", _SESSIONS)
def _sessions(spark, sf_dir):
    found = sessions(table(spark, sf_dir, "events"), "ts", F.expr("INTERVAL '90' MINUTE"), {"n": F.count("*"), "total": F.sum("value")}, "user_id")
    return rounded(found, 4)


@query("stream_sessions", f"SELECT * FROM ({_SESSIONS}) WHERE last_seen + INTERVAL 90 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def _stream_sessions(spark, sf_dir):
    stream = arriving(table(spark, sf_dir, "events"), "ts")
    return rounded(finished(session_aggregates(stream, "ts", "90 minutes", {"n": F.count("*"), "total": F.sum("value")}, "user_id", "1 hour")), 4)


@query("stream_without_repeats", "SELECT event_id, user_id, event_type FROM events")
def _without_repeats(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    # every third event comes twice more, up to three hours later
    again = events.where("event_id % 3 = 0").withColumn("ts", F.col("ts") + F.expr("make_dt_interval(0, event_id % 4, 1, 0)"))
    stream = arriving(events.unionByName(again).unionByName(again), "ts")
    return finished(distinct_rows(stream, "event_id", "ts", "4 hours").select("event_id", "user_id", "event_type"))
