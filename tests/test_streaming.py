"""Row-wise and pre-fitted steps on a file stream."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from tablewright import apply_steps, fit_steps
from tablewright.functions import ordering
from tablewright.operators.sessions import numbered_sessions, sessions
from tablewright.streaming import distinct_rows, late_rows, session_aggregates, stream_steps, window_aggregates, write_stream


@pytest.fixture
def events(spark, tmp_path):
    batch = spark.read.parquet(f"{SMALL}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return batch, stream


def run(spark, df, tmp_path):
    query = write_stream(df, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out"))


def test_row_wise_steps_give_the_batch_result(spark, events, tmp_path):
    batch, stream = events
    steps = [{"type": "filter_rows", "params": {"column": "value", "operator": ">", "value": "30"}},
             {"type": "uppercase", "params": {"column": "event_type"}},
             {"type": "date_parts", "params": {"column": "ts", "parts": ["dayofweek"]}},
             {"type": "custom_formula", "params": {"formula": "log(value) * 2", "new_name": "f"}}]
    got = run(spark, stream_steps(stream, steps), tmp_path)
    want = apply_steps(batch, steps)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_fitted_steps_use_batch_statistics(spark, events, tmp_path):
    batch, stream = events
    steps = [{"type": "standardize", "params": {"columns": ["value"]}}, {"type": "label_encode", "params": {"column": "event_type"}},
             {"type": "detect_iqr", "params": {"column": "value"}}]
    fitted = fit_steps(batch, steps)
    got = run(spark, stream_steps(stream, fitted), tmp_path)
    want = apply_steps(batch, steps)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_refusals(spark, events):
    batch, stream = events
    with pytest.raises(ValueError, match="fitted"):
        stream_steps(stream, [{"type": "standardize", "params": {"column": "value"}}])
    with pytest.raises(ValueError, match="whole table"):
        stream_steps(stream, [{"type": "sort_column", "params": {"column": "value"}}])
    with pytest.raises(ValueError, match="not a stream"):
        stream_steps(batch, [])


SCHEMA = "id int, user string, at timestamp, v double"


class Feed:
    """A folder that files are put into, one micro-batch after the other, and a stream over it that can be started again."""

    def __init__(self, spark, path):
        self.spark, self.path, self.files = spark, path, 0

    def put(self, rows):
        self.spark.createDataFrame([(i, u, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m) if m is not None else None, v) for i, u, m, v in rows],
                                   SCHEMA).coalesce(1).write.mode("append").parquet(str(self.path / "in"))

    def run(self, make, *batches):
        """Hand over the batches one run at a time, each from the checkpoint of the last; all rows handed on, and the last progress."""
        for rows in batches:
            self.put(rows)
            stream = self.spark.readStream.schema(SCHEMA).parquet(str(self.path / "in"))
            query = write_stream(make(stream), str(self.path / "out"), str(self.path / "check"))
            query.awaitTermination(180)
        return [tuple(r) for r in self.spark.read.parquet(str(self.path / "out")).collect()], query.lastProgress


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path)


def minutes(at):
    return int((at - dt.datetime(2024, 1, 1)).total_seconds() // 60)


def test_windows_and_late_rows(feed, spark, tmp_path):
    def make(s):
        return window_aggregates(s, "at", "30 minutes", {"n": F.count("*"), "t": F.sum("v")}, "user", wait="10 minutes")
    batches = [[(1, "a", 5, 1.0), (2, "a", 25, 2.0), (3, None, 28, 4.0), (9, "a", None, 9.0)], [(4, "a", 20, 8.0), (5, "a", 45, 1.0)],
               [(6, "a", 100, 1.0), (7, "b", 101, 1.0)], [(8, "a", 29, 100.0), (10, "a", 95, 2.0)], [(11, "z", 300, 1.0)]]
    found, progress = feed.run(make, *batches)
    got = {(minutes(s), u): (n, t) for s, e, u, n, t in found}
    # row 4 comes out of order but in time; row 8 is behind the watermark at 91
    assert got == {(0, "a"): (3, 11.0), (0, None): (1, 4.0), (30, "a"): (1, 1.0), (90, "a"): (2, 3.0), (90, "b"): (1, 1.0)}
    late = Feed(spark, tmp_path / "late")
    rows, _ = late.run(lambda s: late_rows(s, "at", "10 minutes"), *batches)
    assert [(r[0], r[-1]) for r in rows] == [(8, 62 * 60.0)]


def test_sliding_windows(feed):
    rows = [(k, "a", k * 7, 1.0) for k in range(40)]
    found, _ = feed.run(lambda s: window_aggregates(s, "at", "60 minutes", {"n": F.count("*")}, slide="20 minutes", wait="5 minutes"),
                        rows[:15], rows[15:30], rows[30:], [(99, "a", 1000, 1.0)])
    want = {s: sum(s <= k * 7 < s + 60 for k in range(40)) for s in range(-40, 280, 20)}
    assert {minutes(r[0]): r[2] for r in found} == want


def test_sessions_merge_and_end(feed):
    def make(s):
        return session_aggregates(s, "at", "30 minutes", {"n": F.count("*"), "t": F.sum("v")}, "user", "40 minutes")
    found, progress = feed.run(make, [(1, "a", 0, 1.0), (2, "a", 50, 2.0), (3, "b", 3, 1.0), (8, None, 3, 1.0)], [(4, "a", 29, 4.0)],
                               [(5, "a", 75, 8.0), (6, "b", 90, 1.0)], [(7, "c", 500, 1.0)])
    # row 4 lies between two sessions and joins them
    assert sorted((u, minutes(s), minutes(e), n, t) for s, e, u, n, t in found) == [("a", 0, 75, 4, 15.0), ("b", 3, 3, 1, 1.0), ("b", 90, 90, 1, 1.0)]
    assert progress["stateOperators"][0]["numRowsTotal"] == 1


def test_repeats_over_restarts_and_bounded_state(feed):
    def make(s):
        return distinct_rows(s, "user", "at", "30 minutes")
    batches = [[(k, f"u{k}", k, 1.0) for k in range(20)] + [(100 + k, f"u{k}", k + 1, 1.0) for k in range(20)],
               [(200 + k, f"u{k}", k + 2, 1.0) for k in range(20)] + [(300, "u0", 21, 1.0)],
               [(400, "x", 200, 1.0)], [(500, "u3", 201, 1.0), (501, "u3", 205, 1.0)], [(600, "y", 1000, 1.0)], [(700, "y", 1001, 1.0)]]
    found, progress = feed.run(make, *batches)
    users = sorted(r[1] for r in found)
    # each once, and u3 again long after
    assert users == sorted([f"u{k}" for k in range(20)] + ["x", "u3", "y"])
    assert progress["stateOperators"][0]["numRowsTotal"] == 1


def test_streams_only(spark, events):
    batch, stream = events
    for make in (lambda d: window_aggregates(d, "ts", "1 hour", {"n": F.count("*")}), lambda d: session_aggregates(d, "ts", "1 hour", {"n": F.count("*")}, "user_id"),
                 lambda d: distinct_rows(d, "event_id", "ts"), lambda d: late_rows(d, "ts")):
        with pytest.raises(ValueError):
            make(batch)
    with pytest.raises(ValueError):
        window_aggregates(stream, "nothing", "1 hour", {"n": F.count("*")})
    with pytest.raises(ValueError):
        session_aggregates(stream, "ts", "1 hour", {"n": F.count("*")}, [])


def test_sessions_of_a_table(spark, monkeypatch):
    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", 9)
    rng = random.Random(8)
    data = [(rng.choice(["hot", "hot", "a", "b", None]), None if rng.random() < 0.05 else rng.randrange(2000), i) for i in range(300)]
    df = spark.createDataFrame(data, "user string, at int, i int")
    want, last = {}, {}
    for u, at, i in sorted((r for r in data if None not in r), key=lambda r: r[:2]):
        if u not in last or at > last[u] + 12:
            want.setdefault(u, []).append([at, at, 0])
        last[u] = at
        want[u][-1][1:] = [at, want[u][-1][2] + 1]
    found = sessions(df, "at", F.lit(12), {"n": F.count("*")}, "user").collect()
    assert sorted((r.user, r.session_start, r.last_seen, r.n) for r in found) == sorted((u, *s) for u, all_ in want.items() for s in all_)
    assert sessions(df.limit(0), "at", F.lit(1), {"n": F.count("*")}, "user").count() == 0
    numbers = [r.session for r in numbered_sessions(df, "at", F.lit(12), "user").collect()]
    assert sorted(set(numbers)) == list(range(1, len(found) + 1))
