"""Queries that run first in a session: its small expression ids once misled the optimizer, later ones hid that."""

import datetime as dt
import os
import subprocess
import sys

import pytest

SCRIPT = """
import sys
sys.path[:0] = [{root!r}, {root!r} + "/tests"]
from compare import make_session
from tablewright.catalog import QUERIES
print(len(QUERIES[{name!r}](make_session(2), {folder!r}).collect()), "rows")
"""


@pytest.mark.parametrize("name, rows", [("tiles_of_events", 300), ("neighbours_of_events", 300), ("band_join_orders", 100)])
def test_first_in_a_session(spark, tmp_path, name, rows):
    at = dt.datetime(2024, 1, 1)
    tables = {"events": ("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
                         [(i, at + dt.timedelta(seconds=i * 7 % 300), i % 5, "view", float(i), "{}") for i in range(300)]),
              "customer": ("c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
                           [(i, "a", 1, i * 10.0, "b") for i in range(100)]),
              "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
                         [(i, i, "O", i * 100.0, at, "1") for i in range(100)])}
    for table, (schema, made) in tables.items():
        spark.createDataFrame(made, schema).write.parquet(f"{tmp_path}/{table}.parquet")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = SCRIPT.format(root=root, name=name, folder=str(tmp_path))
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300)
    assert f"{rows} rows" in done.stdout, done.stderr[-1500:]
