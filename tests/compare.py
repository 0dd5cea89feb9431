"""Run catalog queries on Spark and their SQL on DuckDB and compare the results."""

from __future__ import annotations

import collections
import datetime as dt
import decimal
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def make_session(cores: int = 8):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("tablewright-tests")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    return spark


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        if v != v:
            return "nan"
        return "0.0" if v == 0 else repr(v)
    if isinstance(v, decimal.Decimal):
        return "decimal " + str(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty when equal, else what differs."""
    df = query(spark, sf_dir)
    ours = [tuple(r) for r in df.collect()]
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    theirs = found.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    a_at, b_at = [df.columns.index(c) for c in sorted(names)], [names.index(c) for c in sorted(names)]
    a = collections.Counter(tuple(plain(r[i]) for i in a_at) for r in ours)
    b = collections.Counter(tuple(plain(r[i]) for i in b_at) for r in theirs)
    if a == b:
        return ""
    left, right = list((a - b).items()), list((b - a).items())
    return f"{sum((a - b).values())} rows differ: {sorted(map(str, left))[:2]} against {sorted(map(str, right))[:2]}"


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = make_session(), duck(sf_dir)
    wanted = sys.argv[1:]
    oracles, bad, total = oracle_sql(), 0, 0.0
    for name, fn in queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            outcome = (compare(spark, con, fn, oracles[name], sf_dir) if name in oracles
                       else f"rows only: {len(fn(spark, sf_dir).collect())}")
        except Exception as problem:  # noqa: BLE001  report and go on
            outcome = f"ERROR {type(problem).__name__}: {str(problem)[:600]}"
        took = time.time() - start
        total += took
        bad += bool(outcome) and not outcome.startswith("rows only")
        print(f"{'ok ' if not outcome else '-- '} {took:6.2f}s {name} {outcome[:900]}", flush=True)
    print(f"{bad} wrong, {total:.1f}s")
