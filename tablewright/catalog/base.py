"""Registration helpers for the query catalog."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import operators  # noqa: F401
from ..functions.columns import col, is_floating
from ..plans import apply_steps

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

# derived inputs, written once and used by both engines
NULLED = """SELECT event_id, ts, user_id, event_type,
            CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE value END AS value FROM events"""
NULLED_SEGMENT = """SELECT c_custkey, c_acctbal, c_nationkey,
            CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_mktsegment END AS seg FROM customer"""
PAIRS = "SELECT user_id, event_type FROM events"
NUMBERS = """SELECT l_quantity AS q, l_quantity * 2 + 1 AS q2, l_extendedprice AS p, l_discount AS d,
            CAST(1.0 AS DOUBLE) AS k, l_returnflag AS flag FROM lineitem"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A table by name, or a SELECT over the tables."""
    if text in TABLES:
        return table(spark, sf_dir, text)
    used = {t: table(spark, sf_dir, t) for t in TABLES if f"FROM {t}" in text}
    for t in used:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text, **used)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, as sums depend on their order in the last ones."""
    return df.select(*[F.round(col(c), digits).alias(c) if is_floating(df, c) else col(c) for c in df.columns])


def query(name: str, sql: str | None = None):
    """Register a function ``(spark, sf_dir) -> DataFrame``."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def steps(name: str, text: str, items: list[tuple[str, dict]], sql: str | None, *,
          select: list[str] | None = None, order_by: str | None = None, digits: int | None = 6) -> None:
    """Register the application of steps to a table or SELECT."""
    listed = [{"type": t, "params": p} for t, p in items]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = apply_steps(source(spark, sf_dir, text), listed, order_by)
        df = df.select(*[col(c) for c in select]) if select else df
        return rounded(df, digits) if digits is not None else df

    query(name, sql)(run)
