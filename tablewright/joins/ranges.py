"""Joins on inequalities: a matrix of range buckets of which only the cells that can match are visited."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col, spare_names
from ..functions.ordering import range_bucket, range_bounds
from .keys import ROWS_PER_TASK, key_pairs, keyed_join

#: rows of the right side in a bucket
ROWS_PER_BUCKET = 200_000
#: a matrix has at most so many buckets on a side; larger ones are split by rows like heavy keys
BUCKETS = 2000

#: pairs of rows that a task compares, and tasks at most
PAIRS_PER_TASK, TASKS = 20_000_000, 10_000

FLIPPED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}


def range_join(left: DataFrame, right: DataFrame, value: str, low: Column | None = None, high: Column | None = None, on=(),
               low_closed: bool = True, high_closed: bool = True, condition=None, suffix: str = "_right",
               rows_per_bucket: int = ROWS_PER_BUCKET, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """All pairs where the right side's ``value`` lies between the left side's ``low`` and ``high`` (one may be missing).

    Keys ``on`` and a further ``condition`` as in ``keyed_join``. Null and NaN values and bounds match nothing.

    The values of the right side are cut into ranges; a left row goes to the ranges its bounds reach into, so cells of
    the matrix that cannot match get no rows. Full ranges, such as those of one frequent value, are split by rows.
    """
    if low is None and high is None:
        raise ValueError("give a lower or an upper bound")
    pairs = key_pairs(on)
    whole = lambda df, c: c.isNotNull() & (~F.isnan(c) if df.select(c.alias("x")).dtypes[0][1] in ("double", "float") else F.lit(True))
    right = right.filter(whole(right, col(value)))
    names = spare_names(left.select("*", *[F.lit(1).alias(c) for c in right.columns if c not in left.columns]), "bucket", "low", "high")
    bucket, low_name, high_name = names
    ends = [(n, c) for n, c in ((low_name, low), (high_name, high)) if c is not None]
    asked = left.filter(reduce(lambda a, b: a & b, [whole(left, c) for _, c in ends]))
    asked = asked.select("*", *[c.alias(n) for n, c in ends])
    # values and bounds of different types are compared as doubles where ranges are chosen, which keeps their order
    kinds = {asked.schema[n].dataType for n, _ in ends} | {right.schema[value].dataType}
    scaled = (lambda c: c) if len(kinds) == 1 else (lambda c: c.cast("double"))
    rows = right.count()
    buckets = min(BUCKETS, max(1, math.ceil(rows / rows_per_bucket)))
    number = lambda c: F.struct(scaled(c).alias("k0"))
    bounds = range_bounds(right.select(number(col(value)).alias("key")), "key", buckets, rows)
    first = F.lit(0) if low is None else range_bucket(number(F.col(low_name)), bounds)
    last = F.lit(len(bounds)) if high is None else range_bucket(number(F.col(high_name)), bounds)
    spread = asked.withColumn(bucket, F.explode(F.when(first <= last, F.sequence(first, last))))

    def inside(x, y) -> Column:
        tests = [] if low is None else [y(value) >= x(low_name) if low_closed else y(value) > x(low_name)]
        tests += [] if high is None else [y(value) <= x(high_name) if high_closed else y(value) < x(high_name)]
        tests += [condition(x, y)] if condition is not None else []
        return reduce(lambda a, b: a & b, tests)
    keys = [*pairs, (bucket, bucket)]
    placed = right.withColumn(bucket, range_bucket(number(col(value)), bounds))
    tasks = min(TASKS, math.ceil(_meeting(spread, placed, keys) / PAIRS_PER_TASK))
    joined = keyed_join(spread, placed, keys, "inner", inside, suffix, rows_per_task, tasks)
    return joined.select(*[col(c) for c in joined.columns if c not in names])


def _meeting(left: DataFrame, right: DataFrame, keys) -> int:
    """How many pairs of rows share their keys."""
    n, m = spare_names(left.select(*[col(a) for a, _ in keys]), "n", "m")
    counts = [df.groupBy(*[col(p[k]).alias(f"k{i}") for i, p in enumerate(keys)]).agg(F.count("*").alias(c)) for k, (df, c) in enumerate(((left, n), (right, m)))]
    return int(counts[0].join(counts[1], [f"k{i}" for i in range(len(keys))]).agg(F.sum(F.col(n).cast("double") * F.col(m))).first()[0] or 0)


def theta_join(left: DataFrame, right: DataFrame, conditions: list[tuple[str, str, str]], on=(), suffix: str = "_right",
               rows_per_bucket: int = ROWS_PER_BUCKET, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """All pairs for which every ``(left column, operator, right column)`` holds; operators ``<``, ``<=``, ``>``, ``>=``.

    The right column of the first condition is cut into ranges; all conditions on it bound the ranges a left row
    visits, the others are checked on the pairs that meet. Nulls match nothing.
    """
    if not conditions or any(op not in FLIPPED for _, op, _ in conditions):
        raise ValueError("give conditions with <, <=, > or >=")
    value, bounds, rest = conditions[0][2], {}, []
    for a, op, b in conditions:
        side = FLIPPED[op][0]
        if b == value and side not in bounds:
            bounds[side] = (col(a), "=" in op)
        else:
            rest.append((a, op, b))
    tests = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    condition = (lambda x, y: reduce(lambda p, q: p & q, [tests[op](x(a), y(b)) for a, op, b in rest])) if rest else None
    low, high = bounds.get(">"), bounds.get("<")
    return range_join(left, right, value, low and low[0], high and high[0], on, bool(low and low[1]), bool(high and high[1]), condition,
                      suffix, rows_per_bucket, rows_per_task)
