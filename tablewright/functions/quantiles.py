"""Exact order statistics without sorting the table or holding a column in one task.

A rank is narrowed to an open value interval by mergeable sketches
(``approx_percentile``); plain conditional counts then say which side the rank
lies on, so the answer is exact whatever the sketch error. Once few rows remain
inside the interval, picking among just those finishes. Every
round is one aggregate for all columns and ranks together.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .columns import col

SKETCH_ACCURACY = 10_000
MAX_INTERIOR_ROWS = 200_000


def nearest_rank(n: int, q: float) -> int:
    """Zero-based position of quantile ``q`` under nearest-rank interpolation."""
    return min(n - 1, int(math.floor((n - 1) * q + 0.5)))


@dataclass
class _Search:
    value: Column
    rank: int          # zero-based, counted inside the interval
    rows: int          # rows inside the interval
    low: object = None
    high: object = None
    answer: object = None
    done: bool = False
    stuck: bool = False

    def inside(self) -> Column:
        keep = self.value.isNotNull()
        if self.low is not None:
            keep = keep & (self.value > F.lit(self.low))
        if self.high is not None:
            keep = keep & (self.value < F.lit(self.high))
        return F.when(keep, self.value)

    def pivots(self, sketched: list) -> tuple | None:
        """Two cut values strictly inside the interval, or ``None`` when there are none to be found.

        Sketches work in doubles, so for large whole numbers they may miss a narrow
        interval; the middle of the interval then serves.
        """
        good = [v for v in sketched if (self.low is None or v > self.low) and (self.high is None or v < self.high)]
        if good:
            return good[0], good[-1]
        if all(isinstance(v, int) for v in sketched):
            low = -2**63 - 1 if self.low is None else self.low
            high = 2**63 if self.high is None else self.high
            if high - low > 1:
                return ((low + high) // 2,) * 2
        return None

    def settle(self, pivots, counts) -> None:
        """Move to the part of the interval that holds the rank."""
        a, b = pivots
        below, at_a, between, at_b = counts
        if self.rank < below:
            self.high, self.rows = a, below
            return
        self.rank -= below
        if self.rank < at_a:
            self.answer, self.done = a, True
            return
        self.rank -= at_a
        if self.rank < between:
            self.low, self.high, self.rows = a, b, between
            return
        self.rank -= between
        if self.rank < at_b:
            self.answer, self.done = b, True
            return
        self.rank -= at_b
        self.low, self.rows = b, self.rows - below - at_a - between - at_b


def values_at_ranks(df: DataFrame, wanted: list[tuple[Column, int, int]],
                    max_interior: int = MAX_INTERIOR_ROWS) -> list:
    """For each ``(value, non-null count, zero-based rank)`` the value at that rank."""
    searches = [_Search(value, rank, n) for value, n, rank in wanted]
    for s in searches:
        if not 0 <= s.rank < s.rows:
            s.done = True
    while wide := [s for s in searches if not s.done and s.rows > max_interior and not s.stuck]:
        _narrow(df, wide)
    last = [s for s in searches if not s.done]
    if last:
        narrow = df.select(*[s.inside().alias(f"v{i}") for i, s in enumerate(last)])
        row = narrow.agg(*[_pick(narrow, i, s).alias(f"v{i}") for i, s in enumerate(last)]).first()
        for i, s in enumerate(last):
            s.answer, s.done = row[f"v{i}"], True
    return [s.answer for s in searches]


def _pick(narrow: DataFrame, i: int, s: _Search) -> Column:
    """The value at the rank among the few left inside the interval.

    ``percentile_disc`` counts repeated values but answers in doubles, so other types
    are sorted as they are.
    """
    if isinstance(narrow.schema[f"v{i}"].dataType, (T.DoubleType, T.FloatType)):
        return F.expr(f"percentile_disc({(s.rank + 0.5) / s.rows!r}D) WITHIN GROUP (ORDER BY v{i})")
    return F.get(F.array_sort(F.collect_list(f"v{i}")), F.lit(s.rank))


def _narrow(df: DataFrame, searches: list[_Search]) -> None:
    slack = 2.0 / SKETCH_ACCURACY
    # searches in the same interval of the same column share a sketch, which is what costs
    shared: dict[tuple, list[int]] = {}
    for i, s in enumerate(searches):
        shared.setdefault((str(s.value), s.low, s.high), []).append(i)
    sketches = []
    for n, members in enumerate(shared.values()):
        centres = [(searches[i].rank + 0.5) / searches[i].rows for i in members]
        probes = [q for p in centres for q in (max(0.0, p - slack), min(1.0, p + slack))]
        sketches.append(F.percentile_approx(searches[members[0]].inside(), probes, SKETCH_ACCURACY).alias(f"p{n}"))
    found = df.agg(*sketches).first()
    cuts = {i: searches[i].pivots(found[f"p{n}"][2 * j:2 * j + 2])
            for n, members in enumerate(shared.values()) for j, i in enumerate(members)}
    counts = []
    for i, s in enumerate(searches):
        if cuts[i] is None:
            s.stuck = True
            continue
        a, b = cuts[i]
        v = s.inside()
        tests = [v < F.lit(a), v == F.lit(a), (v > F.lit(a)) & (v < F.lit(b)), (v == F.lit(b)) & F.lit(a != b)]
        counts += [F.count_if(t).alias(f"c{i}_{j}") for j, t in enumerate(tests)]
    if not counts:
        return
    tally = df.agg(*counts).first()
    for i, s in enumerate(searches):
        if cuts[i] is not None:
            s.settle(cuts[i], [tally[f"c{i}_{j}"] for j in range(4)])


def column_quantiles(df: DataFrame, columns: list[str], probs: list[float],
                     method: str = "nearest", counts: dict[str, int] | None = None,
                     max_interior: int = MAX_INTERIOR_ROWS) -> dict[str, list]:
    """Quantiles of the non-null values of several columns in shared passes.

    ``method`` is "nearest" (an actual value) or "linear" (between neighbours, as
    a median is). A column without values gives ``None`` throughout.
    """
    return mixed_quantiles(df, {c: [(p, method) for p in probs] for c in columns},
                           counts, max_interior)


def mixed_quantiles(df: DataFrame, wanted: dict[str, list[tuple[float, str]]],
                    counts: dict[str, int] | None = None,
                    max_interior: int = MAX_INTERIOR_ROWS) -> dict[str, list]:
    """As ``column_quantiles`` with a method per probability."""
    if not wanted:
        return {}
    if counts is None:
        row = df.agg(*[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(wanted)]).first()
        counts = {c: row[f"n{i}"] for i, c in enumerate(wanted)}
    requests, slots = [], {}
    for c, probs in wanted.items():
        for p, method in probs:
            for r in _ranks(counts[c], p, method):
                if (c, r) not in slots:
                    slots[c, r] = len(requests)
                    requests.append((col(c), counts[c], r))
    values = values_at_ranks(df, requests, max_interior)
    return {c: [_combine(counts[c], p, m, lambda r: values[slots[c, r]]) for p, m in probs]
            for c, probs in wanted.items()}


def _ranks(n: int, p: float, method: str) -> list[int]:
    if n == 0:
        return []
    if method == "nearest":
        return [nearest_rank(n, p)]
    low = int(math.floor((n - 1) * p))
    return [low, min(n - 1, low + 1)]


def _combine(n: int, p: float, method: str, value_of):
    if n == 0:
        return None
    ranks = _ranks(n, p, method)
    low = value_of(ranks[0])
    if method == "nearest":
        return low
    low, high = float(low), float(value_of(ranks[1]))
    share = (n - 1) * p - ranks[0]
    return low if share == 0 else low + (high - low) * share


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """Linear quantiles of a double column per group, as columns q0, q1, ... beside the keys and ``n``.

    Rows are put in the order of keys and value and cut into ranges. Counts per group and range, few rows, tell each
    group's size and at which of its ranks a range begins; rows are numbered inside a range and those at the wanted
    ranks are picked. The values are shuffled once, no task holds a group, and only bounds reach the driver.
    """
    from .ordering import BUCKET, bucketed
    names = [f"__key{i}" for i in range(len(keys))]
    rows = df.select(*[col(k).alias(n) for k, n in zip(keys, names)], col(value).cast("double").alias("__value"))
    # as a struct, keys with nulls are equal too
    group = F.struct(*[F.col(n) for n in names]) if names else F.struct(F.lit(0).alias("one"))
    placed = bucketed(rows, [*names, "__value"]).df.select(BUCKET, group.alias("__group"), "__value")
    counts = placed.groupBy("__group", BUCKET).agg(F.count("__value").alias("__n"))
    inside = Window.partitionBy("__group")
    parts = counts.select("__group", BUCKET, F.sum("__n").over(inside).alias("n"),
                          (F.sum("__n").over(inside.orderBy(BUCKET)) - F.col("__n")).alias("__before"))
    numbered = placed.filter(F.col("__value").isNotNull()).withColumn("__local", F.row_number().over(Window.partitionBy("__group", BUCKET).orderBy("__value")) - 1)
    rank = F.col("__before") + F.col("__local")
    picks = []
    for i, p in enumerate(probs):
        at = (F.col("n") - 1) * F.lit(float(p))
        picks += [F.max(F.when(rank == F.floor(at), F.col("__value"))).alias(f"__low{i}"),
                  F.max(F.when(rank == F.ceil(at), F.col("__value"))).alias(f"__high{i}")]
    # a group's counts come along once for each of its ranges; one without values has no rank but a size of 0
    out = parts.join(numbered, ["__group", BUCKET], "left").groupBy("__group").agg(F.max("n").alias("n"), *picks)

    def line(i: int, p: float) -> Column:
        at = (F.col("n") - 1) * F.lit(float(p))
        low, share = F.col(f"__low{i}"), at - F.floor(at)
        return low + F.when(share == 0, F.lit(0.0)).otherwise((F.col(f"__high{i}") - low) * share)
    return out.select(*[F.col("__group")[n].alias(k) for k, n in zip(keys, names)], "n", *[line(i, p).alias(f"q{i}") for i, p in enumerate(probs)])
