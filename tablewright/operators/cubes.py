"""Grouping sets from one grouping, and exact and approximate distinct aggregates."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import col, spare_names

#: aggregates that coarser groups can be made of finer ones: states of a column, how two states merge, the value of a state
STATES = {
    "count": ({"n": lambda c: F.count(c)}, {"n": F.sum}, lambda s: s("n")),
    "rows": ({"n": lambda c: F.count(F.lit(1))}, {"n": F.sum}, lambda s: s("n")),
    "sum": ({"s": lambda c: F.sum(c)}, {"s": F.sum}, lambda s: s("s")),
    "min": ({"m": lambda c: F.min(c)}, {"m": F.min}, lambda s: s("m")),
    "max": ({"m": lambda c: F.max(c)}, {"m": F.max}, lambda s: s("m")),
    "mean": ({"s": lambda c: F.sum(c.cast("double")), "n": lambda c: F.count(c)}, {"s": F.sum, "n": F.sum},
             lambda s: F.when(s("n") > 0, s("s") / s("n"))),
    "approx_distinct": ({"h": lambda c: F.hll_sketch_agg(c, F.lit(14))}, {"h": F.hll_union_agg}, lambda s: F.coalesce(F.hll_sketch_estimate(s("h")), F.lit(0))),
}


def cube_sets(keys: list[str]) -> list[tuple[str, ...]]:
    """All subsets of the keys, the largest first."""
    return [c for n in range(len(keys), -1, -1) for c in combinations(keys, n)]


def rollup_sets(keys: list[str]) -> list[tuple[str, ...]]:
    """The keys without none, one, two and so on of the last."""
    return [tuple(keys[:n]) for n in range(len(keys), -1, -1)]


def grouping_sets(df: DataFrame, sets: list, aggregates: dict[str, tuple[str | None, str]], grouping_id: str = "grouping_id") -> DataFrame:
    """Aggregates for several sets of keys: a row for each group of each set, keys that are not in the set null.

    ``aggregates`` maps new names to ``(column, kind)`` with a kind of ``STATES``. ``grouping_id`` has a bit for each
    key, the first one the highest, that is 1 when the key is not in the set; it tells such a null from a null value.
    An empty table gives only the row of the empty set, if it is asked for; a set named twice counts once.

    Rows are read and grouped once, by all keys; every other set is merged from the states of that grouping, and a
    group is combined in the tasks before it is shuffled.
    """
    sets = list(dict.fromkeys(tuple(s) for s in sets))
    keys = [k for k in df.columns if any(k in s for s in sets)]
    missing = {k for s in sets for k in s} - set(df.columns) or {k for _, k in aggregates.values()} - set(STATES)
    if missing:
        raise ValueError(f"unknown columns or aggregates {sorted(missing)}")
    names = {(a, s): n for (a, s), n in zip([(a, s) for a, (_, kind) in aggregates.items() for s in STATES[kind][0]],
                                            spare_names(df, *[f"{a}_{s}" for a, (_, kind) in aggregates.items() for s in STATES[kind][0]]))}
    fine = df.groupBy(*[col(k) for k in keys]).agg(*[
        STATES[kind][0][s](F.lit(1) if c is None else col(c)).alias(names[a, s]) for a, (c, kind) in aggregates.items() for s in STATES[kind][0]])
    bits = {k: 1 << (len(keys) - 1 - i) for i, k in enumerate(keys)}
    ids = [sum(b for k, b in bits.items() if k not in s) for s in sets]
    gid, = spare_names(fine, "gid")
    spread = fine.withColumn(gid, F.explode(F.array(*[F.lit(i).cast("long") for i in ids])))
    shown = [F.when(F.col(gid).bitwiseAND(F.lit(bits[k])) == 0, col(k)).alias(k) for k in keys]
    spread = spread.select(*shown, gid, *[col(n) for n in names.values()])
    merged = spread.groupBy(*[col(k) for k in keys], gid).agg(*[
        STATES[kind][1][s](col(names[a, s])).alias(names[a, s]) for a, (_, kind) in aggregates.items() for s in STATES[kind][1]])
    if 2 ** len(keys) - 1 in ids and keys:
        merged = merged.unionByName(_nothing(df, keys, aggregates, names, gid, 2 ** len(keys) - 1))
    value = lambda a: (lambda s: col(names[a, s]))
    return merged.select(*[col(k) for k in keys], F.col(gid).alias(grouping_id),
                         *[STATES[kind][2](value(a)).alias(a) for a, (_, kind) in aggregates.items()])


def _nothing(df: DataFrame, keys: list[str], aggregates: dict, names: dict, gid: str, number: int) -> DataFrame:
    """The row of the empty set over a table without rows; no row otherwise."""
    empty = df.limit(1).agg(F.count("*").alias("n"), *[
        STATES[kind][0][s](F.lit(1) if c is None else col(c)).alias(names[a, s]) for a, (c, kind) in aggregates.items() for s in STATES[kind][0]])
    return empty.where("n = 0").select(*[F.lit(None).cast(df.schema[k].dataType).alias(k) for k in keys], F.lit(number).cast("long").alias(gid),
                                       *[col(n) for n in names.values()])


DISTINCT = {"count": F.count, "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}


def distinct_aggregates(df: DataFrame, by, aggregates: dict[str, tuple[str, str]]) -> DataFrame:
    """Aggregates over the distinct non-null values of columns in each group, exactly: ``{new: (column, kind)}``.

    Kinds: ``count``, ``sum``, ``mean``, ``min``, ``max``. Groups with null keys are groups; one without any value has
    a count of 0 and otherwise null. Without keys there is one row.

    In two phases: equal values of a group are combined first, in the tasks and then across them by group and value,
    so a group of any size is spread over tasks; what is left is added up per group, again combined before it moves.
    """
    keys = [by] if isinstance(by, str) else list(by or [])
    unknown = {k for _, k in aggregates.values()} - set(DISTINCT) or ({c for c, _ in aggregates.values()} | set(keys)) - set(df.columns)
    if unknown:
        raise ValueError(f"unknown columns or aggregates {sorted(unknown)}")
    columns = list(dict.fromkeys(c for c, _ in aggregates.values()))
    parts: list[DataFrame] = []
    for c in columns:
        value, = spare_names(df, "value")
        single = df.groupBy(*[col(k) for k in keys], col(c).alias(value)).agg(F.lit(1).alias("one"))
        wanted = {n: k for n, (x, k) in aggregates.items() if x == c}
        parts.append(single.groupBy(*[col(k) for k in keys]).agg(*[DISTINCT[k](F.col(value)).alias(n) for n, k in wanted.items()]))
    if not keys:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).agg(*[F.max(col(n)).alias(n) for n in aggregates])
    # every part has all groups once, so they only have to be laid side by side
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.groupBy(*[col(k) for k in keys]).agg(*[F.max(col(n)).alias(n) for n in aggregates])


def approx_distinct(df: DataFrame, by, column: str, error: float = 0.02, name: str = "distinct") -> DataFrame:
    """The number of distinct values per group within about ``error`` (one standard deviation), from mergeable sketches."""
    keys = [by] if isinstance(by, str) else list(by or [])
    bits = next(k for k in range(4, 22) if 1.04 / 2 ** (k / 2) <= error or k == 21)
    sketch = F.hll_sketch_agg(col(column), F.lit(bits))
    return df.groupBy(*[col(k) for k in keys]).agg(F.coalesce(F.hll_sketch_estimate(sketch), F.lit(0)).alias(name))
