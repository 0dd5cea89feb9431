"""Equi-joins whose heavy keys are split over tasks."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col, spare_names

#: rows of one key on one side that a task may get; a key with more is split
ROWS_PER_TASK = 1_000_000
#: keys a side's sketch keeps track of, of which it hands on half: a key with over 1 / 3,000 of the rows is never missed
TRACKED = 4096

Pairs = list[tuple[str, str]]


def key_pairs(on) -> Pairs:
    """Keys as ``(left, right)`` names; a single name stands for both sides."""
    names = [on] if isinstance(on, str) else list(on or [])
    return [(n, n) if isinstance(n, str) else (n[0], n[1]) for n in names]


def renamed(left: DataFrame, right: DataFrame, drop: list[str], suffix: str) -> dict[str, str]:
    """Result names of the right side's columns: those that the left side has too get a suffix."""
    taken, out = {c.lower() for c in left.columns}, {}
    for c in right.columns:
        if c not in drop:
            name = c
            while name.lower() in taken:
                name += suffix
            taken.add(name.lower())
            out[c] = name
    return out


def _frequent(df: DataFrame, key: Column) -> dict[int, int]:
    """Hashes of frequent keys with about how many rows they have, from one mergeable sketch."""
    found = df.select(key.alias("h")).agg(F.expr(f"approx_top_k(h, {TRACKED // 2}, {TRACKED})").alias("top"))
    return {r["item"]: r["count"] for r in found.first().top or []}


def heavy_keys(left: DataFrame, right: DataFrame, pairs: Pairs, rows_per_task: int) -> dict[int, tuple[int, int]]:
    """For keys that are heavy on a side, by hash: into how many parts the left and the right rows are cut."""
    counts = [_frequent(df, F.xxhash64(*[col(p[k]) for p in pairs])) for k, df in enumerate((left, right))]
    parts = {}
    for h in counts[0].keys() | counts[1].keys():
        cut = tuple(max(1, math.ceil(c.get(h, 0) / rows_per_task)) for c in counts)
        if max(cut) > 1:
            parts[h] = cut
    return parts


def _spread(df: DataFrame, keys: list[str], parts: DataFrame, own: str, other: str, names: list[str]) -> DataFrame:
    """Give each row its part ``own`` and a copy for every part of the other side; light keys have one part each.

    The part hangs on the row and the task that read it, so equal rows part too, and a task that runs again over the
    same rows in another order gives them the same parts.
    """
    h, mine, copies = names
    known = df.withColumn(h, F.xxhash64(*[col(k) for k in keys])).join(F.broadcast(parts), h, "left")
    part = F.pmod(F.xxhash64(*[col(c) for c in df.columns], F.spark_partition_id()), F.coalesce(F.col(own), F.lit(1)))
    return known.select(*[col(c) for c in df.columns], part.alias(mine),
                        F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)).alias(copies))


def _without_nulls(df: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with all keys, and the others, which match nothing and need no shuffle."""
    whole = reduce(lambda a, b: a & b, [col(n).isNotNull() for n in names])
    return df.filter(whole), df.filter(~whole)


def keyed_join(left: DataFrame, right: DataFrame, on, how: str = "inner", condition=None, suffix: str = "_right",
               rows_per_task: int = ROWS_PER_TASK, tasks: int = 1) -> DataFrame:
    """Join on equal keys; keys heavy on either side are split into a grid of tasks.

    ``on``: names, or pairs of a left and a right name. ``how``: ``inner``, ``left``, ``full``, ``semi`` or ``anti``.
    ``condition`` (inner only) is a function of two functions, which give a left and a right column by name. The result
    has the left side's columns, then the right side's without the keys, clashing names with ``suffix``; in a full join
    rows of the right alone have their keys in the left side's. Null keys match nothing.

    A sketch of each side finds the heavy keys first. The rows of such a key are cut into as many parts on a side as
    tasks of ``rows_per_task`` rows need, and each part is copied to the parts of the other side; all other rows move
    once. Rows without a key are not moved at all. An inner join of few bytes that make many pairs takes a number of ``tasks``.
    """
    pairs = key_pairs(on)
    if not pairs:
        raise ValueError("give the keys to join on")
    if how not in ("inner", "left", "full", "semi", "anti"):
        raise ValueError(f"unknown kind of join {how!r}")
    if condition is not None and how != "inner":
        raise ValueError("a condition goes with an inner join only")
    left_keys, right_keys = [p[0] for p in pairs], [p[1] for p in pairs]
    shown = renamed(left, right, right_keys, suffix)
    known, loose = _without_nulls(left, left_keys)
    facing, lost = _without_nulls(right, right_keys)
    if how in ("semi", "anti"):
        kept = _split_join(known, facing.select(*[col(k) for k in right_keys]).distinct(), pairs, how, None, {}, rows_per_task)
        return kept if how == "semi" else kept.unionByName(loose)
    parts = heavy_keys(known, facing, pairs, rows_per_task)
    if how == "inner":
        return _split_join(known, facing, pairs, how, condition, shown, rows_per_task, parts, tasks)
    blank = [F.lit(None).cast(right.schema[c].dataType).alias(n) for c, n in shown.items()]
    if any(r > 1 for _, r in parts.values()):
        # a left row that meets parts of the right side cannot know alone that none matches
        matched = _split_join(known, facing, pairs, "inner", None, shown, rows_per_task, parts)
        single = keyed_join(left, right, pairs, "anti", rows_per_task=rows_per_task).select("*", *blank)
        out = matched.unionByName(single)
    else:
        out = _split_join(known, facing, pairs, "left", None, shown, rows_per_task, parts).unionByName(loose.select("*", *blank))
    if how == "full":
        alone = keyed_join(right, left, [(r, k) for k, r in pairs], "anti", rows_per_task=rows_per_task)
        keys = dict(pairs)
        out = out.unionByName(alone.select(*[(col(keys[c]) if c in keys else F.lit(None)).cast(left.schema[c].dataType).alias(c) for c in left.columns],
                                           *[col(c).alias(n) for c, n in shown.items()]))
    return out


def _split_join(left: DataFrame, right: DataFrame, pairs: Pairs, how: str, condition, shown: dict[str, str], rows_per_task: int,
                parts: dict[int, tuple[int, int]] | None = None, tasks: int = 1) -> DataFrame:
    if parts is None:
        parts = heavy_keys(left, right, pairs, rows_per_task)
    prefix, = spare_names(left, "right")
    facing = right.select(*[col(c).alias(f"{prefix}.{c}") for c in right.columns])
    mine = lambda name: col(name)
    theirs = lambda name: col(f"{prefix}.{name}")
    keys = [(mine(a), theirs(b)) for a, b in pairs]
    if parts:
        h, i, j, left_parts, right_parts = spare_names(left, "h", "i", "j", "left_parts", "right_parts")
        facing_i, facing_j = spare_names(facing, "part_i", "part_j")
        # one row per heavy key, of which a sketch names at most TRACKED
        table = left.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in parts.items()], f"`{h}` long, `{left_parts}` int, `{right_parts}` int")
        spread = _spread(left, [p[0] for p in pairs], table, left_parts, right_parts, [h, i, j])
        facing = _spread(facing, [f"{prefix}.{p[1]}" for p in pairs], table, right_parts, left_parts, [h, facing_j, facing_i])
        keys += [(col(i), col(facing_i)), (col(j), col(facing_j))]
    else:
        spread = left
    if tasks > 1:
        # left to their bytes, all keys may end in a few tasks
        spread, facing = spread.repartition(tasks, *[a for a, _ in keys]), facing.repartition(tasks, *[b for _, b in keys])
    on = [a == b for a, b in keys]
    if condition is not None:
        on.append(condition(mine, theirs))
    joined = spread.join(facing, reduce(lambda a, b: a & b, on), {"semi": "left_semi", "anti": "left_anti"}.get(how, how))
    return joined.select(*[col(c) for c in left.columns], *[theirs(c).alias(n) for c, n in shown.items()])
