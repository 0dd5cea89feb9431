"""As-of joins: to each row the last row of another table before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col
from ..functions.ordering import bucketed, carried
from .keys import key_pairs, renamed


def asof_join(left: DataFrame, right: DataFrame, time, on=(), direction: str = "backward", tolerance: Column | None = None,
              allow_equal: bool = True, suffix: str = "_right") -> DataFrame:
    """Every left row with the right row of the same keys that is last at or before it (``forward``: first at or after it).

    ``time`` is a name or a pair of a left and a right name, of one type; keys ``on`` as in ``keyed_join``. With
    ``tolerance``, an amount that can be taken from a time, farther right rows do not count. Without ``allow_equal``
    the right row must be strictly earlier (later). Of right rows of one key and time the greatest by its other columns
    counts. Left rows without a match, or with a null key or time, have nulls in the right side's columns: its keys
    are left out, its time stays, with ``suffix`` if the names clash.

    Both sides are put into one order of keys and times and cut into ranges of it, so a frequent key fills several
    ranges; what a range needs from those before it is one row. No window holds a key.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"unknown direction {direction!r}")
    pairs, (left_time, right_time) = key_pairs(on), key_pairs([time] if isinstance(time, tuple) else time)[0]
    backward = direction == "backward"
    shown = renamed(left, right, [p[1] for p in pairs], suffix)
    if left.schema[left_time].dataType != right.schema[right_time].dataType:
        raise TypeError("both times must be of one type")
    usable = lambda df, names: [col(n).isNotNull() for n in names]

    def both(tests: list[Column]) -> Column:
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out
    left_ok, right_ok = both(usable(left, [left_time, *(p[0] for p in pairs)])), both(usable(right, [right_time, *(p[1] for p in pairs)]))
    keys = [f"k{i}" for i in range(len(pairs))]
    # at one time the right row comes first if it counts: last in a backward search, first in a forward one
    right_first = allow_equal == backward
    side = lambda is_right: F.lit(int(is_right != right_first))
    payload = F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(shown)])
    rows = left.filter(left_ok).select(*[col(a).alias(k) for k, (a, _) in zip(keys, pairs)], col(left_time).alias("t"), side(False).alias("side"),
                                       F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(left.columns)]).alias("row"))
    facing = right.filter(right_ok).groupBy(*[col(b).alias(k) for k, (_, b) in zip(keys, pairs)], col(right_time).alias("t")).agg(F.max(payload).alias("found"))
    facing = facing.withColumn("side", side(True))
    union = rows.unionByName(facing, allowMissingColumns=True)
    # left rows of one key and time may fill several ranges: all get what came before
    ordered = bucketed(union, [*keys, "t", "side"], ["row"])
    hit = F.struct(*[F.col(k) for k in keys], F.col("t"), F.col("found"))
    matched = carried(ordered, F.when(F.col("found").isNotNull(), hit), {"hit": not backward}).filter(F.col("row").isNotNull())
    near = both([F.col("hit").isNotNull(), *[F.col("hit")[k] == F.col(k) for k in keys]])
    if tolerance is not None:
        earliest = F.col("t") - tolerance if backward else F.col("t") + tolerance
        near = near & (F.col("hit")["t"] >= earliest if backward else F.col("hit")["t"] <= earliest)
    found = F.when(near, F.col("hit")["found"])
    out = matched.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(left.columns)],
                         *[found[f"c{i}"].alias(n) for i, n in enumerate(shown.values())])
    blank = left.filter(~left_ok).select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(n) for c, n in shown.items()])
    return out.unionByName(blank)
