"""Joins of intervals that overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import col, spare_names
from .keys import ROWS_PER_TASK, key_pairs, keyed_join

#: each level's bins are so many times as wide as those of the level below
WIDER = 8
#: no interval of doubles needs more levels
LEVELS = 64


def measured(df: DataFrame, name: str) -> Column:
    """A column as a number that keeps its order: days of dates, microseconds of timestamps, else the value."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(col(name)).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col(name)).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), col(name)).cast("double")
    if isinstance(kind, T.NumericType):
        return col(name).cast("double")
    raise TypeError(f"column {name!r} is no number, date or timestamp")


def _proper(df: DataFrame, span: tuple[str, str]) -> DataFrame:
    """Rows whose interval has both ends, neither NaN nor infinite, in order."""
    ends = [measured(df, c) for c in span]
    finite = [e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")) for e in ends]
    return df.filter(finite[0] & finite[1] & (col(span[0]) <= col(span[1])))


def _bin(x: Column, width: Column) -> Column:
    return F.floor(x / width)


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], on=(), closed: bool = True,
                 suffix: str = "_right", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """All pairs of a left and a right row whose intervals overlap, and whose keys ``on`` are equal where given.

    Spans are ``(start, end)`` columns of one type, numbers, dates or timestamps. ``closed`` intervals share their end
    points, others need a stretch in common, so an empty one overlaps nothing. Rows with a null, NaN, infinite or
    reversed interval match nothing. Columns as in ``keyed_join``.

    Intervals are put into bins of about twice the median length. Longer ones go to a coarser level, where they fill
    few bins again; a pair meets at the coarser of its two levels, and there in the first bin they share. Full bins are
    split like heavy keys.
    """
    pairs = key_pairs(on)
    sides = [_proper(left, left_span), _proper(right, right_span)]
    spans = [[measured(df, c) for c in span] for df, span in zip(sides, (left_span, right_span))]
    lengths = [df.select((s[1] - s[0]).alias("x")) for df, s in zip(sides, spans)]
    middle, widest, rows = lengths[0].unionByName(lengths[1]).agg(
        F.percentile_approx(F.when(F.col("x") > 0, F.col("x")), 0.5), F.max("x"), F.count("*")).first()
    base = 2 * middle if middle else _point_width(sides, spans, rows)

    def level(s: list[Column]) -> Column:
        length = s[1] - s[0]
        return F.when(length <= base, 0).otherwise(F.least(F.lit(LEVELS), F.ceil(F.log(length / base) / F.log(F.lit(float(WIDER)))))).cast("int")
    own, levels = [], []
    for df, s in zip(sides, spans):
        own.append(level(s))
        levels.append(sorted(r[0] for r in df.select(level(s)).distinct().collect()))
    names = spare_names(left.select("*", *[F.lit(1).alias(c) for c in right.columns if c not in left.columns]), "place", "first", "own")
    binned = [_binned(df, s, k, base, other, names) for df, s, k, other in zip(sides, spans, own, levels[::-1])]
    place, first, mine = names
    before = (lambda a, b: a <= b) if closed else (lambda a, b: a < b)

    def meet(x, y) -> Column:
        here = F.greatest(x(first), y(first)) == x(place)["bin"]
        filled = F.lit(True) if closed else (x(left_span[0]) < x(left_span[1])) & (y(right_span[0]) < y(right_span[1]))
        return ((x(mine) | y(mine)) & here & filled & before(x(left_span[0]), y(right_span[1])) & before(y(right_span[0]), x(left_span[1])))
    joined = keyed_join(binned[0], binned[1], [*pairs, (place, place)], "inner", meet, suffix, rows_per_task)
    drop = {place, first, mine, first + suffix, mine + suffix}
    return joined.select(*[col(c) for c in joined.columns if c not in drop])


def _point_width(sides: list[DataFrame], spans: list[list[Column]], rows: int) -> float:
    """Width of bins where all intervals are points: about one row each."""
    ends = [df.agg(F.min(s[0]), F.max(s[1])).first() for df, s in zip(sides, spans)]
    low, high = ([e[k] for e in ends if e[k] is not None] for k in (0, 1))
    return (max(high) - min(low)) / max(1, rows) or 1.0 if low else 1.0


def _binned(df: DataFrame, span: list[Column], own: Column, base: float, others: list[int], names: list[str]) -> DataFrame:
    """A row for every bin of the interval at its own level, and at coarser ones where the other side has intervals."""
    place, first, mine = names

    def at(k: Column) -> Column:
        width = F.lit(base) * F.pow(F.lit(float(WIDER)), k)
        low, high = _bin(span[0], width), _bin(span[1], width)
        return F.transform(F.sequence(low, high), lambda b: F.struct(F.struct(k.alias("level"), b.alias("bin")).alias(place), low.alias(first), (k == own).alias(mine)))
    coarser = F.filter(F.array(*[F.lit(k) for k in others]).cast("array<int>"), lambda k: k > own)
    bins = F.flatten(F.transform(F.concat(F.array(own), coarser), at))
    x, = spare_names(df, "x")
    return df.withColumn(x, F.explode(bins)).select(*[col(c) for c in df.columns], *[F.col(x)[n].alias(n) for n in names])
