"""Ranks, neighbours and value-range frames in the order of a whole table, without a window over all rows."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, Window, functions as F

from .checkpoints import settled
from .columns import col, is_numeric, spare_names
from .ordering import BUCKET, COARSE, INDEX, KEY, bucketed, order_columns, range_bounds, range_bucket, with_row_index

RANKS = ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist")


def _fresh(df: DataFrame, names) -> None:
    taken = set(names) & set(df.columns)
    if taken:
        raise ValueError(f"the table has columns {sorted(taken)} already")


def ranked(df: DataFrame, order_by, ranks: dict[str, str], tiles: dict[str, int] | None = None) -> DataFrame:
    """Add positions in the ascending order of ``order_by`` (nulls first), under new names.

    ``ranks`` maps names to ``row_number``, ``rank``, ``dense_rank``, ``percent_rank`` or ``cume_dist``; ``tiles`` maps
    names to numbers of tiles. Rows with equal keys share a rank and are numbered in the order of a row hash.

    Rows are ranked inside ranges of the order. A frequent key fills several ranges, so the summary of the ranges, a
    row each, tells where the run of equal keys began that a range goes on with, how many keys end before it, and how
    many rows a run has beyond it.
    """
    unknown = [k for k in ranks.values() if k not in RANKS]
    if unknown:
        raise ValueError(f"unknown ranks {unknown}")
    _fresh(df, [*ranks, *(tiles or {})])
    names = order_columns(order_by)
    ordered = bucketed(df, names)
    value, local, low, dense, total = spare_names(df, "value", "local", "rank", "dense", "total")
    start, before, run, tail, goes_on = spare_names(df, "start", "before", "run", "tail", "goes_on")
    same = F.struct(*[F.col(KEY)[f"k{i}"].alias(f"k{i}") for i in range(len(names))])
    inside = ordered.df.withColumn(value, same)
    by_key, by_value = Window.partitionBy(BUCKET).orderBy(KEY), Window.partitionBy(BUCKET).orderBy(value)
    inside = inside.withColumns({local: F.row_number().over(by_key), low: F.rank().over(by_value), dense: F.dense_rank().over(by_value)})
    # one row per range from here to the join
    sums = inside.groupBy(BUCKET).agg(F.count("*").alias("rows"), F.min(value).alias("first"), F.max(value).alias("last"),
                                      F.max(low).alias("last_low"), F.max(dense).alias("values"))
    along = Window.orderBy(BUCKET)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    sums = (sums.withColumn(start, F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
            .withColumn(goes_on, F.coalesce(F.lag("last").over(along).eqNullSafe(F.col("first")) & F.lag("rows").over(along).isNotNull(), F.lit(False))))
    sums = sums.withColumn(before, F.sum(F.col("values") - F.col(goes_on).cast("long")).over(along) - F.col("values"))
    # where the range's last run began, unless it is wholly inside a longer one
    own = F.when(~(F.col(goes_on) & (F.col("values") == 1)), F.col(start) + F.col("last_low"))
    sums = sums.withColumn("began", F.last(own, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    sums = sums.withColumn(run, F.lag("began").over(along)).withColumn(total, F.sum("rows").over(Window.partitionBy(F.lit(1))))
    kept = sums.select(BUCKET, start, before, run, goes_on, total)
    out = inside.join(F.broadcast(kept), BUCKET)
    shared = F.col(goes_on) & (F.col(dense) == 1)
    rank = F.when(shared, F.col(run)).otherwise(F.col(start) + F.col(low))
    made = {"row_number": F.col(start) + F.col(local), "rank": rank, "dense_rank": F.col(before) + F.col(dense),
            "percent_rank": F.when(F.col(total) > 1, (rank - 1) / (F.col(total) - 1)).otherwise(F.lit(0.0))}
    if "cume_dist" in ranks.values():
        # rows up to the end of a run: it ends where the next one begins
        runs = out.groupBy(rank.alias(tail)).agg(F.count("*").alias("n"))
        out = out.withColumn(tail, rank)
        out = out.join(runs, tail)
        made["cume_dist"] = (F.col(tail) + F.col("n") - 1) / F.col(total)
    shown = [made[k].alias(n) for n, k in ranks.items()]
    for name, k in (tiles or {}).items():
        # the first tiles are one row longer
        small, longer = F.floor(F.col(total) / k), F.col(total) % k
        at = made["row_number"] - 1
        shown.append((F.when(at < longer * (small + 1), F.floor(at / (small + 1)))
                      .otherwise(longer + F.floor((at - longer * (small + 1)) / F.greatest(small, F.lit(1)))) + 1).cast("int").alias(name))
    return out.select(*[col(c) for c in df.columns], *shown)


def shifted(df: DataFrame, order_by, shifts: dict[str, tuple[str, int]], block: int = 500_000) -> DataFrame:
    """Add values of the row some places before (positive) or after (negative) in the order: ``{new: (column, places)}``.

    Rows are numbered and cut into blocks; the rows at a block's edges are lent to its neighbours.
    """
    _fresh(df, shifts)
    ordered = bucketed(df, order_by)
    numbered = with_row_index(ordered).drop(KEY, BUCKET)
    back, ahead = (max([0, *(sign * k for _, k in shifts.values())]) for sign in (1, -1))
    block = max(block, back, ahead, 1)
    own_name, home = spare_names(df, "own", "home")
    own = F.floor(F.col(INDEX) / block)
    homes = F.array(own, F.when(F.col(INDEX) % block >= block - back, own + 1), F.when(F.col(INDEX) % block < ahead, own - 1))
    spread = numbered.withColumn(own_name, own).withColumn(home, F.explode(F.array_compact(homes)))
    window = Window.partitionBy(home).orderBy(INDEX)
    moved = spread.withColumns({n: F.lag(col(c), k).over(window) if k >= 0 else F.lead(col(c), -k).over(window) for n, (c, k) in shifts.items()})
    return moved.where(F.col(home) == F.col(own_name)).select(*[col(c) for c in [*df.columns, *shifts]])


#: how the parts of a frame are put together
MERGED = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def _simple(aggregate: str) -> tuple[str, str] | None:
    """Function and argument of an aggregate that parts of a frame give, such as ``sum(price)``; none of any other text."""
    found = re.fullmatch(rf"\s*({'|'.join(MERGED)})\s*\((.*)\)\s*", aggregate, re.I | re.S)
    if not found:
        return None
    depth, bare = 0, re.sub(r"'[^']*'|\"[^\"]*\"|`[^`]*`", "", found[2])
    for c in bare:
        depth += (c == "(") - (c == ")")
        if depth < 0 or (depth == 0 and c == ","):
            return None
    return None if depth or re.match(r"\s*(distinct|all)\b", bare, re.I) else (found[1].lower(), "1" if bare.strip() == "*" else found[2])


def range_frame(df: DataFrame, order_by: str, below: float, above: float, aggregates: dict[str, str], rows_per_range: int = 500_000) -> DataFrame:
    """Add aggregates (SQL text, such as ``sum(price)``) over all rows whose ``order_by`` value lies within ``below`` under and ``above`` over the row's own.

    Rows without a value share a frame of their own. Equal values have equal frames and are aggregated once. ``count``,
    ``sum``, ``min`` and ``max`` take one step per value, however many rows a frame holds (``_by_cells``); any other
    aggregate goes through each frame row by row.
    """
    if not is_numeric(df, order_by):
        raise TypeError("the order of a value range must be a number")
    _fresh(df, aggregates)
    if below + above < 0:
        raise ValueError("the frame ends before it begins")
    # a frame of no width beside its row holds one other value
    simple = {n: found for n, a in aggregates.items() if (found := _simple(a)) and (below + above > 0 or not below)}
    others = {n: a for n, a in aggregates.items() if n not in simple}
    out = _by_rows(df, order_by, below, above, others, rows_per_range) if others else df
    out = _by_cells(out, order_by, below, above, simple, rows_per_range) if simple else out
    return out.select(*[col(c) for c in [*df.columns, *aggregates]])


def _by_cells(df: DataFrame, order_by: str, below: float, above: float, aggregates: dict[str, tuple[str, str]], rows_per_range: int) -> DataFrame:
    """Aggregates of frames from running ones: values are cut into cells narrower than a frame, so a frame is the end of
    one cell, the start of a later one and the whole cells between.

    The width is a power of two, which divides without rounding. A cell of many rows is cut into ranges, over which
    a summary carries what comes before and after.
    """
    value, cell, at, side, part, answer = spare_names(df, "value", "cell", "at", "side", "part", "answer")
    states = spare_names(df, *[f"state{i}" for i in range(len(aggregates))])
    wanted = dict(zip(states, aggregates.values()))
    merge = {s: MERGED[kind] for s, (kind, _) in wanted.items()}
    keyed = df.withColumn(value, col(order_by).cast("double"))
    grouped = keyed.groupBy(value).agg(*[F.expr(f"{kind}({argument})").alias(s) for s, (kind, argument) in wanted.items()])
    # beyond, distances vanish in rounding: such values reach only themselves, as do null, NaN and the infinite
    reaching = F.abs(F.col(value)) < 2.0**56 * (abs(below) + abs(above))
    rows, greatest = keyed.agg(F.count("*"), F.max(F.when(reaching, F.abs(F.col(value))))).first()
    if greatest is None:
        answers = grouped.select(F.col(value).alias(answer), *states)
    else:
        # sums of values and distances are rounded; half the width is narrow enough whatever that amounts to
        width = below + above
        width = 2.0 ** (math.frexp(max(width / 2, width - (greatest + abs(below) + abs(above)) * 2.0**-50))[1] - 1)
        place = lambda x: F.rint(x / F.lit(width))
        low, high = F.col(value) - F.lit(float(below)), F.col(value) + F.lit(float(above))
        between = (place(high) - place(low)).cast("int")
        # beyond 2 ** 53 not every whole number is a double, nor a cell
        inner = F.when(between > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), between - 1), lambda i: place(low) + i))).otherwise(F.array())
        inner = F.filter(inner, lambda c: (c > place(low)) & (c < place(high)))
        blank = [F.lit(None).cast(grouped.schema[s].dataType).alias(s) for s in states]
        point = lambda c, x, k, held: F.struct(c.alias(cell), x.alias(at), F.lit(k).alias(side), *held)
        points = F.concat(
            F.array(point(place(F.col(value)), F.col(value), 0, [F.col(s) for s in states]), point(place(high), high, 1, blank)),
            F.when(between > 0, F.array(point(place(low), low, -1, blank))).otherwise(F.array()),
            F.transform(inner, lambda c: point(c, (c + 1) * width, 1, blank)))
        largest = keyed.where(reaching).groupBy(place(F.col(value)).alias(cell)).count().agg(F.max("count")).first()[0]
        cut = largest > rows_per_range
        grouped = settled(grouped) if cut else grouped
        spread = grouped.where(reaching).select(value, F.inline(points))
        if cut:
            key = lambda c: F.struct(c.alias("k0"))
            bounds = range_bounds(keyed.where(reaching).select(key(F.col(value)).alias("key")), "key", min(COARSE, -(-rows // rows_per_range)), rows)
            spread = spread.withColumn(part, range_bucket(key(F.col(at)), bounds))
        else:
            spread = spread.withColumn(part, F.lit(0))
        parts = Window.partitionBy(cell, part)
        up = parts.orderBy(F.col(at), F.col(side)).rowsBetween(Window.unboundedPreceding, 0)
        down = parts.orderBy(F.col(at).desc(), F.col(side).desc()).rowsBetween(Window.unboundedPreceding, 0)
        held = spread.select(value, cell, part, side, *[F.when(F.col(side) > 0, f(s).over(up)).otherwise(f(s).over(down)).alias(s) for s, f in merge.items()])
        held = held.where(F.col(side) != 0)
        if cut:
            # a bound parts one cell, so cells of several ranges have at most two rows per bound here
            sums = spread.groupBy(cell, part).agg(*[f(s).alias(s) for s, f in merge.items()])
            sums = settled(sums.withColumn(at, F.count("*").over(Window.partitionBy(cell))).where(F.col(at) > 1))
            ways = [(k, Window.partitionBy(cell).orderBy(o).rowsBetween(Window.unboundedPreceding, -1)) for k, o in ((1, F.asc(part)), (-1, F.desc(part)))]
            earlier, later = (sums.select(cell, part, F.lit(k).alias(side), *[f(s).over(w).alias(s) for s, f in merge.items()]) for k, w in ways)
            sums = earlier.unionByName(later)
            carried = spread.where(F.col(side) != 0).select(value, cell, part, side).join(F.broadcast(sums), [cell, part, side])
            held = held.select(value, *states).unionByName(carried.select(value, *states))
        answers = held.groupBy(F.col(value).alias(answer)).agg(*[f(s).alias(s) for s, f in merge.items()])
        answers = answers.unionByName(grouped.where(~F.coalesce(reaching, F.lit(False))).select(F.col(value).alias(answer), *states))
    kinds = df.agg(*[F.expr(f"{kind}({argument})").alias(n) for n, (kind, argument) in aggregates.items()]).schema
    made = [(F.coalesce(s, F.lit(0)) if aggregates[n][0] == "count" else F.col(s)).cast(kinds[n].dataType).alias(n) for n, s in zip(aggregates, states)]
    return keyed.join(answers, F.col(value).eqNullSafe(F.col(answer)), "left").select(*[col(c) for c in df.columns], *made)


def _by_rows(df: DataFrame, order_by: str, below: float, above: float, aggregates: dict[str, str], rows_per_range: int) -> DataFrame:
    """A range of values borrows from its neighbours the rows that its frames reach; frames wider than a range borrow from several."""
    value, own, home = spare_names(df, "value", "own", "home")
    keyed = df.withColumn(value, col(order_by).cast("double"))
    rows = df.count()
    key = lambda c: F.struct(c.alias("k0"))
    bounds = range_bounds(keyed.where(F.col(value).isNotNull()).select(key(F.col(value)).alias("key")), "key", max(1, -(-rows // rows_per_range)), rows)
    first, last = (range_bucket(key(F.col(value) + s), bounds) for s in (-above, below))
    at = range_bucket(key(F.col(value)), bounds)
    homes = F.when(F.col(value).isNull(), F.array(F.lit(-1))).otherwise(F.array_union(F.sequence(first, last), F.array(at)))
    spread = keyed.withColumn(own, F.coalesce(F.when(F.col(value).isNotNull(), at), F.lit(-1))).withColumn(home, F.explode(homes))
    frame = f"OVER (PARTITION BY `{home}` ORDER BY `{value}` RANGE BETWEEN {float(below)}D PRECEDING AND {float(above)}D FOLLOWING)"
    framed = spread.withColumns({n: F.expr(f"{a} {frame}") for n, a in aggregates.items()})
    return framed.where(F.col(home) == F.col(own)).select(*[col(c) for c in [*df.columns, *aggregates]])
