"""Density clustering on a grid of cells whose diagonal is eps.

Points of one cell are all within eps of each other, so a cell with min_samples
points is all core and needs no comparisons; other cells hold fewer points than
that, which keeps every comparison join linear in the table. Whether two dense
cells touch is decided on boxes of ever finer sub-cells, never on their points.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.checkpoints import settled
from ..functions.ordering import INDEX, bucketed, with_row_index

MAX_DIMENSIONS, NOISE = 6, -1
HOT_CELL_ROWS = 50_000
FEW_PAIRS = 10_000_000


def _sorted(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the table. Sizes are guessed from packed files and before rows are exploded; by
    such a guess whole tables of cells and points were sent through the driver."""
    return df.hint("merge")


def _squares(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda t, d: t + d)


def _offsets(d: int, reach: int) -> Column:
    """Offsets of the cells that can hold points within eps, the cell itself included."""
    found = [o for o in itertools.product(range(-reach, reach + 1), repeat=d)
             if sum(max(0, abs(s) - 1) ** 2 for s in o) <= d]
    return F.array(*[F.array(*[F.lit(s).cast("bigint") for s in o]) for o in found])


def _around(offsets: Column) -> Column:
    return F.transform(offsets, lambda o: F.zip_with(F.col("cell"), o, lambda c, s: c + s))


def dbscan(df: DataFrame, params: dict) -> DataFrame:
    """``df(id, x)`` with unique ids and coordinate arrays; adds ``prediction`` and ``core``.

    Clusters are numbered by their smallest core id; a border point joins the lowest
    numbered cluster in reach; noise is -1.
    """
    eps, least = float(params.get("eps", 0.5)), int(params.get("min_samples", 5))
    if params.get("metric", "euclidean") != "euclidean" or float(params.get("p") or 2) != 2:
        raise ValueError("only Euclidean distance is offered")
    first = df.select(F.size("x")).first()
    d = first[0] if first else 1
    if d > MAX_DIMENSIONS:
        raise ValueError(f"density clustering takes at most {MAX_DIMENSIONS} dimensions")
    side = eps / math.sqrt(d) * (1 - 1e-12)
    points = df.select("id", "x", F.transform("x", lambda v: F.floor(v / F.lit(side))).alias("cell"))
    offsets = _offsets(d, math.ceil(math.sqrt(d)))
    counts = points.groupBy("cell").agg(F.count(F.lit(1)).alias("held"))
    points = settled(points.join(_sorted(counts), "cell"))
    dense, sparse = points.filter(F.col("held") >= least), points.filter(F.col("held") < least)

    found = _pairs(sparse, points, offsets, eps).groupBy("id").agg(F.count(F.lit(1)).alias("near"))
    sparse_core = sparse.join(_sorted(found.filter(F.col("near") >= least).select("id")), "id", "left_semi")
    core = settled(dense.unionByName(sparse_core).select("id", "x", "cell", "held"))

    edges = _sparse_edges(core, least, offsets, eps).unionByName(_dense_edges(core, least, offsets, eps, side))
    labels = _components(core.select("cell").distinct(), edges)
    labelled = core.join(_sorted(labels), "cell").select("id", "x", "cell", "held", "component")
    firsts = labelled.groupBy("component").agg(F.min("id").alias("first"))
    numbered = with_row_index(bucketed(firsts, "first")).select("component", F.col(INDEX).cast("int").alias("prediction"))
    labelled = settled(labelled.join(_sorted(numbered), "component").drop("component"))

    others = sparse.join(_sorted(labelled.select("id")), "id", "left_anti")
    border = _pairs(others, labelled, offsets, eps, ["prediction"]).groupBy("id").agg(F.min("prediction").alias("prediction"))
    rest = others.join(_sorted(border), "id", "left").select("id", F.coalesce("prediction", F.lit(NOISE)).alias("prediction"), F.lit(False).alias("core"))
    settled_points = labelled.select("id", "prediction", F.lit(True).alias("core")).unionByName(rest)
    return df.join(_sorted(settled_points), "id")


def _pairs(few: DataFrame, many: DataFrame, offsets: Column, eps: float, carry: list[str] | None = None) -> DataFrame:
    """Pairs within eps of ``few`` (under min_samples per cell) and ``many``.

    A crowded cell of ``many`` is spread over parts, and what visits it is copied to each.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("held") / HOT_CELL_ROWS)).cast("int")
    crowd = many.select(F.col("id").alias("other"), F.col("x").alias("y"), "cell", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"),
                        *(carry or []))
    shares = many.groupBy("cell").agg(F.max(parts).alias("parts"))
    visits = few.select("id", "x", F.explode(_around(offsets)).alias("cell")).join(_sorted(shares), "cell")
    visits = visits.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    near = visits.join(_sorted(crowd), ["cell", "part"]).filter(_squares(F.col("x"), F.col("y")) <= F.lit(eps * eps))
    return near.select("id", "other", *(carry or []))


def _sparse_edges(core: DataFrame, least: int, offsets: Column, eps: float) -> DataFrame:
    """Links from cells with few points to any neighbouring cell."""
    few = core.filter(F.col("held") < least)
    home = few.select("id", F.col("cell").alias("a"))
    near = _pairs(few, core.withColumn("b", F.col("cell")), offsets, eps, ["b"])
    return near.join(_sorted(home), "id").select("a", "b").filter(F.col("a") != F.col("b")).distinct()


def _dense_edges(core: DataFrame, least: int, offsets: Column, eps: float, side: float) -> DataFrame:
    """Links between dense neighbouring cells, found by narrowing boxes."""
    dense = core.filter(F.col("held") >= least)
    cells = dense.select("cell").distinct()
    pairs = cells.select(F.col("cell").alias("a"), F.explode(_around(offsets)).alias("b"))
    pairs = pairs.filter(F.col("a") < F.col("b")).join(_sorted(cells.select(F.col("cell").alias("b"))), "b", "left_semi")
    open_pairs = pairs.select("a", "b", F.col("a").alias("sa"), F.col("b").alias("sb"))
    linked, scale = None, side
    while True:
        boxes = _boxes(dense, open_pairs, scale)
        left = boxes.select(F.col("cell").alias("a"), F.col("parent").alias("sa"), F.col("sub").alias("ca"),
                            F.col("lo").alias("alo"), F.col("hi").alias("ahi"), F.col("n").alias("na"))
        right = boxes.select(F.col("cell").alias("b"), F.col("parent").alias("sb"), F.col("sub").alias("cb"),
                             F.col("lo").alias("blo"), F.col("hi").alias("bhi"), F.col("n").alias("nb"))
        judged = open_pairs.join(_sorted(left), ["a", "sa"]).join(_sorted(right), ["b", "sb"]).select("a", "b", "ca", "cb", "na", "nb", *_reach())
        judged = settled(judged.filter(F.col("nearest") <= eps * eps))
        sure = judged.filter(F.col("farthest") <= eps * eps).select("a", "b").distinct()
        linked = sure if linked is None else linked.unionByName(sure)
        unsure = judged.join(_sorted(sure), ["a", "b"], "left_anti")
        work = unsure.agg(F.sum(F.col("na").cast("double") * F.col("nb"))).first()[0] or 0
        open_pairs, scale = unsure.select("a", "b", F.col("ca").alias("sa"), F.col("cb").alias("sb")), scale / 2
        if work <= FEW_PAIRS:
            return linked.unionByName(_compared(dense, open_pairs, eps, scale)).distinct() if work else linked.distinct()
        open_pairs = settled(open_pairs)


def _compared(dense: DataFrame, open_pairs: DataFrame, eps: float, scale: float) -> DataFrame:
    """Link cells by comparing the points of the sub-cells still open; their pairs were counted to be few."""
    sub = dense.select("cell", "x", F.transform("x", lambda v: F.floor(v / F.lit(scale))).alias("sub"))
    left = sub.select(F.col("cell").alias("a"), F.col("sub").alias("sa"), F.col("x"))
    right = sub.select(F.col("cell").alias("b"), F.col("sub").alias("sb"), F.col("x").alias("y"))
    near = open_pairs.join(_sorted(left), ["a", "sa"]).join(_sorted(right), ["b", "sb"])
    return near.filter(_squares(F.col("x"), F.col("y")) <= F.lit(eps * eps)).select("a", "b").distinct()


def _boxes(dense: DataFrame, open_pairs: DataFrame, scale: float) -> DataFrame:
    """Bounding boxes of the sub-cells at half the last size, within the sub-cells still open."""
    wanted = open_pairs.select(F.col("a").alias("cell")).unionByName(open_pairs.select(F.col("b").alias("cell"))).distinct()
    inside = dense.join(_sorted(wanted), "cell", "left_semi").select(
        "cell", "x", F.transform("x", lambda v: F.floor(v / F.lit(scale))).alias("parent"),
        F.transform("x", lambda v: F.floor(v / F.lit(scale / 2))).alias("sub"))
    return inside.groupBy("cell", "parent", "sub").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.array_compact(F.array(*[pick(F.get("x", F.lit(i))) for i in range(MAX_DIMENSIONS)])).alias(n)
          for n, pick in (("lo", F.min), ("hi", F.max))])


def _reach() -> list[Column]:
    """Squared least and greatest distances between two boxes."""
    gap = F.zip_with(F.zip_with("alo", "bhi", lambda u, v: u - v), F.zip_with("blo", "ahi", lambda u, v: u - v),
                     lambda u, v: F.greatest(u, v, F.lit(0.0)))
    span = F.zip_with(F.zip_with("ahi", "blo", lambda u, v: F.abs(u - v)), F.zip_with("bhi", "alo", lambda u, v: F.abs(u - v)),
                      lambda u, v: F.greatest(u, v))
    return [F.aggregate(c, F.lit(0.0), lambda t, s: t + s * s).alias(n) for n, c in (("nearest", gap), ("farthest", span))]


def _components(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components of cells: each takes the smallest cell it is linked to, until nothing moves.

    Alternating large-star and small-star steps (Kiveris et al. 2014) halve long chains.
    """
    links = settled(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        larger = _star(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))), only_larger=True)
        smaller = settled(_star(larger, only_larger=False))
        same = links.count() == smaller.count() and links.join(_sorted(smaller), ["u", "v"], "left_anti").isEmpty()
        links = smaller
        if same:
            break
    roots = links.groupBy(F.col("u").alias("cell")).agg(F.min("v").alias("component"))
    return cells.join(_sorted(roots), "cell", "left").select("cell", F.coalesce("component", "cell").alias("component"))


def _star(links: DataFrame, only_larger: bool) -> DataFrame:
    """Link the neighbours of each node to the smallest among them and the node itself."""
    least = links.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    joined = links.join(_sorted(least), "u")
    if only_larger:
        moved = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
    return moved.filter(F.col("u") != F.col("v")).distinct()
