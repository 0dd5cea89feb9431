"""Exact k nearest neighbours as a partitioned join.

Training rows are assigned to the nearest of some pivot rows. A query row first gets
an upper bound of its k-th distance from a small sample of training rows; by the
triangle inequality only cells that can hold something nearer are visited. Query rows
of near cells make up parts of bounded size. A task holds one part and reads the cells
that some row of it visits, a batch at a time, keeping the k nearest of each row: a
training row is sent once per part, and k rows per query row leave the task.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

# the small helpers below travel with the tasks, so executors need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# a part has at most so many rows, and so many numbers, whatever the length of a vector and k
CHUNK_ROWS, CHUNK_VALUES, LEAST_ROWS, LEAST_PROBES, BLOCK = 60_000, 6_000_000, 1_000, 1_000, 256
# bounds are compared with far more room than products of matrices round by, and squares that vanish
ROOM, TINY = 1e-7, 1e-150
NONE = np.iinfo("int64").max


def distances(a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    """All Minkowski distances between two small blocks of rows, a few rows at a time."""
    out = np.empty((len(a), len(b)))
    step = max(1, 1_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        d = np.abs(a[i:i + step, None, :] - b[None, :, :])
        if p == 2:
            out[i:i + step] = np.sqrt((d * d).sum(axis=2))
        else:
            out[i:i + step] = d.max(axis=2) if math.isinf(p) else (d ** p).sum(axis=2) ** (1 / p)
    return out


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All Euclidean distances by one product of matrices; what it cannot tell, as near points, is compared directly."""
    middle = b.mean(axis=0)
    x, y = a - middle, b - middle
    size = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :]
    squares = size - 2 * (x @ y.T)
    if not np.isfinite(squares).all():
        return distances(a, b, 2)
    row, at = np.nonzero(squares <= 1e-6 * size)
    out = np.sqrt(np.maximum(squares, 0))
    out[row, at] = _paired(a, b, row, at)
    return out


def _paired(a: np.ndarray, b: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Euclidean distances of some pairs, as ``distances`` gives them, a few at a time."""
    out, step = np.empty(len(row)), max(1, 1_000_000 // max(1, a.shape[1]))
    for i in range(0, len(row), step):
        d = a[row[i:i + step]] - b[at[i:i + step]]
        out[i:i + step] = np.sqrt((d * d).sum(axis=1))
    return out


def closest(a: np.ndarray, b: np.ndarray, k: int, p: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``b`` of the k nearest to each row of ``a``, and their distances; ties go to the earlier position.

    Plain distances are first bounded by a product of matrices; only pairs it cannot rule out are compared.
    """
    k = min(k, len(b))
    if p == 2 and k < len(b):
        middle = b.mean(axis=0)
        x, y = a - middle, b - middle
        length = (y * y).sum(axis=1)
        rough = length[None, :] - 2 * (x @ y.T)
        if np.isfinite(rough).all():
            # far above the rounding of such a product
            slack = 1e-9 * ((x * x).sum(axis=1) + length.max())
            kth = np.partition(rough, k - 1, axis=1)[:, k - 1]
            row, at = np.nonzero(rough <= (kth + slack)[:, None])
            d = _paired(a, b, row, at)
            order = np.lexsort((at, d, row))
            first = np.searchsorted(row, np.arange(len(a)))
            chosen = order[first[:, None] + np.arange(k)[None, :]]
            return at[chosen], d[chosen]
    d = distances(a, b, p)
    best = np.argsort(d, axis=1, kind="stable")[:, :k]
    return best, np.take_along_axis(d, best, axis=1)


def _matrix(values: pa.Array) -> np.ndarray:
    length = pc.min_max(pc.list_value_length(values)).as_py()
    if values.null_count or length["min"] != length["max"]:
        raise ValueError("points need values, as many for each")
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), length["max"] or 0)


def nearest(train: DataFrame, queries: DataFrame, k: int, p: float = 2.0, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows (query, neighbor, distance, rank) for ``train(id, x, ...)`` and ``queries(id, x)``.

    ``x`` is an array of doubles and ids are unique among the queries. Further training
    columns come along. Ties in distance go to the smaller training id. Rows with a value
    that is no finite number have no neighbours and are none.
    """
    if p < 1:
        raise ValueError("distances need p >= 1")
    spark, n_train = queries.sparkSession, train.count()
    k = min(k, n_train)
    id_type, query_type = (dict(d.dtypes)["id"] for d in (train, queries))
    extra = [c for c in train.columns if c not in ("id", "x")]
    extra_types = "".join(f", {c} {dict(train.dtypes)[c]}" for c in extra)
    # cells grow with the square root of the table; the sample decides which are visited, never results
    n_pivots = max(1, math.isqrt(n_train) // 4)
    share = 1.2 * max(LEAST_PROBES, n_pivots) / max(1, n_train)
    ids = train.select("x") if share >= 1 else train.select("x").sample(False, share, 11)
    seeds = sorted((r["x"] for r in ids.collect()), key=lambda x: hash(tuple(x)))
    probes = np.array(seeds, dtype="float64").reshape(len(seeds), -1 if seeds else 0)
    width = probes.shape[1]
    probes = probes[np.isfinite(probes).all(axis=1)]
    pivots = probes[:n_pivots] if len(probes) else np.zeros((1, width))

    def place(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("x"))
            known = np.isfinite(x).all(axis=1)
            b, x = b.filter(pa.array(known)), x[known]
            if len(x):
                own = [pa.array(c) for c in _own(x, pivots, p)]
                yield pa.RecordBatch.from_arrays([*b.columns, *own], [*b.schema.names, "__cell", "__away"])

    cells = train.select("x").mapInArrow(place, "x array<double>, __cell int, __away double").groupBy("__cell").agg(
        F.min("__away").alias("low"), F.max("__away").alias("high")).collect()
    own = queries.select("x").mapInArrow(place, "x array<double>, __cell int, __away double").groupBy("__cell").count().collect()
    if not (cells and own):
        return spark.createDataFrame(
            [], f"query {query_type}, neighbor {id_type}{extra_types}, distance double, rank int")
    number = np.array([r["__cell"] for r in cells])
    low, high = np.zeros(len(pivots)), np.zeros(len(pivots))
    low[number], high[number] = [r["low"] for r in cells], [r["high"] for r in cells]

    # query rows in the order of their cells, each next to a near one, are cut into parts of one size
    asked, first = np.zeros(len(pivots)), np.zeros(len(pivots))
    asked[[r["__cell"] for r in own]] = [r["count"] for r in own]
    chain = _chain(pivots, p)
    first[chain] = np.cumsum(asked[chain]) - asked[chain]
    n_parts = _parts(int(asked.sum()), min(chunk_rows, max(1, CHUNK_VALUES // (width + 8 * k))),
                     spark.sparkContext.defaultParallelism)
    size = asked.sum() / n_parts

    def route(batches):
        for b in place(batches):
            x, cell = _matrix(b.column("x")), b.column("__cell").to_numpy()
            part = (first[cell] + b.column("__spread").to_numpy() * asked[cell]) // size
            yield b, x, np.minimum(part, n_parts - 1).astype("int32"), _kth_bound(x, probes, k, p)

    def visit(batches):
        for b, x, part, bound in route(batches):
            away, pairs = b.column("__away").to_numpy(), np.zeros((n_parts, len(pivots)), dtype=bool)
            for i in range(0, len(x), BLOCK):
                s = slice(i, i + BLOCK)
                there = _apart(x[s], pivots[number], p)
                row, at = np.nonzero(_may_be_near(there, away[s, None], low[number], high[number], bound[s, None]))
                pairs[part[s][row], number[at]] = True
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in np.nonzero(pairs)], ["__part", "__cell"])

    def bounded(batches):
        for b, _, part, bound in route(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part), pa.array(bound)],
                                             [*b.schema.names, "__part", "__bound"])

    spread = (F.pmod(F.xxhash64("id", "x"), F.lit(1 << 30)) / float(1 << 30)).alias("__spread")
    visits = queries.select("x", spread).mapInArrow(visit, "__part int, __cell int").distinct()
    asks = queries.select("id", "x", spread).mapInArrow(
        bounded, f"id {query_type}, x array<double>, __spread double, __cell int, __away double, __part int, __bound double")
    # the place of a row in the order of the ids decides ties
    placed = train.select("id", "x", *extra).orderBy(F.asc_nulls_last("id")).withColumn(
        "__at", F.monotonically_increasing_id()).mapInArrow(
        place, f"id {id_type}, x array<double>{extra_types}, __at bigint, __cell int, __away double")
    left = placed.join(F.broadcast(visits), "__cell").select(
        "__part", "__cell", "__at", "x", "__away", F.lit(None).cast("double").alias("__bound"),
        F.lit(None).cast(query_type).alias("__query"), F.col("id").alias("__id"), *extra)
    right = asks.select(
        "__part", F.lit(-1).alias("__cell"), F.lit(0).cast("bigint").alias("__at"), "x", "__away", "__bound",
        F.col("id").alias("__query"), F.lit(None).cast(id_type).alias("__id"),
        *[F.lit(None).cast(dict(train.dtypes)[c]).alias(c) for c in extra])

    def compare(batches):
        best, now = None, None
        for b in batches:
            part, cell = b.column("__part").to_numpy(), b.column("__cell").to_numpy()
            cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(cell) != 0)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(part)]):
                if j == i:
                    continue
                if part[i] != now:
                    if best:
                        yield from best.found(["__id", *extra], ["query", "neighbor", *extra, "distance"])
                    best, now = _Nearest(k, p), part[i]
                c, rows = int(cell[i]), b.slice(i, j - i)
                if c < 0:
                    best.ask(rows)
                else:
                    best.compare(rows, c, pivots[c], low[c], high[c], ["__id", *extra])
        if best:
            yield from best.found(["__id", *extra], ["query", "neighbor", *extra, "distance"])

    near = left.unionByName(right).repartitionById(n_parts, F.col("__part")).sortWithinPartitions(
        "__part", "__cell", "__at").mapInArrow(compare, f"query {query_type}, neighbor {id_type}{extra_types}, distance double")
    order = Window.partitionBy("query").orderBy("distance", "neighbor")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _parts(rows: int, most: int, tasks: int) -> int:
    """Into how many parts rows are cut: bounded ones, enough for all tasks, in full rounds of them."""
    n = max(math.ceil(rows / most), min(2 * tasks, math.ceil(rows / LEAST_ROWS)))
    return n if n <= tasks else math.ceil(n / tasks) * tasks


def _chain(x: np.ndarray, p: float) -> list[int]:
    """Positions of all rows, each followed by the nearest one left."""
    out, left = [0], np.arange(1, len(x))
    while len(left):
        i = distances(x[out[-1]][None], x[left], p)[0].argmin()
        out.append(int(left[i]))
        left = np.delete(left, i)
    return out


def _apart(x: np.ndarray, others: np.ndarray, p: float) -> np.ndarray:
    """All distances to a few other rows, within ROOM."""
    out, some = np.empty((len(x), len(others))), euclidean if p == 2 else lambda a, b: distances(a, b, p)
    for i in range(0, len(x), BLOCK):
        out[i:i + BLOCK] = some(x[i:i + BLOCK], others)
    return out


def _own(x: np.ndarray, pivots: np.ndarray, p: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each row, the first of equal ones, and its distance; the same whatever rows stand beside it."""
    cell, away = np.empty(len(x), dtype="int32"), np.empty(len(x))
    for i in range(0, len(x), BLOCK):
        rough = _apart(x[i:i + BLOCK], pivots, p)
        row, at = np.nonzero(~(rough > rough.min(axis=1, keepdims=True) * (1 + ROOM) + TINY))
        d = _paired(x[i:i + BLOCK], pivots, row, at) if p == 2 else rough[row, at]
        order = np.lexsort((at, d, row))
        best = order[np.searchsorted(row, np.arange(len(rough)))]
        cell[i:i + BLOCK], away[i:i + BLOCK] = at[best], d[best]
    return cell, away


def _may_be_near(there, away, low, high, bound):
    """Whether a cell, ``there`` away, can hold a row within the bound of one that is ``away`` from its own pivot; also if unknown."""
    least = np.maximum(np.maximum(there - high, low - there), (there - away) / 2)
    return ~(least > bound + ROOM * (bound + there + high) + TINY)


def _kth_bound(x: np.ndarray, probes: np.ndarray, k: int, p: float) -> np.ndarray:
    """Distance within which each row surely has k training rows."""
    if len(probes) < k:
        return np.full(len(x), np.inf)
    out = np.empty(len(x))
    for i in range(0, len(x), BLOCK):
        out[i:i + BLOCK] = np.partition(_apart(x[i:i + BLOCK], probes, p), k - 1, axis=1)[:, k - 1]
    return out * (1 + ROOM) + TINY


class _Nearest:
    """The k nearest so far of each query row of a part, while training rows come in batches."""

    def __init__(self, k: int, p: float):
        self.k, self.p, self.asked, self.x = k, p, [], None
        self.kept, self.places, self.n_kept = [], [], 0

    def ask(self, rows: pa.RecordBatch) -> None:
        self.asked.append(rows)

    def _begin(self) -> None:
        self.x = np.concatenate([_matrix(b.column("x")) for b in self.asked])
        self.away, self.limit = (np.concatenate([b.column(c).to_numpy() for b in self.asked]) for c in ("__away", "__bound"))
        self.query = pa.concat_arrays([b.column("__query") for b in self.asked])
        self.asked = []
        # what is not found yet sorts behind all else
        self.d, self.at = np.full((len(self.x), self.k), np.nan), np.full((len(self.x), self.k), NONE)

    def compare(self, rows: pa.RecordBatch, cell: int, pivot: np.ndarray, low: float, high: float, names: list[str]) -> None:
        """Training rows of one cell in the order of their places."""
        if self.x is None:
            self._begin()
        y = _matrix(rows.column("x"))
        few = _few_copies(y, self.k)
        y, at = y[few], rows.column("__at").to_numpy()[few]
        there = distances(self.x, pivot[None], self.p)[:, 0]
        near = np.flatnonzero(_may_be_near(there, self.away, low, high, self.limit))
        block, used, within = max(1, 500_000 // len(y)), np.zeros(len(y), dtype=bool), _Within(y, self.k, self.p)
        for i in range(0, len(near), block):
            r = near[i:i + block]
            row, found, d = within(self.x[r], self.limit[r])
            if len(row):
                used[found[self._merge(r, row, at[found], d)]] = True
        if used.any():
            self._keep([rows.select(names).take(pa.array(few[used]))], [at[used]])

    def _merge(self, rows: np.ndarray, row: np.ndarray, at: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Take what is nearer than before; the positions of what was taken."""
        hit, who = np.unique(row, return_inverse=True)
        rows, before = rows[hit], len(hit) * self.k
        who = np.concatenate([np.repeat(np.arange(len(hit)), self.k), who])
        d, at = np.concatenate([self.d[rows].ravel(), d]), np.concatenate([self.at[rows].ravel(), at])
        order = np.lexsort((at, d, who))
        best = order[np.searchsorted(who[order], np.arange(len(hit)))[:, None] + np.arange(self.k)[None, :]]
        self.d[rows], self.at[rows] = d[best], at[best]
        self.limit[rows] = np.fmin(self.limit[rows], self.d[rows, -1])
        return best[best >= before] - before

    def _keep(self, batches: list[pa.RecordBatch], places: list[np.ndarray]) -> None:
        self.kept, self.places = self.kept + batches, self.places + places
        self.n_kept += sum(map(len, places))
        if self.n_kept > 4 * self.at.size + 10_000:
            table, places = self._all_kept()
            needed = np.flatnonzero(np.isin(places, self.at))
            self.kept, self.places = table.take(pa.array(needed)).combine_chunks().to_batches(), [places[needed]]
            self.n_kept = len(needed)

    def _all_kept(self) -> tuple[pa.Table, np.ndarray]:
        return pa.Table.from_batches(self.kept), np.concatenate(self.places)

    def found(self, names: list[str], out_names: list[str]):
        if not self.kept:
            return
        table, places = self._all_kept()
        by_place = np.argsort(places)
        step = max(1, 20_000 // self.k)
        for i in range(0, len(self.x), step):
            row, rank = np.nonzero(self.at[i:i + step] != NONE)
            lines = by_place[np.searchsorted(places, self.at[i:i + step][row, rank], sorter=by_place)]
            near = table.take(pa.array(lines)).combine_chunks()
            columns = [self.query.take(pa.array(row + i)), *[pa.concat_arrays(near.column(c).chunks) if len(row) else
                       pa.array([], near.schema.field(c).type) for c in names], pa.array(self.d[i:i + step][row, rank])]
            yield pa.RecordBatch.from_arrays(columns, out_names)


class _Within:
    """Pairs of rows of ``a`` and ``y`` that may be among the k nearest, no farther apart than the limit of the row of ``a``.

    A product of matrices in single precision, less all it can be wrong by, rules out most; the others are compared directly.
    """

    def __init__(self, y: np.ndarray, k: int, p: float):
        self.y, self.k, self.p, self.middle = y, k, p, y.mean(axis=0)
        z = y - self.middle
        self.scale = np.abs(z).max(initial=0) or 1.0
        self.plain = p == 2 and bool(np.isfinite(self.scale))
        z = z / self.scale
        # a sum of so many terms rounds by less than this share of the squares
        self.less = 1 - (y.shape[1] + 8) * 2 * float(np.finfo("float32").eps)
        self.z = np.concatenate([-2 * z, (z * z).sum(axis=1, keepdims=True) * self.less], axis=1).astype("float32").T

    def __call__(self, a: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.plain:
            x = (a - self.middle) / self.scale
            length = (x * x).sum(axis=1)
            cut = ((limit + TINY) / self.scale) ** 2 - length * self.less + 1e-30
            if (length < 1e30).all() and (np.abs(cut) < 1e30).all():
                rough = np.concatenate([x, np.ones((len(x), 1))], axis=1).astype("float32") @ self.z
                cut = np.nextafter(cut.astype("float32"), np.float32(np.inf))
                row, at = np.divmod(_true(rough <= cut[:, None]), len(self.y))
                d = _paired(a, self.y, row, at)
                good = np.flatnonzero(d <= limit[row])
                return row[good], at[good], d[good]
        best, d = closest(a, self.y, self.k, self.p)
        return np.repeat(np.arange(len(a)), best.shape[1]), best.ravel(), d.ravel()


def _true(marks: np.ndarray) -> np.ndarray:
    """Flat positions of the few true values, found eight at a time."""
    marks = marks.ravel()
    whole = len(marks) // 8 * 8
    near = (np.flatnonzero(marks[:whole].view("uint64"))[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([near[marks[near]], whole + np.flatnonzero(marks[whole:])])


def _few_copies(x: np.ndarray, k: int) -> np.ndarray:
    """Positions of all rows but, of equal ones, the first k only."""
    if not x.shape[1] or np.unique(x[:, 0], return_counts=True)[1].max() <= k:
        return np.arange(len(x))
    rows = np.ascontiguousarray(x).view(f"V{x.itemsize * x.shape[1]}").ravel()
    _, which, n = np.unique(rows, return_inverse=True, return_counts=True)
    order = np.argsort(which, kind="stable")
    nth = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
    return np.sort(order[nth < k])


class _Neighbors:
    def __init__(self, train: DataFrame, params: dict):
        self.k, self.p = int(params.get("n_neighbors", 5)), float(params.get("p", 2))
        self.weights = params.get("weights", "uniform")
        if self.weights not in ("uniform", "distance"):
            raise ValueError(f"unknown weights {self.weights!r}")
        if params.get("metric", "minkowski") == "manhattan":
            self.p = 1.0
        if params.get("metric", "minkowski") == "chebyshev":
            self.p = math.inf
        self.train = train.select(_row_id(train).alias("id"), vector_to_array("features").alias("x"), "label")

    def _near(self, points: DataFrame) -> DataFrame:
        near = nearest(self.train, points, self.k, self.p)
        if self.weights == "uniform":
            return near.withColumn("w", F.lit(1.0))
        # with a neighbour at distance zero only such neighbours count
        touching = F.max(F.col("distance") == 0).over(Window.partitionBy("query"))
        inverse = F.try_divide(F.lit(1.0), F.col("distance"))
        return near.withColumn("w", F.when(touching, (F.col("distance") == 0).cast("double")).otherwise(inverse))

    def transform(self, df: DataFrame) -> DataFrame:
        """Equal points have equal neighbours, so each distinct point is searched once."""
        named = df.withColumn("__id", _row_id(df, ["features"]))
        points = named.select(F.col("__id").alias("id"), vector_to_array("features").alias("x")).dropDuplicates(["id"])
        scored = self._decide(self._near(points)).withColumnRenamed("query", "__id")
        return named.join(scored, "__id", "left").drop("__id")


def _row_id(df: DataFrame, names: list[str] | None = None):
    """A 128-bit hash of the row as text, the same whenever the row is computed again."""
    values = [vector_to_array(c) if c == "features" else F.col(f"`{c}`") for c in (names or df.columns)]
    return F.concat(F.hex(F.xxhash64(F.lit(1), *values)), F.lit("-"), F.hex(F.xxhash64(F.lit(2), *values)))


class NeighborRegressor(_Neighbors):
    def _decide(self, near: DataFrame) -> DataFrame:
        return near.groupBy("query").agg((F.sum(F.col("w") * F.col("label")) / F.sum("w")).alias("prediction"))


class NeighborClassifier(_Neighbors):
    """The label with most weight, the smaller one on a tie."""

    def _decide(self, near: DataFrame) -> DataFrame:
        votes = near.groupBy("query", "label").agg(F.sum("w").alias("w"))
        best = F.max_by("label", F.struct("w", (-F.col("label")).alias("order")))
        return votes.groupBy("query").agg(best.alias("prediction"))
