"""Nearest neighbours by collision counting over single-projection sorted arrays (largest inner product)."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import stored

#: rows of one index block, under 2**16: its sorted arrays are searched together
BLOCK = 4096
#: projections of a block, fewer for shorter vectors; they are orthogonal
PROJECTIONS = 64
#: half-width of a window in radii
HALF_WIDTH = 1.0
#: by how much a radius grows from round to round
GROWTH = 1.25
#: a vector as near as the radius falls below the threshold with about this chance; nearer ones with less
MISS = 0.04
#: rows that give every query its first bound; all rows are indexed and searched
SEED_ROWS = 8192
#: share of a block's entries up to which new ones are counted one by one
WALKED = 1 / 16
#: bytes of query vectors searched in one pass
QUERY_BYTES = 32 << 20


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, not zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def directions(dims: int, seed: int = 5) -> np.ndarray:
    """Orthogonal vectors of ``dims`` components, as rows; a difference's projection spreads like its length."""
    rng = np.random.default_rng(seed)
    square = rng.normal(size=(dims, min(dims, PROJECTIONS)))
    return np.linalg.qr(square)[0].T * np.sqrt(dims)


def threshold(count: int, dims: int, miss: float = MISS) -> int:
    """Least number of ``count`` windows that a vector as near as the radius falls into, but for a chance of ``miss``.

    A window of half-width ``z`` radii holds one projection of such a difference with the normal chance ``p``; the
    squares of orthogonal projections have a fixed sum, which lowers the variance of their number.
    """
    z, normal = HALF_WIDTH, NormalDist()
    p = 2 * normal.cdf(z) - 1
    variance = count * (p * (1 - p) - count / dims * 2 * (z * normal.pdf(z)) ** 2)
    return max(1, int(np.floor(count * p + normal.inv_cdf(miss) * np.sqrt(max(variance, 0.25)))))


def inner(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added component by component: equal vectors get equal products."""
    return np.cumsum(rows * query, axis=1)[:, -1]


class Layer:
    """Vectors of a block whose norms lie within a factor of two, on the sphere of the greatest of these norms.

    One more component lifts every vector to that norm, so of two vectors that of the larger inner product with a
    query is the nearer one to the query's own direction.
    """

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, norms: np.ndarray) -> None:
        self.rows, self.radius = rows, float(norms.max())
        lifted = np.column_stack([vectors, np.sqrt(np.maximum(0, self.radius**2 - norms**2))])
        self.axes = directions(lifted.shape[1])
        places = lifted @ self.axes.T
        order = np.argsort(places, axis=0, kind="stable").T
        #: a sorted array for each projection, one after the other on one scale, and the rows in its order
        self.ends = places.min() - 1, places.max() + 1
        self.shift = (self.ends[1] - self.ends[0] + 1) * np.arange(len(order))
        self.values = (np.take_along_axis(places, order.T, axis=0).T + self.shift[:, None]).ravel()
        self.order = np.ascontiguousarray(order)
        #: place of each row in each array
        self.place = np.empty(order.shape, dtype=np.uint16)
        np.put_along_axis(self.place, order, np.arange(order.shape[1], dtype=np.uint16)[None, :], axis=1)
        self.least = threshold(len(self.axes), lifted.shape[1])

    def distance(self, product: float, length: float) -> float:
        """Radius that reaches all vectors of at least this inner product with a query of this length."""
        gap = 2 * self.radius**2 - 2 * self.radius * product / length
        return max(np.sqrt(max(0.0, gap)), 1e-6 * self.radius)

    def frequent(self, at: np.ndarray, radius: float, seen: tuple | None) -> tuple[tuple, np.ndarray]:
        """Virtual rehashing: windows around the query's projections grow to ``radius``.

        Returns the windows and counts for the next call and the rows that collide in at least the threshold's number
        of windows. What is new in narrow windows is walked through; for wide ones it is faster to ask every row's
        place in the array. Both count the same.
        """
        half, n, first = HALF_WIDTH * radius, len(self.rows), len(self.rows) * np.arange(len(self.order))
        low = np.searchsorted(self.values, np.clip(at - half, *self.ends) + self.shift) - first
        high = np.searchsorted(self.values, np.clip(at + half, *self.ends) + self.shift, "right") - first
        was = (low, low) if seen is None else seen[0]
        if (high - low).sum() - (was[1] - was[0]).sum() > WALKED * self.place.size:
            inside = self.place - low.astype(np.uint16)[:, None] < (high - low).astype(np.uint16)[:, None]
            counts = np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8)
        else:
            new = [part for o, a, b, c, d in zip(self.order, low, was[0], was[1], high) for part in (o[a:b], o[c:d])]
            counts = np.bincount(np.concatenate(new), minlength=n) + (0 if seen is None else seen[1])
        return ((low, high), counts), np.flatnonzero(counts >= self.least)


class Block:
    """Rows of one vector length with their index."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.known, self.vectors = ids, known, vectors
        self.scale = float(np.abs(vectors).max())
        scaled = vectors / self.scale
        norms = np.linalg.norm(scaled, axis=1)
        kind = np.frexp(norms)[1]
        self.layers = [Layer(np.flatnonzero(kind == k), scaled[kind == k], norms[kind == k]) for k in sorted(set(kind.tolist()), reverse=True)]

    def search(self, query: np.ndarray, best: "Best") -> None:
        """Offer every row found near the query, until the windows reach the radius of the worst of its best."""
        length = float(np.linalg.norm(query / np.abs(query).max()) * np.abs(query).max())
        for layer in self.layers:
            at = layer.axes[:, :-1] @ (query * (layer.radius / length))
            seen, offered, radius = None, np.zeros(len(layer.rows), dtype=bool), 0.0
            while True:
                wanted = layer.distance(best.bound / self.scale, length)
                if seen is not None and radius >= wanted:
                    break
                farthest = 2 * layer.radius
                radius = min(max(radius * GROWTH, wanted / GROWTH), wanted, farthest)
                if radius >= farthest:
                    found = np.arange(len(layer.rows))
                else:
                    seen, found = layer.frequent(at, radius, seen)
                found = found[~offered[found]]
                offered[found] = True
                rows = layer.rows[found]
                best.offer(rows, self, query)
                if radius >= farthest:
                    break


class Best:
    """The best rows of one query so far: inner product, id, whether the id is known and whether it is the query's own row."""

    def __init__(self, most: int, bound: float, query_id, query: np.ndarray) -> None:
        self.most, self.bound, self.query_id, self.query = most, bound, query_id, query
        self.score, self.ids, self.known, self.own = np.zeros(0), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool), np.zeros(0, dtype=bool)

    def offer(self, rows: np.ndarray, block: Block, query: np.ndarray) -> None:
        if not len(rows):
            return
        near = block.vectors[rows] @ query
        # the fast product may differ in its last digits
        margin = 1e-12 * float(np.abs(query).max()) * block.scale * len(query)
        rows = rows[near >= self.bound - margin]
        if not len(rows):
            return
        vectors = block.vectors[rows]
        score, ids, known = inner(vectors, query), block.ids[rows], block.known[rows]
        own = known & (ids == self.query_id) & (vectors == query).all(axis=1)
        self.score, self.ids, self.known, self.own = (np.concatenate(x) for x in ((self.score, score), (self.ids, ids), (self.known, known), (self.own, own)))
        order = np.lexsort((self.ids, ~self.known, -self.score))[:self.most]
        self.score, self.ids, self.known, self.own = (x[order] for x in (self.score, self.ids, self.known, self.own))
        if len(order) == self.most:
            self.bound = max(self.bound, float(self.score[-1]))


def _read(batch: pa.RecordBatch, ids: str, vectors: str):
    """Rows of a batch by vector length: ids, which of them are known, and the vectors."""
    lists = batch.column(vectors)
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.values.slice(lists.offsets[0].as_py(), int(sizes.sum())).cast(pa.float64()).to_numpy(zero_copy_only=False)
    begins = np.cumsum(sizes) - sizes
    known = batch.column(ids).is_valid().to_numpy(zero_copy_only=False)
    names = batch.column(ids).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield names[rows], known[rows], flat[begins[rows][:, None] + np.arange(size)]


def _blocks(batches):
    """Index blocks of up to ``BLOCK`` rows of one vector length, whatever the batches."""
    waiting: dict[int, list[tuple]] = {}

    def packed(parts: list[tuple]) -> pa.RecordBatch:
        ids, known, vectors = (np.concatenate(x) for x in zip(*parts))
        row = [len(ids), vectors.shape[1], ids.tobytes(), known.tobytes(), np.ascontiguousarray(vectors).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=["n", "dims", "ids", "known", "vectors"])
    for batch in batches:
        for ids, known, vectors in _read(batch, "id", "vector"):
            for begin in range(0, len(ids), BLOCK):
                parts = waiting.setdefault(vectors.shape[1], [])
                parts.append(tuple(x[begin:begin + BLOCK] for x in (ids, known, vectors)))
                if sum(len(p[0]) for p in parts) >= BLOCK:
                    ids_, known_, vectors_ = (np.concatenate(x) for x in zip(*parts))
                    yield packed([(ids_[:BLOCK], known_[:BLOCK], vectors_[:BLOCK])])
                    parts[:] = [(ids_[BLOCK:], known_[BLOCK:], vectors_[BLOCK:])] if len(ids_) > BLOCK else []
    for parts in waiting.values():
        if parts:
            yield packed(parts)


def _unpacked(row: dict) -> Block:
    return Block(np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["known"], dtype=bool),
                 np.frombuffer(row["vectors"]).reshape(row["n"], row["dims"]))


def _bounds(queries: np.ndarray, seeds: np.ndarray, most: int) -> np.ndarray:
    """For each query an inner product that at least ``most`` seed rows reach; without so many, none."""
    if len(seeds) < most:
        return np.full(len(queries), -np.inf)
    out = [np.partition(queries[k:k + 256] @ seeds.T, len(seeds) - most, axis=1)[:, len(seeds) - most] for k in range(0, len(queries), 256)]
    return np.concatenate(out)


def _searched(shared, most: int):
    """Every query of the pass against the blocks of a task: its best rows there, kept from block to block."""
    def searched(batches):
        found: dict[int, Best] = {}
        asked = shared.value
        bounds: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                dims = row["dims"]
                if dims not in asked:
                    continue
                numbers, ids, vectors, seeds = asked[dims]
                if dims not in bounds:
                    bounds[dims] = _bounds(vectors, seeds, most)
                block = _unpacked(row)
                for k, number in enumerate(numbers.tolist()):
                    best = found.get(number)
                    if best is None:
                        bound = bounds[dims][k]
                        found[number] = best = Best(most, float(bound - 1e-9 * abs(bound)), ids[k], vectors[k])
                    block.search(vectors[k], best)
        for number, best in found.items():
            n = len(best.ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, number)), pa.array(np.full(n, best.query_id)), pa.array(best.ids, mask=~best.known), pa.array(best.score), pa.array(best.own)],
                names=["query", "query_id", "vec_id", "score", "own"])
    return searched


def nearest(vectors: DataFrame, is_query: Column, most: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            seed_rows: int = SEED_ROWS, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The ``most`` rows of largest inner product found for each query row: ``query_id, rank, vec_id, score``.

    Queries are rows for which ``is_query`` holds, candidates all rows but the query's own. Vectors that are null or
    zero or hold null or non-finite components take no part; vectors meet those of their length only. Ties go to the
    smaller id, null ids last. Query rows that repeat id and vector are one query, and one such row is its own. Without
    enough candidates a query gets all; an empty table gives an empty result; other columns are not read. Ids are
    whole numbers.

    Every row is indexed in blocks, written to the shared folder. About ``seed_rows`` rows, chosen by hash, give each
    query a first bound. Queries go to all blocks in passes of ``query_bytes``: in a block, windows around a query's
    projections grow until they reach the radius of its worst best row, and vectors that collide often are compared
    exactly. A task hands on a query's best rows of all its blocks.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"),
                                                           F.coalesce(is_query, F.lit(False)).alias("asks"))
    index = stored(rows.select("id", "vector").mapInArrow(_blocks, "n long, dims long, ids binary, known binary, vectors binary"), "blocks")
    cost = F.size("vector").cast("long") * 8 + 64
    total, asked = rows.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("asks") & F.col("id").isNotNull(), cost)), F.lit(0))).first()
    share = int(min(1.0, seed_rows / max(1, total)) * 2**32)
    seeds = rows.where(F.pmod(F.xxhash64(F.lit(11), "id", "vector"), F.lit(2**32)) < share).select("id", "vector").toArrow()
    seeded: dict[int, list] = {}
    for batch in seeds.to_batches():
        for _, _, found in _read(batch, "id", "vector"):
            seeded.setdefault(found.shape[1], []).append(found)
    queries = rows.where("asks and id is not null").select("id", "vector").dropDuplicates()
    passes = -(-asked // query_bytes)
    answered = None
    for k in range(passes):
        here = queries.where(F.pmod(F.xxhash64(F.lit(12), "id", "vector"), F.lit(passes)) == k).toArrow()
        lists: dict[int, list] = {}
        for batch in here.to_batches():
            for ids, _, found in _read(batch, "id", "vector"):
                lists.setdefault(found.shape[1], []).append((ids, found))
        by_size, number = {}, 0
        for dims, parts in lists.items():
            ids, found = (np.concatenate(x) for x in zip(*parts))
            by_size[dims] = number + np.arange(len(ids)), ids, found, np.concatenate([np.zeros((0, dims)), *seeded.get(dims, [])])
            number += len(ids)
        shared = spark.sparkContext.broadcast(by_size)
        best = stored(index.mapInArrow(_searched(shared, most + 1), "query long, query_id long, vec_id long, score double, own boolean"), "best")
        shared.destroy()
        best = best.withColumn("query", F.col("query") * passes + k)
        answered = best if answered is None else answered.unionByName(best)
    if answered is None:
        answered = spark.createDataFrame([], "query long, query_id long, vec_id long, score double, own boolean")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), F.desc("own"))
    placed = answered.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most + 1)
    own = F.min(F.when(F.col("own"), F.col("place"))).over(Window.partitionBy("query"))
    ranked = placed.withColumn("mine", own).where("mine is null or place <> mine")
    rank = F.col("place") - F.when(F.col("mine") < F.col("place"), 1).otherwise(0)
    return ranked.withColumn("rank", rank.cast("int")).where(F.col("rank") <= most).select("query_id", "rank", "vec_id", "score")
