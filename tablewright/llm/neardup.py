"""Near-duplicate documents by SimHash fingerprints and a hierarchical index in Gray order."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .components import components
from .store import stored, unused

SEED = 42
BITS = 64
#: fingerprints of one bucket that a task takes as they are; a fuller bucket is cut by further bits
BUCKET = 1024
FANOUT = 8
LEVELS = 3
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of a text: a bit is set when it is set in over half of the shingle hashes; no word gives 0."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    gaps = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(joined)]
    width = min(words, len(tokens))
    spans = list(zip(starts, ends[width - 1:]))
    digest, total = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(spans), SHINGLES_AT_ONCE):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in spans[k:k + SHINGLES_AT_ONCE]], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(spans), bitorder="little").view("<u8")[0])


@lru_cache(maxsize=None)
def fingerprint_column(words: int = 3):
    """The fingerprint of a text column as a long (the same 64 bits); null counts as no word."""
    def hashed(texts: pa.Array) -> pa.Array:
        found = (fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", words) for t in texts.cast("binary"))
        return pa.array(np.fromiter(found, dtype=np.uint64, count=len(texts)).view(np.int64))
    hashed.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(hashed, "long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Codes in Gray order under nodes that hold the bits all their codes share.

    A node keeps only the shared bits its parent does not hold yet, so a search adds up differences on the way down
    and leaves a whole group once they exceed the limit.
    """

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        every, some = self.codes, self.codes
        levels = [(self.codes, np.full(len(codes), ~np.uint64(0)))]
        while len(every) > FANOUT:
            cuts = np.arange(0, len(every), FANOUT)
            every, some = np.bitwise_and.reduceat(every, cuts), np.bitwise_or.reduceat(some, cuts)
            levels.append((every, ~(every ^ some)))
        #: from the top: shared bits' values, and which bits are new at this level
        self.levels = []
        for k in range(len(levels) - 1, -1, -1):
            pattern, shared = levels[k]
            if k + 1 < len(levels):
                shared = shared & ~np.repeat(levels[k + 1][1], FANOUT)[:len(shared)]
            self.levels.append((pattern, shared))

    def within(self, most: int, at_once: int = 256):
        """Pairs of positions ``(i, j)`` whose codes differ in at most ``most`` bits, in portions."""
        for begin in range(0, len(self.codes), at_once):
            mine = np.arange(begin, min(begin + at_once, len(self.codes)))
            top = len(self.levels[0][0])
            query, node = np.repeat(mine, top), np.tile(np.arange(top), len(mine))
            gone = np.zeros(len(query), dtype=np.uint8)
            for k, (pattern, shared) in enumerate(self.levels):
                if k:
                    size = len(pattern)
                    query, gone = np.repeat(query, FANOUT), np.repeat(gone, FANOUT)
                    node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                    inside = node < size
                    query, node, gone = query[inside], node[inside], gone[inside]
                gone = gone + np.bitwise_count((self.codes[query] ^ pattern[node]) & shared[node])
                keep = gone <= most
                query, node, gone = query[keep], node[keep], gone[keep]
            yield query, node


def forest(codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join every linked code to one code of its group: never more than there are codes."""
    index = GrayIndex(codes)
    label = np.arange(len(codes))
    for i, j in index.within(most):
        while True:
            low = np.minimum(label[i], label[j])
            before = label.copy()
            np.minimum.at(label, label[i], low)
            np.minimum.at(label, label[j], low)
            label = np.minimum(label, label[label])
            if (label == before).all() and (label[i] == label[j]).all():
                break
    far = np.flatnonzero(label != np.arange(len(codes)))
    return index.codes[far], index.codes[label[far]]


def _masks(most: int) -> list[list[int]]:
    """Bit masks of the buckets: at each level every mask of the level above gets one of ``most + 1`` parts of its free bits.

    Codes that differ in at most ``most`` bits agree on one of ``most + 1`` disjoint parts, so a linked pair shares a
    bucket at every level. Child ``c`` of mask ``m`` has number ``m * (most + 1) + c``.
    """
    levels = [[0]]
    for _ in range(LEVELS):
        found = []
        for mask in levels[-1]:
            free = [b for b in range(BITS) if not mask >> b & 1]
            for part in range(most + 1):
                bits = free[len(free) * part // (most + 1):len(free) * (part + 1) // (most + 1)]
                found.append(mask | sum(1 << b for b in bits))
        levels.append(found)
    return levels[1:]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _edges_of(most: int):
    def found(batches):
        for batch in batches:
            left, right = [], []
            for codes in batch.column(0):
                a, b = forest(np.array(codes.values, dtype=np.int64).view(np.uint64), most)
                left.append(a)
                right.append(b)
            if left:
                pair = [np.concatenate(x).view(np.int64) for x in (left, right)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in pair], names=["a", "b"])
    return found


def fingerprint_links(codes: DataFrame, column: str = "fp", most: int = 2) -> DataFrame:
    """Edges ``(a, b)`` that connect all fingerprints within ``most`` bits, from distinct non-null ones.

    Buckets by shared masked bits; those with over ``BUCKET`` members are cut by a third of their free bits, twice at
    most, after which at most 2**20 different codes fit in one. Every bucket is searched by its own Gray-order index
    and hands on a spanning forest, not its pairs.
    """
    parts = most + 1
    rows, edges = codes.select(F.col(column).alias("fp"), F.lit(0).alias("path")), None
    for level, masks in enumerate(_masks(most)):
        listed = F.array(*[F.lit(_signed(m)) for m in masks])
        rows = (rows.select("fp", F.explode(F.array(*[F.col("path") * parts + c for c in range(parts)])).alias("path"))
                .withColumn("key", F.col("fp").bitwiseAND(F.get(listed, F.col("path")))))
        sizes = rows.groupBy("path", "key").agg(F.count("*").alias("n")).where("n > 1")
        sized = stored(rows.join(sizes, ["path", "key"]), "buckets")
        last = level + 1 == LEVELS
        groups = (sized if last else sized.where(F.col("n") <= BUCKET)).groupBy("path", "key") \
            .agg(F.collect_list("fp").alias("codes")).select("codes")
        here = groups.mapInArrow(_edges_of(most), "a long, b long")
        edges = here if edges is None else edges.unionByName(here)
        rows = sized.where(F.col("n") > BUCKET).select("fp", "path")
        if last or rows.isEmpty():
            return edges


def rooted(hashed: DataFrame, id_col: str = "doc_id", most: int = 2) -> DataFrame:
    """``(fp, least, root)`` for every fingerprint of ``(id, fp)`` rows: its smallest id and its group's root fingerprint."""
    codes = hashed.groupBy("fp").agg(F.min(id_col).alias("least"))
    roots = stored(components(fingerprint_links(codes, "fp", most)), "roots")
    return codes.join(roots, codes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def grouped(hashed: DataFrame, id_col: str = "doc_id", most: int = 2) -> DataFrame:
    """``(fp, component_id)`` for every fingerprint of ``(id, fp)`` rows."""
    named = rooted(hashed, id_col, most)
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(smallest, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                    most: int = 2) -> DataFrame:
    """One row per document: its id, ``fingerprint`` as 16 hex digits and ``component_id``.

    Texts are lower-cased (A-Z), split at ASCII white space and hashed as shingles of ``words`` words, repeats
    included; documents link when fingerprints differ in at most ``most`` bits, and ``component_id`` is the smallest
    id reachable. Null and wordless texts have fingerprint 0. Repeated rows stay and share their group. A document
    without id links like any other; a group without any id has a null ``component_id``. An empty table gives an
    empty result. Other columns are not read, whatever their names.
    """
    hashed = stored(docs.select(F.col(id_col).alias("id"), fingerprint_column(words)(F.col(text_col)).alias("fp")),
                    "fingerprints")
    named = grouped(hashed, "id", most)
    return hashed.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                most: int = 2) -> DataFrame:
    """The documents with one row of each near-duplicate group: that of the smallest id (any of its repeats).

    Groups are told apart by their fingerprints, so a group without any id keeps a row like any other, and an id on
    different texts keeps one in each of their groups where it is the smallest.
    """
    fp, n, id_ = unused(docs, "fp", "n", "id")
    marked = stored(docs.withColumn(fp, fingerprint_column(words)(F.col(text_col))), "marked")
    hashed = marked.select(F.col(id_col).alias("id"), F.col(fp).alias("fp"))
    first = F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("id"), "fp"))
    kept = rooted(hashed, "id", most).groupBy("root").agg(first.alias("first")).select("first.id", "first.fp")
    rows = hashed.groupBy("id", "fp").agg(F.count("*").alias("n"))
    kept = kept.join(rows, kept.id.eqNullSafe(rows.id) & (kept.fp == rows.fp)).select(kept.id.alias(id_), kept.fp.alias(f"{fp}_kept"), F.col("n").alias(n))
    found = marked.join(kept, marked[id_col].eqNullSafe(F.col(id_)) & (marked[fp] == F.col(f"{fp}_kept")))
    # only rows that repeat an id and a fingerprint meet once more
    once = found.where(F.col(n) == 1).select(*docs.columns)
    return once.unionByName(found.where(F.col(n) > 1).dropDuplicates([id_col, fp]).select(*docs.columns))
