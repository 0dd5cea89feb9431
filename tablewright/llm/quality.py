"""Supervised subword embeddings: hashed word and character n-gram vectors, averaged and classified."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .store import sampled_labels
from .words import Hasher, portions

BITS = 16
WIDTH = 10
GRAMS = (3, 4, 5)
#: the feature that a word repeats the one before it
SAME = 0
#: bound of the labelled documents a model is fitted on; a larger labelled set is thinned by hash
TRAINING_DOCUMENTS = 4000
EPOCHS = 10
RATE = 2.0
BLOCK_BYTES = 1 << 19
#: odd multipliers of the rolling hashes
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], dtype=np.uint32)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - BITS)).astype(np.int64)


def features(texts: list[bytes], hasher: Hasher):
    """Portions ``(buckets, counts)``: hashed features in text order and how many of them each text has.

    A feature is a run of 3 to 5 bytes of a word with a space at either end, a whole word, or that a word repeats the
    one before it. Case is kept: it tells shouting from prose.
    """
    framed = [b" " + b" ".join(t.split()) + b" " for t in texts]
    data = np.frombuffer(b"".join(framed), dtype=np.uint8)
    begins = np.concatenate([[0], np.cumsum([len(t) for t in framed])[:-1]]).astype(np.int64)
    space = data == 32
    wide = data.astype(np.uint32)
    h = wide * MULTIPLIERS[0]
    crossed = np.zeros(len(data), dtype=bool)
    for n in range(2, max(GRAMS) + 1):
        size = len(data) - n + 1
        if size <= 0:
            break
        h = h[:size] + wide[n - 1:] * MULTIPLIERS[n - 1]
        if n > 2:
            crossed = crossed[:size] | space[n - 2:n - 2 + size]
        if n in GRAMS:
            inside = np.zeros(len(data), dtype=bool)
            inside[:size] = ~crossed
            yield _bucket(h[inside[:size]]), np.add.reduceat(inside, begins, dtype=np.int64)
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    words = hasher(data, starts, ends)
    per_text = np.diff(np.searchsorted(starts, np.append(begins, len(data))))
    yield (words >> np.uint64(64 - BITS)).astype(np.int64), per_text
    same = np.zeros(len(words), dtype=bool)
    same[1:] = words[1:] == words[:-1]
    firsts = np.cumsum(per_text) - per_text
    same[firsts[per_text > 0]] = False
    total = np.concatenate([[0], np.cumsum(same)])
    yield np.full(int(total[-1]), SAME), total[firsts + per_text] - total[firsts]


def _counted(batches):
    """Distinct feature buckets of each text with their counts, packed; a text has at most ``2**BITS`` of them."""
    import zstandard
    hasher, pack = Hasher(), zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        for begin, end, texts in portions(batch.column(1), BLOCK_BYTES):
            docs, found = [], []
            for buckets, counts in features(texts, hasher):
                docs.append(np.repeat(np.arange(end - begin), counts))
                found.append(buckets)
            key = np.concatenate(docs) << BITS | np.concatenate(found)
            key, n = np.unique(key, return_counts=True)
            cut = np.searchsorted(key >> BITS, np.arange(end - begin + 1)).tolist()
            buckets, n = (key & (1 << BITS) - 1).astype("<u2"), n.astype("<u4")
            packed = [pack(buckets[a:b].tobytes() + n[a:b].tobytes()) for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(packed, pa.binary())], names=["id", "features"])


def unpacked(features: bytes, decompressor) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of a text."""
    data = decompressor.decompress(features)
    n = len(data) // 6
    return np.frombuffer(data, dtype="<u2", count=n).astype(np.int64), np.frombuffer(data, dtype="<u4", offset=2 * n).astype(np.int64)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def train(rows: list[tuple[bytes, int]], seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, output weights and output bias by stochastic gradient descent over ``(packed features, label)``.

    Rows stay packed but for the one whose turn it is.
    """
    import zstandard
    decompressor = zstandard.ZstdDecompressor()
    rng = np.random.default_rng(seed)
    embeddings = rng.uniform(-1 / WIDTH, 1 / WIDTH, (1 << BITS, WIDTH))
    weights, bias = rng.normal(0, 1 / WIDTH, (WIDTH, 2)), np.zeros(2)
    steps, step = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            (buckets, counts), label = unpacked(rows[k][0], decompressor), rows[k][1]
            rate = RATE * (1 - step / steps)
            step += 1
            share = counts / max(1, counts.sum())
            hidden = share @ embeddings[buckets]
            error = _softmax(hidden @ weights + bias)
            error[label] -= 1
            back = weights @ error
            weights -= rate * np.outer(hidden, error)
            bias -= 0.1 * rate * error
            embeddings[buckets] -= (rate * share)[:, None] * back
    return embeddings, weights, bias


#: what scoring needs: the output is linear in the average vector, so a bucket counts by one number
Model = tuple[np.ndarray, float]


def collapsed(embeddings: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> Model:
    return embeddings @ (weights[:, 1] - weights[:, 0]), float(bias[1] - bias[0])


def scores(model: Model, texts: list[bytes], hasher: Hasher) -> np.ndarray:
    """Probability of label 1; a text without features gets that of the bias."""
    margin, bias = model
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    for buckets, counts in features(texts, hasher):
        run = np.concatenate([[0.0], np.cumsum(margin[buckets])])
        until = np.cumsum(counts)
        total += run[until] - run[until - counts]
        n += counts
    return 1 / (1 + np.exp(-(total / np.maximum(n, 1) + bias)))


def fit(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text",
        most: int = TRAINING_DOCUMENTS) -> Model:
    """Train on the labelled documents, or on about ``most`` of them chosen by hash (the driver holds their features).

    Labels without id, value or document are left out; without any, every text gets the same score 0.5. Of several
    documents with one id one is taken.
    """
    known = dict(sampled_labels(labels, id_col, label_col, most))
    spark = docs.sparkSession
    rows = []
    if known:
        listed = F.broadcast(spark.createDataFrame([(k,) for k in known], f"id {dict(labels.dtypes)[id_col]}"))
        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(listed, "id")
        counted = texts.mapInArrow(_counted, f"id {dict(docs.dtypes)[id_col]}, features binary")
        table = counted.groupBy("id").agg(F.min("features").alias("features")).toArrow()
        rows = [(f, int(known[i] == 1)) for i, f in sorted(zip(table["id"].to_pylist(), table["features"].to_pylist()), key=lambda r: r[0])]
    return collapsed(*train(rows)) if rows else (np.zeros(1 << BITS), 0.0)


def score_column(model: Model, text: Column) -> Column:
    """The model's probability of label 1 for a text column, over whole texts; null counts as empty."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    def scored(texts: pa.Array) -> pa.Array:
        hasher = Hasher()
        return pa.array(np.concatenate([np.zeros(0), *(scores(shared.value, part, hasher)
                                                       for _, _, part in portions(texts, BLOCK_BYTES))]))
    scored.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(scored, "double")(text)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never used to fit: crc32 of the id as text leaves remainder 2 by 4."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
            text_col: str = "text", most: int = TRAINING_DOCUMENTS) -> DataFrame:
    """One row per document with its id and ``score``, the probability that its label is 1.

    The model is fitted on labels of rows outside ``held_out``. Whole texts are scored; null and empty texts and
    texts of white space get the score of the bias. Repeated rows stay, an empty table gives an empty result, and
    other columns are not read.
    """
    model = fit(docs, labels.where(~held_out(id_col)), label_col, id_col, text_col, most)
    return docs.select(F.col(id_col), score_column(model, F.col(text_col)).alias("score"))


def good_documents(docs: DataFrame, labels: DataFrame, least: float = 0.7, label_col: str = "quality",
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose score is at least ``least``, with all their columns.

    Scores are those of ``quality``: null, empty and wordless texts get that of the bias, repeated rows stay or go
    together, an empty table stays empty, and without any label all scores are 0.5.
    """
    model = fit(docs, labels.where(~held_out(id_col)), label_col, id_col, text_col)
    return docs.where(score_column(model, F.col(text_col)) >= least)
