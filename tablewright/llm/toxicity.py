"""Toxic passages as maximum-scoring segments of word log-odds, judged by extreme-value statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .quality import held_out
from .store import sampled_labels
from .words import Block, Hasher, portions

#: bound of the labelled documents a model is fitted on; a larger labelled set is thinned by hash
TRAINING_DOCUMENTS = 20_000
#: weight of the prior against the labelled words; it is shared out by corpus frequency
PRIOR_SHARE = 0.03
#: tokens are whole words and their first so many bytes, for languages that build words
BEGINNINGS = (4, 5, 6, 7, 8)
#: a token's log-odds less so many standard deviations must reach the least odds of the lexicon
CAUTION = 2.0
LEAST_ODDS = 1.0
#: a passage is significant when chance gives fewer than so many as good ones in a text of its length
E_VALUE = 0.5
#: texts of shuffled words by which the extreme-value distribution is fitted
NULL_TEXTS = 300
NULL_WORDS = 2000


def _tokens(texts: list[bytes], hasher: Hasher) -> tuple[Block, list[np.ndarray]]:
    """The words of some texts, and their token hashes: whole words, then beginnings of each length in ``BEGINNINGS``.

    A word no longer than a beginning has none of that length; its hash is 0 there, which no lexicon holds.
    """
    block = Block(texts)
    ranges = [(block.starts, block.ends)] + [(block.starts, np.minimum(block.starts + n, block.ends)) for n in BEGINNINGS]
    hashes = list(hasher.spans(block.data, ranges))
    length = block.ends - block.starts
    for k, n in enumerate(BEGINNINGS):
        hashes[k + 1] = np.where(length > n, hashes[k + 1] ^ np.uint64(n), np.uint64(0))
    return block, hashes


def _counts(labelled):
    """Per batch: the distinct tokens, and how many texts of either class hold them."""
    def counted(batches):
        hasher, label_of = Hasher(), labelled.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for begin, end, texts in portions(batch.column(1)):
                block, hashes = _tokens(texts, hasher)
                label = np.array([label_of[i] for i in ids[begin:end]], dtype=np.int64)
                doc = np.repeat(np.arange(end - begin), np.diff(block.first))
                for h in hashes:
                    token, inverse = np.unique(h, return_inverse=True)
                    held = np.unique(inverse.astype(np.int64) * (end - begin) + doc)  # a text counts once for a token
                    at, of = held // (end - begin), label[held % (end - begin)]
                    counts = [np.bincount(at[of == 1], minlength=len(token)), np.bincount(at[of != 1], minlength=len(token))]
                    real = token != 0
                    yield pa.RecordBatch.from_arrays([pa.array(x[real]) for x in (token.view(np.int64), *counts)],
                                                     names=["token", "toxic", "clean"])
    return counted


def _corpus_counts(shared):
    """Per task: how often each token of a sorted hash list occurs, and at -1 the number of all words."""
    def counted(batches):
        hasher, wanted, n = Hasher(), shared.value, 0
        total = np.zeros(len(wanted), dtype=np.int64)
        for batch in batches:
            for _, _, texts in portions(batch.column(0)):
                _, hashes = _tokens(texts, hasher)
                n += len(hashes[0])
                for h in hashes:
                    total += np.bincount(_place(wanted, h), minlength=len(wanted) + 1)[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.flatnonzero(total), -1)), pa.array(np.append(total[total > 0], n))],
                                         names=["at", "n"])
    return counted


def _place(sorted_hashes: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each hash in the list, its length for those not in it."""
    at = np.searchsorted(sorted_hashes, h)
    if not len(sorted_hashes):
        return at
    at[sorted_hashes[np.minimum(at, len(sorted_hashes) - 1)] != h] = len(sorted_hashes)
    return at


def segments(scores: np.ndarray, places: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring stretches ``(first place, last place, score)``, in linear time.

    ``scores`` are those of the words at ``places``; every word between them scores ``drift``, which is negative. A
    maximal stretch is one that no longer or shorter stretch beats, and none of them overlap (Ruzzo and Tompa).
    """
    found: list[tuple[int, int, float, float]] = []  # first, last, sum before it, sum with it
    running, last = 0.0, -1
    for s, p in zip(scores.tolist(), places.tolist()):
        running += drift * (p - last - 1)
        last = p
        before, running = running, running + s
        if s <= 0:
            continue
        first = p
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= before:
                k -= 1
            if k < 0 or found[k][3] >= running:
                found.append((first, p, before, running))
                break
            first, before = found[k][0], found[k][2]
            del found[k:]
    return [(a, b, after - start) for a, b, start, after in found]


#: token hashes in order, their scores, the drift of other words, Karlin-Altschul lambda and K, calibration weights
Model = tuple[np.ndarray, np.ndarray, float, float, float, np.ndarray]


def _passages(model: Model, texts: list[bytes], hasher: Hasher) -> Iterator[tuple[int, list[tuple[int, int, float]], Block, int]]:
    """Of each text: its number of words and its maximal segments in words of the block."""
    hashes, scores, drift = model[:3]
    block, tokens = _tokens(texts, hasher)
    known = np.append(scores, 0.0)
    value = known[_place(hashes, tokens[0])]
    for h in tokens[1:]:
        np.maximum(value, known[_place(hashes, h)], out=value)
    places = np.flatnonzero(value)
    cut = np.searchsorted(places, block.first)
    for d in range(len(texts)):
        mine = places[cut[d]:cut[d + 1]]
        base = int(block.first[d])
        yield int(block.first[d + 1]) - base, segments(value[mine], mine - base, drift), block, base


def normalised(model: Model, score: float, n_words: int) -> float:
    """A segment's score in extreme-value units: chance exceeds ``x`` in a text of its length ``exp(-x)`` times."""
    return model[3] * score - math.log(max(model[4] * n_words, 1e-9))


def significant(model: Model, found: list[tuple[int, int, float]], n_words: int) -> list[tuple[int, int, float, float]]:
    """Segments with an expected number of chance equals of at most ``E_VALUE``: ``(first, last, score, e_value)``."""
    graded = ((a, b, s, math.exp(min(50.0, -normalised(model, s, n_words)))) for a, b, s in found)
    return [g for g in graded if g[3] <= E_VALUE]


def evidence(model: Model, found: list[tuple[int, int, float]], n_words: int) -> list[float]:
    """What the calibration weighs: the best segment in extreme-value units, how surely it is no chance, the sum of
    significant excesses and whether any segment was found."""
    if not found:
        return [0.0, 0.0, 0.0, 0.0]
    best = normalised(model, max(s for _, _, s in found), n_words)
    sure = math.exp(-math.exp(min(50.0, -best)))
    excess = sum(-math.log(max(e, 1e-300)) for *_, e in significant(model, found, n_words))
    return [best, sure, math.log1p(max(0.0, excess)), 1.0]


def _logistic(rows: np.ndarray, labels: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    x = np.column_stack([np.ones(len(rows)), rows])
    weights = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (labels - p) - ridge * weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(weights)) * (ridge + 1e-9)
        step = np.linalg.solve(curve, slope)
        weights += step
        if np.abs(step).max() < 1e-9:
            break
    return weights


def _lambda(scores: np.ndarray, shares: np.ndarray, drift: float) -> float:
    """The positive root of the mean of exp(lambda * score) = 1 over background words."""
    rest = max(0.0, 1 - shares.sum())
    mean = lambda t: float(shares @ np.exp(np.minimum(t * scores, 700)) + rest * math.exp(t * drift)) - 1
    low, high = 0.0, 1.0
    while mean(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 0 else (low, mid)
    return high


def _gumbel(scores: np.ndarray, shares: np.ndarray, drift: float, lam: float, seed: int = 3) -> float:
    """K of the extreme-value law, from the best segments of random background texts.

    The best score of n words exceeds x with probability 1 - exp(-K n exp(-lambda x)), so exp(-lambda x) is
    exponential with rate K n; a text without a positive word gives the score 0.
    """
    rng = np.random.default_rng(seed)
    best = []
    for _ in range(NULL_TEXTS):
        n = rng.multinomial(NULL_WORDS, np.append(shares, max(0.0, 1 - shares.sum())))[:-1]
        drawn = np.repeat(scores, n)
        places = np.sort(rng.choice(NULL_WORDS, len(drawn), replace=False))
        found = segments(rng.permutation(drawn), places, drift)
        best.append(max([0.0, *(s for _, _, s in found)]))
    return 1 / (NULL_WORDS * float(np.mean(np.exp(-lam * np.array(best)))))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
        most: int = TRAINING_DOCUMENTS) -> Model:
    """Token log-odds from about ``most`` labelled documents, with a Dirichlet prior from the counts of all documents.

    The lexicon holds tokens whose log-odds of label 1 are surely above ``LEAST_ODDS``. The calibration is
    a logistic curve over the extreme-value statistics of the same documents. Without both labels, or with no such
    word, nothing is found and every text gets the share of label 1.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    known = dict(sampled_labels(labels, id_col, label_col, most))
    share = (sum(v == 1 for v in known.values()) + 1) / (len(known) + 2)
    nothing = (np.zeros(0, np.uint64), np.zeros(0), -1.0, 1.0, 1.0, np.array([math.log(share / (1 - share)), 0, 0, 0, 0]))
    if len({v == 1 for v in known.values()}) < 2:
        return nothing
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    listed = F.broadcast(spark.createDataFrame(list(known.items()), f"id {kind}, label int"))
    # copies of a text would count its words again: one row each, with the label most of them have
    known = {r.id: int(r.share > 0.5) for r in
             rows.select("id", F.xxhash64("text").alias("h")).join(listed, "id").groupBy("h")
             .agg(F.min("id").alias("id"), F.avg(F.expr("int(label = 1)")).alias("share")).collect()}
    if not known:
        return nothing
    shared = spark.sparkContext.broadcast(known)
    texts = rows.join(F.broadcast(spark.createDataFrame([(k,) for k in known], f"id {kind}")), "id")
    counted = (texts.mapInArrow(_counts(shared), "token long, toxic long, clean long")
               .groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    totals = counted.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).first()
    if not totals.toxic or not totals.clean:
        return nothing
    # all tokens that toxic texts hold more often get their prior from all texts and then the test; the sample bounds them
    plain = F.log((F.col("toxic") + 0.01) / totals.toxic) - F.log((F.col("clean") + 0.01) / totals.clean)
    rows = counted.where((F.col("toxic") > 1) & (plain > 0)).toArrow()
    if not rows.num_rows:
        return nothing
    h, toxic, clean = (rows[c].to_numpy() for c in ("token", "toxic", "clean"))
    h = h.view(np.uint64)
    order = np.argsort(h)
    h, toxic, clean = h[order], toxic[order].astype(float), clean[order].astype(float)
    corpus = (docs.select(text_col).mapInArrow(_corpus_counts(spark.sparkContext.broadcast(h)), "at long, n long")
              .groupBy("at").agg(F.sum("n").alias("n")).toArrow())
    at, n = (corpus[c].to_numpy() for c in ("at", "n"))
    n_all = max(1, int(n[at < 0].sum()))
    count = np.zeros(len(h))
    count[at[at >= 0]] = n[at >= 0]
    prior_words = PRIOR_SHARE * (totals.toxic + totals.clean) / (1 + len(BEGINNINGS))
    prior = np.maximum(count, 1) / n_all * prior_words
    a, b = toxic + prior, clean + prior
    odds = (np.log(a / (totals.toxic + prior_words - a)) - np.log(b / (totals.clean + prior_words - b)))
    odds -= CAUTION * np.sqrt(1 / a + 1 / b)
    kept = odds >= LEAST_ODDS
    if not kept.any():
        return nothing
    h, odds, a, b = h[kept], odds[kept], a[kept], b[kept]
    background = b / (totals.clean + prior_words)
    drift = min(math.log(max(0.1, 1 - (a / (totals.toxic + prior_words)).sum())), -1e-4)
    lam = _lambda(odds, background, drift)
    model = (h, odds, drift, lam, _gumbel(odds, background, drift, lam), np.zeros(5))
    found = texts.mapInArrow(_evidence_of(spark.sparkContext.broadcast(model)), f"id {kind}, x array<double>").collect()
    found = sorted(((r.id, r.x) for r in found), key=lambda r: r[0])
    weights = _logistic(np.array([x for _, x in found]), np.array([known[i] == 1 for i, _ in found], dtype=float))
    return (*model[:5], weights)


def _evidence_of(shared):
    def found(batches):
        hasher, model = Hasher(), shared.value
        for batch in batches:
            rows = []
            for _, _, texts in portions(batch.column(1)):
                rows += [evidence(model, found, n) for n, found, _, _ in _passages(model, texts, hasher)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["id", "x"])
    return found


def score_column(model: Model, text: Column) -> Column:
    """Probability of label 1 of a text column, over whole texts; null counts as empty."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    def scored(texts: pa.Array) -> pa.Array:
        hasher, model, rows = Hasher(), shared.value, []
        for _, _, part in portions(texts):
            rows += [evidence(model, found, n) for n, found, _, _ in _passages(model, part, hasher)]
        x = np.array(rows, dtype=float).reshape(-1, 4)
        return pa.array(1 / (1 + np.exp(-np.clip(model[5][0] + x @ model[5][1:], -30, 30))))
    scored.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(scored, "double")(text)


def passages(model: Model, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every significant passage: ``(id, first_word, n_words, score, e_value, passage)``; words count from 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def found(batches):
        hasher, model = Hasher(), shared.value
        for batch in batches:
            rows, at = [], []
            for begin, _, texts in portions(batch.column(1)):
                for d, (n, segs, block, base) in enumerate(_passages(model, texts, hasher)):
                    for a, b, s, e in significant(model, segs, n):
                        words = block.data[block.starts[base + a]:block.ends[base + b]].tobytes().decode()
                        rows.append((a, b - a + 1, s, e, words))
                        at.append(begin + d)
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in
                       enumerate((pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns],
                                             names=["id", "first_word", "n_words", "score", "e_value", "passage"])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        found, f"id {dict(docs.dtypes)[id_col]}, first_word int, n_words int, score double, e_value double, passage string")


def toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id",
             text_col: str = "text", most: int = TRAINING_DOCUMENTS) -> DataFrame:
    """One row per document with its id and ``score``, the probability that its label is 1.

    Fitted on labels of rows outside ``held_out``. Null and empty texts have no passage and get the score of texts
    without any. Repeated rows stay, an empty table gives an empty result, and other columns are not read.
    """
    model = fit(docs, labels.where(~held_out(id_col)), label_col, id_col, text_col, most)
    return docs.select(F.col(id_col), score_column(model, F.col(text_col)).alias("score"))
