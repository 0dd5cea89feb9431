import random
import zlib

import numpy as np
import pytest

from llm_data import EDGES, texts  # noqa: F401
from tablewright.llm.quality import SAME, features, good_documents, quality
from tablewright.llm.words import Hasher


def test_features_stay_inside_words_and_texts():
    texts = [b"ab cdef cdef", b"", b"cdef", b" \t "]
    totals = np.zeros(len(texts), dtype=int)
    same = np.zeros(len(texts), dtype=int)
    for buckets, counts in features(texts, Hasher()):
        assert len(buckets) == counts.sum()
        totals += counts
        if len(buckets) and (buckets == SAME).all():
            same += counts
    grams = lambda w: sum(max(0, len(w) + 2 - n + 1) for n in (3, 4, 5))
    assert totals.tolist() == [grams("ab") + 2 * grams("cdef") + 3 + 1, 0, grams("cdef") + 1, 0]
    assert same.tolist() == [1, 0, 0, 0]


@pytest.fixture
def labelled(spark, texts):
    rng = random.Random(2)
    good = lambda: " ".join("".join(rng.choice("aeioustrnl") for _ in range(rng.randrange(2, 9))) for _ in range(50))
    rows = [(i, good() if i % 3 else good().replace(" ", "%%% ")) for i in range(300)]
    labels = [(i, int(i % 3 > 0)) for i in range(300)] + [(None, 0), (7, None), (9999, 1)]
    return texts(rows), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    scored = {r.doc_id: r.score for r in quality(docs, labels).collect()}
    held = [i for i in scored if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 40 and all((scored[i] >= 0.7) == (i % 3 > 0) for i in held)
    assert {r.doc_id for r in good_documents(docs, labels).collect()} >= {i for i in held if i % 3}


def test_edges(spark, texts, labelled):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality(texts(EDGES), none).collect()} == {0.5}
    assert quality(texts([]), none).collect() == []
    docs, labels = labelled
    found = quality(docs.unionByName(texts(EDGES)), labels).collect()
    assert len(found) == 300 + len(EDGES) and all(0 <= r.score <= 1 for r in found)
    assert good_documents(texts(EDGES), none, least=0.4).columns == ["doc_id", "text", "id", "label"]


def test_score_and_training_step_against_a_plain_version():
    """One text's score, and one epoch of SGD, recomputed feature by feature."""
    import zstandard
    from tablewright.llm import quality as q
    hasher, data = Hasher(), [b"ab cdef cdef xyz", b"Some Other words here", b"", b"ab ab"]
    found = list(features(data, hasher))
    bags = [[] for _ in data]
    for buckets, counts in found:
        until = np.cumsum(counts)
        for k in range(len(data)):
            bags[k] += buckets[until[k] - counts[k]:until[k]].tolist()
    rng = np.random.default_rng(0)
    emb, w, bias = rng.normal(size=(1 << q.BITS, q.WIDTH)), rng.normal(size=(q.WIDTH, 2)), rng.normal(size=2)
    for k, score in enumerate(q.scores(q.collapsed(emb, w, bias), data, hasher)):
        mean = sum((emb[b] for b in bags[k]), np.zeros(q.WIDTH)) / max(1, len(bags[k]))
        z = mean @ w + bias
        assert abs(score - np.exp(z[1]) / np.exp(z).sum()) < 1e-9

    rows = []
    pack = zstandard.ZstdCompressor().compress
    for k, bag in enumerate(bags):
        buckets, n = np.unique(np.array(bag, dtype=np.int64), return_counts=True)
        rows.append((pack(buckets.astype("<u2").tobytes() + n.astype("<u4").tobytes()), k % 2))
    emb, w, bias = q.train(rows, seed=3)
    rng = np.random.default_rng(3)
    e, v, c = rng.uniform(-1 / q.WIDTH, 1 / q.WIDTH, (1 << q.BITS, q.WIDTH)), rng.normal(0, 1 / q.WIDTH, (q.WIDTH, 2)), np.zeros(2)
    step, steps = 0, q.EPOCHS * len(rows)
    for _ in range(q.EPOCHS):
        for k in rng.permutation(len(rows)):
            rate, bag = q.RATE * (1 - step / steps), bags[k]
            step += 1
            hidden = sum((e[b] for b in bag), np.zeros(q.WIDTH)) / max(1, len(bag))
            z = hidden @ v + c
            error = np.exp(z - z.max()) / np.exp(z - z.max()).sum() - np.eye(2)[k % 2]
            back = v @ error
            for i in range(q.WIDTH):
                for j in range(2):
                    v[i, j] -= rate * hidden[i] * error[j]
            c = c - 0.1 * rate * error
            for b in bag:
                e[b] = e[b] - rate / len(bag) * back
    assert np.allclose(e, emb) and np.allclose(v, w) and np.allclose(c, bias)


def test_one_id_on_many_rows_sends_one_row(spark, texts, labelled):
    docs, labels = labelled
    many = docs.where("doc_id > 0").unionByName(texts([(0, f"text number {k} of one id") for k in range(500)]))
    from tablewright.llm.quality import fit
    assert len(fit(many, labels, "quality")[0]) == 1 << 16
