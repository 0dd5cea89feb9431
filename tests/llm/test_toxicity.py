import random

import numpy as np
import pytest

from llm_data import EDGES, texts  # noqa: F401
from tablewright.llm.toxicity import fit, passages, segments, toxicity


def brute(scores):
    """Maximal stretches by definition: the best one, then the same to its left and right."""
    out = []

    def search(a, b):
        best = max(((sum(scores[i:j]), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if best and best[0] > 1e-12:
            out.append((best[2], best[3] - 1, best[0]))
            search(a, best[2])
            search(best[3], b)
    search(0, len(scores))
    return sorted(out)


@pytest.mark.parametrize("seed", range(25))
def test_segments_are_all_maximal_ones(seed):
    rng = random.Random(seed)
    values = [rng.choice([3.7, 2.3, 1.1]) + rng.random() if rng.random() < 0.3 else -0.7 for _ in range(40)]
    places = np.array([i for i, v in enumerate(values) if v > 0], dtype=int)
    found = segments(np.array([v for v in values if v > 0]), places, -0.7)
    expected = brute(values)
    assert [(a, b) for a, b, _ in sorted(found)] == [(a, b) for a, b, _ in expected]
    assert np.allclose([s for *_, s in sorted(found)], [s for *_, s in expected])


@pytest.fixture
def labelled(spark, texts):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        t = [rng.choice(["plain", "words", "of", "some", "text", "or", "other"]) + str(rng.randrange(40)) for _ in range(60)]
        bad = i % 4 == 0
        for _ in range(4 if bad else 0):
            t.insert(30, rng.choice(["nastyone", "nastytwo", "vile"]))
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad), "x"))
    labels += [(None, 1, "x"), (5, None, "x")]
    return texts(rows + EDGES[:4]), spark.createDataFrame(labels, "doc_id long, toxic int, text string"), rows


def test_scores_and_passages(labelled):
    docs, labels, rows = labelled
    scored = {r.doc_id: r.score for r in toxicity(docs, labels).collect()}
    assert all((scored[i] >= 0.3) == (i % 4 == 0) for i in range(6, 400))
    assert all(0 <= s <= 1 for s in scored.values())
    found = passages(fit(docs, labels), docs).collect()
    assert {r.id for r in found} >= {i for i in range(8, 400, 4)}
    text = dict(rows)
    for r in found[:20]:
        if r.id >= 6:
            assert text[r.id].split()[r.first_word:r.first_word + r.n_words] == r.passage.split() and "nasty" in r.passage or "vile" in r.passage


def test_edges(spark, texts):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity(texts(EDGES), none).collect()] == pytest.approx([0.5] * len(EDGES))
    assert toxicity(texts([]), none).collect() == []
    one = spark.createDataFrame([(4, 1), (7, 1)], "doc_id long, toxic int")
    assert len(toxicity(texts(EDGES), one).collect()) == len(EDGES)


def test_more_tokens_than_the_former_limit(spark, texts, monkeypatch):
    """25,000 telling words: each one alone is found, however many there are."""
    words = [f"w{k:05d}" for k in range(25_000)]
    rows = [(k, " ".join(words[(k % 20) * 1250:(k % 20 + 1) * 1250]) + f" n{k}") for k in range(200)] + [
        (1000 + k, " ".join(f"clean{(k * 7 + j) % 4000} word{j % 900}" for j in range(900))) for k in range(400)]
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in rows], "doc_id long, toxic int")
    monkeypatch.setattr("tablewright.llm.toxicity.CAUTION", 0.1)
    assert len(fit(texts(rows), labels)[0]) >= 25_000
