import random
import re

import pytest

import tablewright.llm.contamination as c
from llm_data import EDGES, texts  # noqa: F401

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(text, items, width):
    w, hit, met = words(text), set(), set()
    for item, body in items:
        b = words(body)
        for k in range(max(1, len(b) - width + 1) if b else 0):
            part = b[k:k + width]
            for i in range(len(w) - len(part) + 1):
                if w[i:i + len(part)] == part:
                    hit.update(range(i, i + len(part)))
                    met.add(str(item))
    return len(w), len(hit), sorted(met)


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and"] * 5 + [f"w{i}" for i in range(30)] + ["é", "ÉÈ", "A9"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 9)))) for i in range(12)] + [(98, None), (99, "!!")]
    docs = []
    for i in range(n):
        t = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        if rng.random() < 0.6:
            t[rng.randrange(len(t) + 1):0] = (rng.choice(items)[1] or "").split()
        docs.append((i, rng.choice([" ", "-", ", "]).join(t)))
    return docs + EDGES, items


@pytest.fixture
def bench(spark):
    return lambda items: spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")


@pytest.mark.parametrize("query_bytes,segment_bytes", [(16 << 20, 1 << 20), (200, 150)])
def test_report_against_brute_force(texts, bench, monkeypatch, query_bytes, segment_bytes):
    monkeypatch.setattr(c, "QUERY_BYTES", query_bytes)  # small: several portions, merged
    monkeypatch.setattr(c, "SEGMENT_BYTES", segment_bytes)
    docs, items = corpus(4)
    found = c.contamination(texts(docs), bench(items), width=4).collect()
    expected = [(i, *brute(t, items, 4)) for i, t in docs]
    key = lambda r: (str(r[0]), r[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found), key=key) == sorted(expected, key=key)


def test_phrase_and_proximity(texts, bench):
    docs = [(1, "a b c a b c"), (2, "b x x a"), (3, "c"), (4, "a x b")]
    index = c.build_index(texts(docs))
    found = c.phrase_matches(index, bench([(7, "a b")]), width=2).collect()
    assert sorted((r.id, r.start, r.item, r.n_words) for r in found) == [(1, 0, "7", 6), (1, 3, "7", 6)]
    near = c.proximity_matches(index, bench([(7, "a b")]), span=3).collect()
    brute_near = sorted((i, k) for i, t in docs for w in [t.split()] for k in range(len(w))
                        if w[k] in "ab" and {"a", "b"} <= set(w[k:k + 3]))
    assert sorted((r.id, r.start) for r in near) == brute_near


def test_empty_sides(texts, bench):
    assert c.contamination(texts([]), bench([(1, "a")])).collect() == []
    found = c.contamination(texts([(1, "a"), (2, None)]), bench([])).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found) == [(1, 1, 0, []), (2, 0, 0, [])]


def test_clean_documents(texts, bench):
    docs = [(1, "keep this text as it is"), (2, "x y z"), (2, "other text of the same id"), (None, "x y z"), (3, None)]
    kept = c.clean_documents(texts(docs), bench([(1, "x y z")]))
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(1, docs[0][1]), (2, docs[2][1]), (3, "")]
