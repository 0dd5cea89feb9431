import random

import pytest

from llm_data import EDGES, texts  # noqa: F401
from tablewright.llm.licenses import MISS, TEMPLATES, license_matches, read_templates, words_of


def brute(text, templates):
    w, out = words_of(text or ""), {}
    for t in templates:
        for start in range(0, max(1, len(w)), t.stride):
            part = w[start:start + t.width]
            held = len({" ".join(part[i:i + 5]) for i in range(len(part) - 4)} & set(t.shingles))
            if held * 10 >= 8 * len(t.shingles) and held / len(t.shingles) > out.get(t.number, (0, 0))[0]:
                out[t.number] = (held / len(t.shingles), start)
    return {(t.license, t.number, *out[t.number]) for t in templates if t.number in out}


def test_against_brute_force(texts):
    rng = random.Random(6)
    rows = list(EDGES)
    for i in range(120):
        w = [rng.choice(["red", "the", "license", "software", "of", "blue"]) for _ in range(rng.randrange(120))]
        for _ in range(rng.randrange(3)):
            body = rng.choice(TEMPLATES)[1].split()
            if rng.random() < 0.4:
                body[rng.randrange(len(body))] = "changed"
            w[rng.randrange(len(w) + 1):0] = body
        rows.append((100 + i, " ".join(w)))
    found = license_matches(texts(rows)).collect()
    known = read_templates(TEMPLATES)
    expected = {(i, *x) for i, t in rows for x in brute(t, known)}
    assert {(r.doc_id, r.license, r.template, r.containment, r.start) for r in found} == expected and len(found) == len(expected) > 50


def test_settings():
    for t in read_templates(TEMPLATES):
        least = -(-8 * len(t.shingles) // 10)
        similarity = least / (t.width - 4 + len(t.shingles) - least)
        assert (1 - similarity) ** t.bands <= MISS
        assert sum(any(a in s.split() for a in t.anchors) for s in t.shingles) > len(t.shingles) - least
    with pytest.raises(ValueError):
        read_templates([("short", "four words are few")])


def test_edges(texts):
    assert license_matches(texts([])).collect() == [] and license_matches(texts(EDGES)).collect() == []
    assert license_matches(texts([(1, "Released under the MIT License")]), []).collect() == []
    found = license_matches(texts([(1, "RELEASED under\nthe MIT license"), (1, "Released under the MIT License.")])).collect()
    assert [(r.doc_id, r.license, r.containment) for r in found] == [(1, "MIT", 1.0)]
