"""Cross-tokenizer alignment against tokenization of whole texts and a merge of one text at a time."""

import collections
import hashlib

import numpy as np
import pytest
from llm_data import EDGES, texts  # noqa: F401

from tablewright.llm import alignment as al

ODD = [(20, "<|endoftext|> and <s> </s> <unk> stay text"), (21, "a ▁ sign of the other alphabet"), (22, "  two  spaces \n\n lines\t tabs   nbsp wide "),
       (23, "x" * 5000), (24, "日本語のテキスト と English mixed 🙂🙂 é \u0085 ﬁ ½"), (25, "a"), (26, " "), (27, "it's we're I'll’s 12345 67,890.1"),
       (28, "Ünïcödé " * 300), (29, "à́ ​ ﻿ \U000e0041 ẞ �")]


@pytest.fixture(scope="module")
def sides():
    return al.Sides(al.Pair())


def whole(sides, text):
    """Tokens of a text encoded whole, by the reading of the contract."""
    if not text:
        return [], []
    byte_level, pieces = sides.sides
    a = byte_level.exact.encode(" " + text, add_special_tokens=False).ids
    b = pieces.model.encode(text)
    alphabet = al.byte_alphabet()
    joined_a = bytes(alphabet[c] for i in a for c in byte_level.exact.id_to_token(i))
    names = [pieces.model.id_to_piece(i) for i in b]
    joined_b = b"".join(bytes.fromhex(n[3:5]) if pieces.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(b, names))
    return (a, b) if joined_a == joined_b == (" " + text).encode() else ([], [])


def merged(sides, a, b):
    """Links and group borders of one text by comparing all ranges of bytes."""
    ends = [np.cumsum([len(s.pieces[i]) for i in ids]).tolist() for s, ids in zip(sides.sides, (a, b))]
    starts = [[0, *e[:-1]] for e in ends]
    links = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(starts[0][i], starts[1][j]) < min(ends[0][i], ends[1][j])]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    return links, [(sum(e <= c for e in ends[0]), sum(e <= c for e in ends[1])) for c in cuts]


def expected(sides, rows):
    found, held = [], collections.Counter()
    for i, text in rows:
        a, b = whole(sides, text)
        links, cuts = merged(sides, a, b)
        found.append((i, a, b, links, cuts))
        held.update({(a[x], b[y]) for x, y in links})
    best = collections.Counter()
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for i, a, b, links, cuts in found:
        counts = [held[a[x], b[y]] for x, y in links]
        borders = [(0, 0), *cuts]
        groups = ";".join(",".join(map(str, a[p:r])) + "|" + ",".join(map(str, b[q:s])) for (p, q), (r, s) in zip(borders, cuts))
        out.append((i, len(a), len(b), len(cuts), len(links), sum(n == best[a[x]] for n, (x, _) in zip(counts, links)), sum(counts),
                    hashlib.sha256(groups.encode()).hexdigest() if a else ""))
    return out


def short(rows):
    return [(i, t if t is None else t[:3000]) for i, t in rows]


def test_support_equals_brute_force(spark, texts, sides):  # noqa: F811
    rows = short(EDGES + ODD + [(30, "the same words again"), (31, "the same words again")])
    found = al.link_support(texts(rows).repartition(3))
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert collections.Counter(map(tuple, found.collect())) == collections.Counter(expected(sides, rows))


def test_alignments_hold_tokens_links_and_cuts(spark, texts, sides):  # noqa: F811
    rows = [r for r in short(ODD) if r[0] is not None]
    for row in al.alignments(texts(rows)).collect():
        a, b = whole(sides, dict(rows)[row.doc_id])
        links, cuts = merged(sides, a, b)
        assert (row.a_ids, row.b_ids) == (a, b)
        assert list(zip(row.link_a, row.link_b)) == links and list(zip(row.cut_a, row.cut_b)) == cuts


def test_parts_encode_like_whole_texts(spark, sides):
    rows = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [t for _, t in ODD]
    found = al.Aligned([t.encode() for t in rows], sides)
    every = [whole(sides, t) for t in rows]
    assert found.ids[0].tolist() == sum((a for a, _ in every), []) and found.ids[1].tolist() == sum((b for _, b in every), [])


def test_lanes_change_nothing():
    rng = np.random.default_rng(3)
    for _ in range(50):
        ends = [np.unique(np.append(rng.integers(1, 300, rng.integers(1, 200)), 300)) for _ in range(2)]
        one = al.lockstep(*ends, np.array([0]))
        many = al.lockstep(*ends, np.unique(np.append(rng.integers(0, 300, 20), 0)))
        assert all(np.array_equal(x, y) for x, y in zip(one, many))


def test_words_forgotten_change_nothing(spark, texts, sides, monkeypatch):  # noqa: F811
    rows = [t.encode() for _, t in ODD]
    before = al.Aligned(rows, sides).ids
    monkeypatch.setattr(al, "WORDS", 3)
    for _ in range(2):
        assert all(np.array_equal(x, y) for x, y in zip(before, al.Aligned(rows, sides).ids))


def test_empty_table(spark, texts):  # noqa: F811
    assert al.link_support(texts([]), "doc_id").count() == 0
    assert al.link_support(texts([(1, None), (2, "")])).select("n_links", "groups_sha256").distinct().collect() == [(0, "")]
