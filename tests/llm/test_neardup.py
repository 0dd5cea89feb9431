import itertools
import random

import numpy as np
import pytest
import xxhash

from llm_data import EDGES, texts  # noqa: F401
from tablewright.llm.components import components
from tablewright.llm.neardup import BITS, GrayIndex, _masks, fingerprint, fingerprint_links, forest, gray_rank, near_duplicates, one_of_each


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ")
             .replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(codes, most=2):
    label = list(range(len(codes)))
    for i, j in itertools.combinations(range(len(codes)), 2):
        if (int(codes[i]) ^ int(codes[j])).bit_count() <= most and label[i] != label[j]:
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = [new if x == old else x for x in label]
    return label


def near_codes(seed, n, centres=6):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(centres)]
    out = set()
    while len(out) < n:
        code = rng.choice(base)
        for _ in range(rng.randrange(6)):
            code ^= 1 << rng.randrange(64)
        out.add(code)
    return np.array(sorted(out), dtype=np.uint64)


@pytest.mark.parametrize("text", ["", None, "One", "one TWO", "a b c a b c a b c", "Ärger\x0bund\x0cÄrger x y", "w " * 70000])
def test_fingerprint(text):
    assert fingerprint((text or "").encode()) == brute_fingerprint(text)


def test_gray_rank_inverts_the_gray_code():
    n = np.arange(1000, dtype=np.uint64)
    assert (gray_rank(n ^ (n >> np.uint64(1))) == n).all()


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 500])
def test_index_finds_all_pairs(n):
    codes = near_codes(n, n)
    index = GrayIndex(codes)
    found = {(int(a), int(b)) for i, j in index.within(2) for a, b in zip(index.codes[i], index.codes[j])}
    assert found == {(int(a), int(b)) for a in codes for b in codes if (int(a) ^ int(b)).bit_count() <= 2}


def test_forest_has_the_groups_of_all_pairs():
    codes = near_codes(1, 300)
    a, b = forest(codes, 2)
    place = {int(c): i for i, c in enumerate(codes)}
    label = list(range(len(codes)))
    for x, y in zip(a, b):
        old, new = label[place[int(x)]], label[place[int(y)]]
        label = [new if v == old else v for v in label]
    expected = brute_groups(codes)
    pairs = lambda ls: {tuple(x == y for y in ls) for x in ls}
    assert pairs(label) == pairs(expected) and len(a) < len(codes)


def test_masks_keep_every_close_pair_together():
    rng = random.Random(3)
    for masks in _masks(2):
        for _ in range(200):
            gone = sum(1 << b for b in rng.sample(range(BITS), 2))
            assert any(not gone & m for m in masks)


@pytest.mark.parametrize("bucket", [1024, 4])
def test_links_connect_groups(spark, monkeypatch, bucket):
    monkeypatch.setattr("tablewright.llm.neardup.BUCKET", bucket)  # 4: hot buckets are cut twice more
    codes = near_codes(5, 150, centres=3)
    rows = spark.createDataFrame([(int(c) - (1 << 64) if int(c) >> 63 else int(c),) for c in codes], "fp long")
    found = {r.node: r.root for r in components(fingerprint_links(rows)).collect()}
    ids = [r.fp for r in rows.collect()]
    labels = [found.get(i, i) for i in ids]
    expected = brute_groups(codes)
    assert [[x == y for y in labels] for x in labels] == [[x == y for y in expected] for x in expected]


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1001 + i) for i in range(300)] + [(5, 5), (None, 3)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(1, 61)}, **{1001 + i: 1000 for i in range(300)}}


def test_operator_against_brute_force(texts):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(40):
        base = [rng.choice(words) for _ in range(300)]
        rows.append((3 * i, " ".join(base)))
        for k in range(rng.randrange(3)):
            copy = list(base)
            copy[rng.randrange(300)] = rng.choice(words)
            rows.append((3 * i + 1 + k, " ".join(copy)))
    rows += [(900, ""), (901, None)]
    found = {r.doc_id: r for r in near_duplicates(texts(rows)).collect()}
    codes = [brute_fingerprint(t) for _, t in rows]
    label = brute_groups(codes)
    assert len(found) == len(rows)
    for (i, _), code, group in zip(rows, codes, label):
        assert found[i].fingerprint == f"{code:016x}"
        assert found[i].component_id == min(j for (j, _), g in zip(rows, label) if g == group)


def test_edges(texts):
    found = near_duplicates(texts(EDGES)).collect()
    assert len(found) == len(EDGES)
    assert {r.component_id for r in found if r.doc_id in (1, 2, 3)} == {1}
    assert {r.component_id for r in found if r.doc_id in (4, 5)} == {4}
    assert [r.component_id for r in found if r.doc_id is None] == [None]
    kept = one_of_each(texts(EDGES))
    assert kept.columns == ["doc_id", "text", "id", "label"]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 4, 6, 7, None]
    assert near_duplicates(texts([])).collect() == [] and one_of_each(texts([])).collect() == []


def test_one_row_of_each_group_without_or_with_a_repeated_id(texts):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(None, a), (None, a), (None, b), (1, c), (1, d), (2, d), (None, d)]
    kept = one_of_each(texts(rows)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("1", c), ("1", d), ("None", a), ("None", b)]
