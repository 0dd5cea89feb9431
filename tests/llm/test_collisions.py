"""Collision-counting nearest neighbours against brute force."""

import math

import numpy as np
import pytest

from tablewright.llm import collisions as cc

SCHEMA = "vec_id long, embedding array<float>, label int, id string, vector string, asks int"


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, "x", "y", 2) for i, v in rows], SCHEMA.replace("float", kind))


def product(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += x * y
    return total


def brute(rows, every=20, most=20):
    usable = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for k, (i, v) in enumerate(usable):
        if i is not None and i % every == 0 and (i, v) not in [(a, b) for a, b in usable[:k]]:
            rest = [(product(w, v), j) for m, (j, w) in enumerate(usable) if m != k and len(w) == len(v)]
            rest.sort(key=lambda x: (-x[0], x[1] is None, x[1]))
            out.setdefault(i, []).append([(r + 1, j, s) for r, (s, j) in enumerate(rest[:most])])
    return out


def found_by(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def floats(rng, n, dims):
    return [[float(x) for x in v.astype(np.float32)] for v in rng.normal(size=(n, dims))]


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(k, v) for k, v in enumerate(floats(rng, 60, 6))] + [(None, v) for v in floats(rng, 5, 6)] + [(100 + k, v) for k, v in enumerate(floats(rng, 45, 3))]
    same = rows[3][1]
    rows += [(200, None), (220, [0.0] * 6), (240, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (260, [float("nan")] * 6), (280, [float("inf")] + [1.0] * 5), (300, []),
             *[(k, same) for k in range(400, 445)], (320, [7.0, 8.0]), (40, rows[40][1]), (41, rows[41][1]), (340, [float(np.float32(1e-20))] * 6), (360, [float(np.float32(1e18))] * 6)]
    assert found_by(cc.nearest(table(spark, rows).repartition(3), cc.F.col("vec_id") % 20 == 0)) == {i: lists[0] for i, lists in brute(rows).items()
                                                                                                     if lists[0]}


def test_columns_and_empty_tables(spark):
    found = cc.nearest(table(spark, []), cc.F.col("vec_id") % 20 == 0)
    assert found.columns == ["query_id", "rank", "vec_id", "score"] and found.count() == 0
    assert cc.nearest(table(spark, [(1, [1.0])]), cc.F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("shape", ["sphere", "norms", "clusters", "copies"])
def test_recall(spark, monkeypatch, kind, shape):
    monkeypatch.setattr(cc, "BLOCK", 300)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 24))
    if shape == "sphere":
        x /= np.linalg.norm(x, axis=1)[:, None]
    elif shape == "norms":
        x *= np.exp(rng.normal(size=2000))[:, None]
    elif shape == "clusters":
        x = rng.normal(size=(20, 24))[rng.integers(0, 20, 2000)] + 0.1 * x
    else:
        x[rng.random(2000) < 0.4] = x[0]
    rows = [(k, [float(y) for y in (v.astype(np.float32) if kind == "float" else v)]) for k, v in enumerate(x)]
    found = found_by(cc.nearest(table(spark, rows, kind).repartition(4), cc.F.col("vec_id") % 20 == 0, seed_rows=400, query_bytes=8000))
    right = {i: lists[0] for i, lists in brute(rows).items()}
    assert set(found) == set(right)
    assert all([r for r, _, _ in f] == list(range(1, 21)) for f in found.values())
    assert all(s == product(rows[i][1], rows[j][1]) and i != j for i, f in found.items() for _, j, s in f)
    hits = sum(len({j for _, j, _ in found[i]} & {j for _, j, _ in right[i]}) for i in right)
    assert hits >= 0.93 * 20 * len(right)
    if shape == "copies":
        assert all(found[i] == right[i] for i in right if x[i].tolist() == x[0].tolist())


def test_recall_on_the_given_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in vectors.collect()]
    found, x = found_by(cc.nearest(vectors, cc.F.col("vec_id") % 20 == 0)), np.array([v for _, v in rows])
    near = x @ x.T
    np.fill_diagonal(near, -9)
    hits = sum(len({rows[j][0] for j in np.argsort(-near[k])[:20]} & {j for _, j, _ in found[i]}) for k, (i, _) in enumerate(rows) if i % 20 == 0)
    assert hits >= 0.95 * 20 * len(found)


def test_both_ways_of_counting_agree(monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 16))
    layer = cc.Layer(np.arange(500), x, np.linalg.norm(x, axis=1))
    for k in range(20):
        at, results = layer.axes[:, :-1] @ x[k], []
        for walked in (0, 2):
            monkeypatch.setattr(cc, "WALKED", walked)
            seen = None
            for radius in (0.5, 1.0, 3.0, 8.0):
                seen, rows = layer.frequent(at, radius, seen)
                results.append((walked, radius, rows.tolist(), np.asarray(seen[1]).tolist()))
        half = len(results) // 2
        assert [r[1:] for r in results[:half]] == [r[1:] for r in results[half:]]
        low, high = seen[0]
        inside = [set(o[a:b].tolist()) for o, a, b in zip(layer.order, low, high)]
        assert results[-1][3] == [sum(i in s for s in inside) for i in range(500)]
