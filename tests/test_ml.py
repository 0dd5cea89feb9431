"""Learners against closed forms and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright import ml
from tablewright.ml.models import assemble, fit_model
from tablewright.ml.neighbors import nearest


def brute_dbscan(x, eps, least):
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= least
    label, number = np.full(len(x), -1), 0
    for i in range(len(x)):
        if not core[i] or label[i] != -1:
            continue
        stack = [i]
        label[i] = number
        while stack:
            for j in np.nonzero(near[stack.pop()] & (label == -1))[0]:
                label[j] = number
                if core[j]:
                    stack.append(j)
        number += 1
    return label, core


@pytest.mark.parametrize("eps,least,d,few", [(0.3, 4, 2, 10**7), (0.3, 4, 2, 0), (1.0, 8, 2, 50), (0.4, 5, 3, 10**7), (0.05, 2, 1, 0)])
def test_dbscan_equals_brute_force(spark, monkeypatch, eps, least, d, few):
    from tablewright.ml import dbscan as module
    monkeypatch.setattr(module, "FEW_PAIRS", few)
    rng = np.random.default_rng(d * 7 + least)
    x = np.concatenate([rng.normal(c, 0.25, (60, d)) for c in (0, 1.2, 3)] + [rng.uniform(-2, 5, (25, d)), np.zeros((30, d))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, x array<double>").repartition(4)
    found = {r["id"]: (r["prediction"], r["core"]) for r in module.dbscan(df, {"eps": eps, "min_samples": least}).collect()}
    label, core = brute_dbscan(x, eps, least)
    assert found == {i: (int(label[i]), bool(core[i])) for i in range(len(x))}


@pytest.mark.parametrize("p,chunk", [(2.0, 50), (1.0, 10_000), (math.inf, 30), (3.0, 40)])
def test_neighbors_equal_brute_force(spark, p, chunk):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(300, 3)), rng.normal(size=(70, 3))
    a[:100] = 0.5  # a hot point

    def frame(x):
        return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, x array<double>").repartition(3)
    got = {(r["query"], r["rank"]): r["neighbor"] for r in nearest(frame(a), frame(b), 6, p, chunk_rows=chunk).collect()}
    gap = np.abs(b[:, None] - a[None])
    d = gap.max(-1) if math.isinf(p) else (gap ** p).sum(-1) ** (1 / p)
    best = np.argsort(d, axis=1, kind="stable")[:, :6]
    assert got == {(i, r + 1): int(best[i, r]) for i in range(70) for r in range(6)}


def test_dbscan_joins_send_nothing_through_the_driver(spark, monkeypatch):
    from tablewright.ml import dbscan as module
    plans, cut = [], module.settled
    monkeypatch.setattr(module, "settled", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()
                                                                   + df._jdf.queryExecution().sparkPlan().toString()) or cut(df))
    rows = [(i, [float(i % 40), float(i // 40)]) for i in range(1200)]
    found = module.dbscan(spark.createDataFrame(rows, "id long, x array<double>"), {"eps": 1.5, "min_samples": 4})
    plans.append(found._jdf.queryExecution().sparkPlan().toString())
    assert found.filter("core").count() == 1200
    # only the summary of the ranges in which clusters are numbered, one row each, is sent to all
    assert sum(p.count("BroadcastHashJoin") for p in plans) <= 1 and len(plans) > 5


def test_nearest_by_products_are_those_of_all_distances(monkeypatch):
    from tablewright.ml import neighbors as module
    rng, whole = np.random.default_rng(5), module.distances
    b = np.concatenate([rng.normal(size=(300, 8)) + 1e4, np.full((40, 8), 1e4)])
    b, a = np.concatenate([b, b[:50]]), np.concatenate([b[250:], rng.normal(size=(20, 8)) + 1e4])
    d = whole(a, b, 2)
    best = np.argsort(d, axis=1, kind="stable")[:, :7]
    assert np.allclose(module.euclidean(a, b), d, rtol=1e-7, atol=1e-12)
    monkeypatch.setattr(module, "distances", lambda *_: 1 / 0)  # one cheap product, not a difference of all pairs
    at, found = module.closest(a, b, 7, 2.0)
    assert (at == best).all() and (found == np.take_along_axis(d, best, axis=1)).all()


def shuffled(df):
    """The rows, and the rows that each of its shuffles wrote."""
    rows, written = df.collect(), []
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
            todo.append(plan.executedPlan() if kind == "AdaptiveSparkPlanExec" else plan.plan())
            continue
        if kind == "ShuffleExchangeExec":
            written.append(plan.metrics().apply("shuffleRecordsWritten").value())
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return rows, written


def test_neighbors_send_a_row_once_a_part_not_once_a_cell(spark):
    x = np.random.default_rng(8).normal(size=(3000, 40))  # so many dimensions that no cell is ruled out
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, x array<double>")
    found, written = shuffled(nearest(frame, frame.filter("id < 900"), 5))
    d = np.sqrt([((x - q) ** 2).sum(axis=1) for q in x[:900]])
    best = np.argsort(d, axis=1, kind="stable")[:, :5]
    assert {(r["query"], r["rank"]): r["neighbor"] for r in found} == {(i, j + 1): int(best[i, j]) for i in range(900) for j in range(5)}
    assert max(written) <= 3000 + 900


def asked_of_neighbors(spark, algorithm, k):
    """Predictions for 900 of 3000 rows, what each shuffle wrote, and the labels of the k nearest of each."""
    x = np.random.default_rng(13).normal(size=(3000, 20))
    y = [float(i % 7) for i in range(3000)]
    df = spark.createDataFrame([(i, v, *r.tolist()) for i, (v, r) in enumerate(zip(y, x))], ["id", "y", *[f"x{j}" for j in range(20)]])
    rows = assemble(df, [f"x{j}" for j in range(20)], "y").select("id", "features", "label")
    model = fit_model(algorithm, rows.select("features", "label"), {"n_neighbors": k})
    found, written = shuffled(model.transform(rows.filter("id < 900")))
    best = [np.argsort(((x - q) ** 2).sum(axis=1), kind="stable")[:k] for q in x[:900]]
    return {r["id"]: r["prediction"] for r in found}, written, [[y[i] for i in b] for b in best]


def test_knn_regressor_sends_a_row_once_a_part(spark):
    found, written, labels = asked_of_neighbors(spark, "knn-regressor", 5)
    assert found == {i: pytest.approx(sum(v) / 5) for i, v in enumerate(labels)}
    assert max(written) <= 3000 + 900


def test_knn_classifier_sends_a_row_once_a_part(spark):
    found, written, labels = asked_of_neighbors(spark, "knn-classifier", 7)
    assert found == {i: max(sorted(set(v)), key=v.count) for i, v in enumerate(labels)}
    assert max(written) <= 3000 + 900


def test_nearest_so_far_holds_few_rows():
    import pyarrow as pa
    from tablewright.ml import neighbors as module
    rng = np.random.default_rng(9)
    x, asked = rng.normal(size=(60_000, 3)), rng.normal(size=(40, 3))
    x[::3] = 0.25  # a hot point
    asked[:5] = 0.25
    x = x[np.argsort(-(x ** 2).sum(axis=1), kind="stable")]  # ever nearer, so all are taken for a while

    def batch(i, rows, **more):
        columns = {"x": pa.array(rows.tolist(), pa.list_(pa.float64())), "__at": pa.array(range(i, i + len(rows))), **more}
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    best, held = module._Nearest(7, 2.0), 0
    away = np.sqrt((asked ** 2).sum(axis=1))
    best.ask(batch(0, asked, __query=pa.array(range(40)), __away=pa.array(away), __bound=pa.array(np.full(40, np.inf))))
    for i in range(0, len(x), 1500):
        best.compare(batch(i, x[i:i + 1500]), 0, np.zeros(3), 0.0, np.inf, ["__at"])
        held = max(held, best.n_kept)
    assert held <= 4 * 7 * 40 + 10_000
    d = np.sqrt(((asked[:, None] - x[None]) ** 2).sum(-1))
    found = [r for b in best.found(["__at"], ["query", "neighbor", "distance"]) for r in b.to_pylist()]
    assert [r["neighbor"] for r in found] == np.argsort(d, axis=1, kind="stable")[:, :7].ravel().tolist()


@pytest.mark.parametrize("kind", ["far off", "tiny", "huge", "of all sizes", "copies", "whole"])
def test_neighbors_of_odd_sizes_equal_brute_force(spark, kind):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(400, 3))
    x = {"far off": x * 1e-3 + 1e6, "tiny": x * 1e-160, "huge": x * 1e150, "of all sizes": x * 10.0 ** rng.integers(-12, 12, (400, 1)),
         "copies": np.where(rng.random((400, 1)) < 0.5, x[0], x), "whole": np.round(x)}[kind]
    frame = spark.createDataFrame([(f"k{i:03}", r.tolist()) for i, r in enumerate(x)], "id string, x array<double>").repartition(5)
    found = {(r["query"], r["rank"]): r["neighbor"] for r in nearest(frame, frame, 4, chunk_rows=90).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    best = np.argsort(d, axis=1, kind="stable")[:, :4]
    assert found == {(f"k{i:03}", j + 1): f"k{best[i, j]:03}" for i in range(400) for j in range(4)}


def test_rows_without_finite_values_lose_no_others(spark):
    x = [[0.0, 0.0], [1.0, 0.0], [math.nan, 0.0], [3.0, math.inf], [6.0, 0.0], [None, 2.0]]
    frame = spark.createDataFrame(list(enumerate(x)), "id bigint, x array<double>")
    found = {(r["query"], r["rank"]): (r["neighbor"], r["distance"]) for r in nearest(frame, frame, 5).collect()}
    assert found == {(0, 1): (0, 0.0), (0, 2): (1, 1.0), (0, 3): (4, 6.0), (1, 1): (1, 0.0), (1, 2): (0, 1.0), (1, 3): (4, 5.0),
                     (4, 1): (4, 0.0), (4, 2): (1, 5.0), (4, 3): (0, 6.0)}


def test_knn_with_copies_and_distance_weights(spark):
    rows = [(0.0, 1.0), (0.0, 3.0), (0.0, 3.0), (4.0, 9.0), (10.0, 5.0)]
    df = assemble(spark.createDataFrame(rows, "x double, y double"), ["x"], "y").select("features", "label")
    model = ml.fit_model("knn-regressor", df, {"n_neighbors": 3, "weights": "distance"})
    asked = spark.createDataFrame([(1.0,), (1.0,), (4.0,), (0.0,)], "x double")
    out = sorted((r["x"], round(r["prediction"], 6)) for r in model.transform(assemble(asked, ["x"])).collect())
    assert out == [(0.0, round(7 / 3, 6)), (1.0, round(7 / 3, 6)), (1.0, round(7 / 3, 6)), (4.0, 9.0)]


def test_split_sizes_are_exact_and_stable(spark):
    df = spark.range(101).withColumn("c", F.col("id") % 2)
    a, b = ml.split_rows(df, 0.2, seed=1)
    assert (a.count(), b.count()) == (80, 21)
    again = ml.split_rows(df.repartition(9), 0.2, seed=1)[1]
    assert sorted(r["id"] for r in b.collect()) == sorted(r["id"] for r in again.collect())
    small, _ = ml.split_rows(df, 0.2, train_size=0.5, seed=1)
    assert small.count() == 50
    copies = spark.range(10).select(F.lit(1).alias("same"))
    assert [x.count() for x in ml.split_rows(copies, 0.3)] == [7, 3]
    a, b = ml.split_rows(df, 0.2, shuffle=False, order_by="id")
    assert sorted(r["id"] for r in b.collect()) == list(range(80, 101))


def test_prepare_fills_from_training_rows(spark):
    df = spark.range(50).select("id", F.when(F.col("id") % 5 > 0, F.col("id").cast("double")).alias("x"),
                                F.when(F.col("id") % 4 > 0, F.concat(F.lit("w"), F.col("id") % 3)).alias("w"),
                                F.when(F.col("id") != 7, F.col("id") * 2.0).alias("y"))
    ready = ml.prepare(df, "y", ["id"], test_size=0.2)
    assert ready.features == ["x", "w_w1", "w_w2"] and ready.train.count() + ready.test.count() == 49
    assert ready.train.filter("x IS NULL OR w_w1 IS NULL").count() == 0
    mean = df.filter("y IS NOT NULL").agg(F.avg("x")).first()[0]
    assert ml.prepare(df, "y", ["id"], leaky=True).rules.numeric["x"] == pytest.approx(mean)
    assert ready.rules.numeric["x"] != pytest.approx(mean)


def test_logistic_regression_meets_its_optimum(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    y = (x @ [1.5, -1.0] + rng.normal(size=300) > 0).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    rows = assemble(df, ["a", "b"], "y").select("features", "label")
    model = ml.fit_model("logistic-regression", rows, {"C": 0.5, "tol": 1e-10, "max_iter": 500})
    w, b = np.array(model.coefficients), model.intercept
    miss = 1 / (1 + np.exp(-(x @ w + b))) - y
    assert np.allclose(w + 0.5 * (x.T @ miss), 0, atol=1e-3) and abs(miss.sum()) < 1e-3


@pytest.mark.parametrize("name,params", [("adaboost-classifier", {"n_estimators": 12}), ("xgboost-classifier", {"n_estimators": 3}),
                                         ("svm-classifier", {"max_iter": 30}), ("random-forest-classifier", {"n_estimators": 5, "max_depth": 4})])
def test_classifiers_learn_three_classes(spark, name, params):
    df = spark.range(240).select(((F.col("id") % 3) * 3 + F.sin("id")).alias("x"), F.cos("id").alias("z"), (F.col("id") % 3).cast("int").alias("y"))
    found = ml.train(df, name, "y", params=params, stratify="y").metrics.first()
    assert found["accuracy"] > 0.6


def stump(x, y, w):
    """Weighted least-squares split at the middle between two values."""
    best = None
    for cut in (np.unique(x)[:-1] + np.unique(x)[1:]) / 2:
        low = x <= cut
        sides = [np.average(y[s], weights=w[s]) for s in (low, ~low)]
        fit = np.where(low, *sides)
        loss = (w * (y - fit) ** 2).sum()
        if best is None or loss < best[0] - 1e-15:
            best = loss, fit
    return best[1]


@pytest.mark.parametrize("loss", ["linear", "square", "exponential"])
def test_boosted_regression_equals_the_plain_algorithm(spark, loss):
    x = np.arange(60) / 6.0
    y = np.sin(x) + x / 5
    w, fits, weights = np.full(60, 1 / 60), [], []
    for _ in range(5):
        fit = stump(x, y, w)
        e = np.abs(y - fit) / np.abs(y - fit).max()
        e = {"linear": e, "square": e ** 2, "exponential": 1 - np.exp(-e)}[loss]
        average = (w * e).sum() / w.sum()
        if average >= 0.5:  # worse than chance: dropped, unless it is all there is
            if not fits:
                fits, weights = [fit], [1.0]
            break
        beta = average / (1 - average)
        fits.append(fit)
        weights.append(math.log(1 / beta))
        w = w * beta ** (1 - e)
        w = w / w.sum()
    order = np.argsort(np.array(fits), axis=0)
    run = np.cumsum(np.array(weights)[order], axis=0)
    pick = (run >= 0.5 * sum(weights)).argmax(axis=0)
    want = np.array(fits)[order[pick, np.arange(60)], np.arange(60)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    rows = assemble(df, ["x"], "y")
    model = ml.fit_model("adaboost-regressor", rows.select("features", "label"),
                         {"n_estimators": 5, "max_depth": 1, "max_bins": 64, "loss": loss})
    got = [r["prediction"] for r in model.transform(rows).orderBy("x").collect()]
    assert np.allclose(got, want, atol=1e-8)


def test_refused_options(spark):
    df = assemble(spark.range(5).select(F.col("id").cast("double").alias("x"), "id"), ["x"], "id").select("features", "label")
    for name, params in (("svm-classifier", {"kernel": "rbf"}), ("linear-regression", {"positive": True}), ("nothing", {}),
                         ("gradient-boosting-regressor", {"loss": "huber"}), ("knn-classifier", {"weights": "odd"})):
        with pytest.raises(ValueError):
            ml.fit_model(name, df, params)


def test_metrics_edges(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "label double, prediction double")
    assert ml.regression_metrics(df).first()["r2"] == 1.0
    cells = spark.createDataFrame([(0, 1), (0, 0), (2, 0)], "label int, prediction int")
    assert [r["count"] for r in ml.confusion_matrix(cells).collect()] == [1, 1, 0, 0, 0, 0, 1, 0, 0]
    found = ml.classification_metrics(cells).first()
    assert found["accuracy"] == pytest.approx(1 / 3) and found["precision"] == pytest.approx(1 / 3)


def test_kmeans_and_dbscan_through_train(spark):
    df = spark.range(90).select("id", ((F.col("id") % 3) * 10 + F.sin("id")).alias("x"), ((F.col("id") % 3) * 10 + F.cos("id")).alias("y"))
    k = ml.train(df, "kmeans", excluded=["id"], params={"n_clusters": 3}).metrics.first()
    assert k["clusters"] == 3 and k["silhouette"] > 0.8 and k["inertia"] == pytest.approx(90, rel=0.1)
    d = ml.train(df, "dbscan", excluded=["id"], params={"eps": 1.5, "min_samples": 4, "id": "id"}).metrics.first()
    assert d["clusters"] == 3


def test_run_history(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert ml.read_runs(spark, path).count() == 0
    assert ml.append_run(spark, path, "kmeans", {"k": 2}, {"silhouette": 0.4, "inertia": 9.0}) == 1
    assert ml.append_run(spark, path, "kmeans", {"k": 3}, {"silhouette": 0.7, "inertia": None}) == 2
    assert ml.append_run(spark, path, "dbscan", {}, {"silhouette": 0.1, "inertia": 3.0}) == 3
    best = {r["metric"]: r["run_id"] for r in ml.best_runs(ml.read_runs(spark, path)).collect()}
    assert best == {"silhouette": 2, "inertia": 3}
    ml.delete_run(spark, path, 3)
    assert {r["run_id"]: r["active"] for r in ml.read_runs(spark, path).collect()} == {1: False, 2: True}
    assert ml.append_run(spark, path, "dbscan", {}, {}) == 4


def test_parameters_without_effect_are_refused(spark):
    from tablewright.ml.models import check_parameters
    for name, params in (("decision-tree-regressor", {"no_such": 1}), ("xgboost-regressor", {"reg_lambda": 5}), ("random-forest-classifier", {"ccp_alpha": 0.1})):
        with pytest.raises(ValueError, match="honour"):
            check_parameters(name, params)
    check_parameters("decision-tree-regressor", {"min_samples_split": 2, "max_depth": 3})
    df = assemble(spark.createDataFrame([(1.0, 2.0), (2.0, 3.0)], "x double, y double"), ["x"], "y").select("features", "label")
    with pytest.raises(ValueError, match="30"):
        fit_model("decision-tree-regressor", df, {"max_depth": 99})


def test_silhouette_of_all_rows(spark):
    import numpy as np
    from tablewright.ml.metrics import silhouette
    rng = np.random.default_rng(1)
    x, c = rng.normal(size=(40, 3)), rng.integers(0, 3, 40)
    c[0] = 7  # a cluster of one
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    scores = []
    for i in range(40):
        mine = (c == c[i]) & (np.arange(40) != i)
        if not mine.any():
            scores.append(0.0)
            continue
        a, b = d[i, mine].mean(), min(d[i, c == k].mean() for k in set(c) - {c[i]})
        scores.append((b - a) / max(a, b))
    points = spark.createDataFrame([(i, x[i].tolist(), int(c[i])) for i in range(40)], "id long, x array<double>, prediction int")
    assert abs(silhouette(points) - np.mean(scores)) < 1e-9
    assert silhouette(points.filter("prediction = 7")) is None


def test_plain_silhouette_of_all_rows(spark, monkeypatch):
    import numpy as np
    from tablewright.catalog import modelling
    from tablewright.ml import metrics
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 1.0, (60, 3)) for c in (0, 2, 5)] + [np.full((5, 3), 9.0), np.full((1, 3), -4.0)])
    x[1], label = x[0], np.repeat([0, 1, 2, 3, 7], [60, 60, 60, 5, 1])
    points = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label))], "id long, x array<double>, prediction int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    scores = []
    for i, c in enumerate(label):
        if (label == c).sum() == 1:
            scores.append(0.0)
            continue
        a = d[i, label == c].sum() / ((label == c).sum() - 1)
        b = min(d[i, label == o].mean() for o in set(label) - {c})
        scores.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    for rows in (40, 1000):
        assert abs(metrics.euclidean_silhouette(points, rows) - np.mean(scores)) < 1e-9
    assert metrics.euclidean_silhouette(points.filter("prediction = 7")) is None

    # the registered query covers all rows: a sample of any size is a caller's option
    def refused(*args, **kwargs):
        raise AssertionError("sampled")
    monkeypatch.setattr(metrics, "sampled_silhouette", refused)
    assert modelling._clustering(spark, "/root/testdata/sf0.001").first()["silhouette"] is not None


def test_many_text_values_stay_a_table(spark, monkeypatch):
    """More values than are kept inline: numbered as a table, the same vectors, nothing listed for training."""
    import importlib
    p = importlib.import_module("tablewright.ml.prepare")
    from tablewright.operators import encoding
    df = spark.createDataFrame([(float(i % 7), f"w{i % 40:02d}" if i % 11 else None, float(i)) for i in range(400)], "x double, w string, y double")
    few = p.feature_rules(df, ["x", "w"])
    wide = [tuple(r) for r in few.vectors(df, ["y"]).orderBy("y").collect()]
    monkeypatch.setattr(encoding, "INLINE_CATEGORIES", 5)
    monkeypatch.setattr(p.Flags, "values", property(lambda self: 1 / 0))
    many = p.feature_rules(df, ["x", "w"])
    assert many.text["w"][1].codes.table is not None and few.text["w"][1].codes.table is None
    assert [tuple(r) for r in many.vectors(df, ["y"]).orderBy("y").collect()] == wide
    unseen = spark.createDataFrame([(1.0, "never", 0.0), (1.0, "w00", 1.0), (1.0, "w01", 2.0)], df.schema)
    assert [r.features.toArray().nonzero()[0].tolist() for r in many.vectors(unseen, ["y"]).orderBy("y").collect()] == [[0], [0], [0, 1]]
