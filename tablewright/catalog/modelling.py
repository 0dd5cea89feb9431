"""Preparation, training, metrics and run comparison."""

from pyspark.sql import functions as F

from ..ml import best_runs, classification_metrics, clustering_metrics, confusion_matrix, regression_metrics, split_rows, train
from ..ml.dbscan import dbscan
from ..ml.models import assemble, fit_model
from ..ml.neighbors import nearest
from ..ml.prepare import choose_columns, feature_rules
from .base import NULLED_SEGMENT, query, rounded, source, table


# preparation

@query("feature_columns", """SELECT unnest(['c_name', 'c_nationkey', 'c_mktsegment']) AS feature, 'c_acctbal' AS target,
                             count(*) AS filled FROM customer""")
def _feature_columns(spark, sf_dir):
    df = table(spark, sf_dir, "customer").filter("c_acctbal IS NOT NULL")
    target, features = choose_columns(df, "c_acctbal", ["c_custkey"])
    filled = [F.struct(F.lit(c).alias("feature"), F.lit(target).alias("target"), F.count(c).alias("filled")) for c in features]
    return df.agg(F.array(*filled).alias("f")).select(F.inline("f"))


@query("prepared_features", """WITH s AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_mktsegment END AS seg,
    CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal END AS bal FROM customer),
    f AS (SELECT c_custkey, coalesce(bal, (SELECT avg(bal) FROM s)) AS bal, coalesce(seg, (SELECT seg FROM s WHERE seg IS NOT NULL
    GROUP BY seg ORDER BY count(*) DESC, seg LIMIT 1)) AS seg FROM s)
    SELECT c_custkey, round(bal, 6) AS bal, CAST(CAST(seg = 'BUILDING' AS INT) AS DOUBLE) AS seg_BUILDING,
    CAST(CAST(seg = 'FURNITURE' AS INT) AS DOUBLE) AS seg_FURNITURE,
    CAST(CAST(seg = 'HOUSEHOLD' AS INT) AS DOUBLE) AS seg_HOUSEHOLD FROM f""")
def _prepared(spark, sf_dir):
    df = source(spark, sf_dir, NULLED_SEGMENT.replace(
        "c_acctbal,", "CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal END AS bal,"))
    rules = feature_rules(df, ["bal", "seg"])
    return rounded(rules.apply(df, ["c_custkey"]))


@query("split_sizes", """SELECT count(*) - CAST(ceil(0.2 * count(*)) AS BIGINT) AS train_rows,
                         CAST(ceil(0.2 * count(*)) AS BIGINT) AS test_rows FROM lineitem""")
def _split(spark, sf_dir):
    a, b = split_rows(table(spark, sf_dir, "lineitem"), 0.2, seed=48)
    return spark.createDataFrame([(a.count(), b.count())], "train_rows bigint, test_rows bigint")


@query("split_by_class", """WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1),
    t AS (SELECT sum(n) AS total, ceil(0.25 * sum(n)) AS wanted FROM c),
    q AS (SELECT event_type, n, floor(wanted * n / total) AS base, wanted * n / total - floor(wanted * n / total) AS rest, wanted FROM c, t),
    r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, event_type) AS i, wanted - sum(base) OVER () AS more FROM q)
    SELECT event_type, CAST(base + CASE WHEN i <= more THEN 1 ELSE 0 END AS BIGINT) AS test_rows,
    CAST(n - base - CASE WHEN i <= more THEN 1 ELSE 0 END AS BIGINT) AS train_rows FROM r""")
def _stratified(spark, sf_dir):
    a, b = split_rows(table(spark, sf_dir, "events"), 0.25, stratify="event_type", key=["event_id"])
    side = a.withColumn("test", F.lit(0)).unionByName(b.withColumn("test", F.lit(1)))
    return side.groupBy("event_type").agg(F.count_if(F.col("test") == 1).alias("test_rows"),
                                          F.count_if(F.col("test") == 0).alias("train_rows"))


@query("split_in_order", """SELECT event_id, CASE WHEN row_number() OVER (ORDER BY ts) > count(*) OVER () - ceil(0.3 * count(*) OVER ())
                            THEN 'test' ELSE 'train' END AS part FROM events""")
def _in_order(spark, sf_dir):
    a, b = split_rows(table(spark, sf_dir, "events"), 0.3, shuffle=False, order_by="ts")
    return a.select("event_id", F.lit("train").alias("part")).unionByName(b.select("event_id", F.lit("test").alias("part")))


# linear models with one feature have closed forms

_SUMS = """(SELECT sum((x - mx) * (y - my)) AS sxy, sum((x - mx) * (x - mx)) AS sxx, count(*) AS n, any_value(mx) AS mx,
    any_value(my) AS my FROM (SELECT l_quantity AS x, l_extendedprice AS y, avg(l_quantity) OVER () AS mx,
    avg(l_extendedprice) OVER () AS my FROM lineitem))"""


def _linear(name, algorithm, params, slope):
    sql = f"SELECT round({slope}, 3) AS slope, round(my - mx * ({slope}), 3) AS intercept FROM {_SUMS}"

    def run(spark, sf_dir):
        rows = assemble(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice").select("features", "label")
        model = fit_model(algorithm, rows, params)
        coefficients = [(float(model.coefficients[0]), float(model.intercept))]
        return rounded(spark.createDataFrame(coefficients, "slope double, intercept double"), 3)

    query(name, sql)(run)


_linear("linear_regression", "linear-regression", {}, "sxy / sxx")
_linear("ridge_regression", "ridge-regression", {"alpha": 250000.0}, "sxy / (sxx + 250000.0)")
_linear("lasso_regression", "lasso-regression", {"alpha": 400.0, "tol": 1e-10},
        "sign(sxy) * greatest(abs(sxy / n) - 400.0, 0) / (sxx / n)")
_linear("elasticnet", "elasticnet", {"alpha": 300.0, "l1_ratio": 0.4, "tol": 1e-10},
        "sign(sxy) * greatest(abs(sxy / n) - 120.0, 0) / (sxx / n + 180.0)")

# other learners: trained and measured; their values have no SQL counterpart

_PRICE = "SELECT l_quantity, l_discount, l_tax, l_quantity * 2000 * (1 - l_discount) AS cost FROM lineitem"


def _regressor(name, algorithm, params):
    def run(spark, sf_dir):
        return train(source(spark, sf_dir, _PRICE), algorithm, "cost", params=params).metrics
    query(name)(run)


_regressor("decision_tree_regressor", "decision-tree-regressor", {"max_depth": 6})
_regressor("random_forest_regressor", "random-forest-regressor", {"max_depth": 5, "n_estimators": 8})
_regressor("gradient_boosting_regressor", "gradient-boosting-regressor", {"n_estimators": 8})
_regressor("xgboost_regressor", "xgboost-regressor", {"n_estimators": 5, "max_depth": 4})
_regressor("adaboost_regressor", "adaboost-regressor", {"n_estimators": 6})


def _vectors(spark, sf_dir, two_classes: bool = False):
    df = table(spark, sf_dir, "embeddings")
    label = (F.col("label") >= 5).cast("int") if two_classes else F.col("label")
    length = df.agg(F.max(F.size("embedding"))).first()[0] or 0
    return df.select("vec_id", label.alias("label"), *[F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(length)])


def _classifier(name, algorithm, params, two_classes=True):
    def run(spark, sf_dir):
        df = _vectors(spark, sf_dir, two_classes)
        return train(df, algorithm, "label", ["vec_id"], params, stratify="label").metrics
    query(name)(run)


_classifier("logistic_regression", "logistic-regression", {}, False)
_classifier("decision_tree_classifier", "decision-tree-classifier", {"max_depth": 5}, False)
_classifier("random_forest_classifier", "random-forest-classifier", {"max_depth": 5, "n_estimators": 10}, False)
_classifier("svm_classifier", "svm-classifier", {"kernel": "linear", "max_iter": 20})
_classifier("xgboost_classifier", "xgboost-classifier", {"n_estimators": 4, "max_depth": 3})
_classifier("adaboost_classifier", "adaboost-classifier", {"n_estimators": 6}, False)

# neighbours and naive Bayes have exact counterparts

_PAIRS = """SELECT a.vec_id AS query, b.vec_id AS neighbor, b.label, sqrt(list_sum(list_transform(range(1, 65),
    lambda i: pow(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE), 2)))) AS distance FROM embeddings a, embeddings b"""
_RANKED = f"(SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbor) AS rank FROM ({_PAIRS}))"


def _points(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    return df.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"), "label")


@query("nearest_neighbors", f"SELECT query, neighbor, round(distance, 6) AS distance, CAST(rank AS INT) AS rank FROM {_RANKED} WHERE rank <= 5")
def _nearest(spark, sf_dir):
    points = _points(spark, sf_dir)
    return rounded(nearest(points.select("id", "x"), points.select("id", "x"), 5))


def _fitted_on_all(spark, sf_dir, algorithm, params):
    df = _vectors(spark, sf_dir)
    rows = assemble(df, [c for c in df.columns if c not in ("vec_id", "label")], "label").select("vec_id", "features", "label")
    model = fit_model(algorithm, rows.select("features", "label"), params)
    return model.transform(rows).select("vec_id", "prediction")


@query("knn_regressor", f"SELECT query AS vec_id, round(avg(label), 6) AS prediction FROM {_RANKED} WHERE rank <= 5 GROUP BY 1")
def _knn_regressor(spark, sf_dir):
    return rounded(_fitted_on_all(spark, sf_dir, "knn-regressor", {}))


@query("knn_classifier", f"""SELECT query AS vec_id, CAST(label AS DOUBLE) AS prediction FROM (SELECT query, label,
    row_number() OVER (PARTITION BY query ORDER BY count(*) DESC, label) AS i FROM {_RANKED} WHERE rank <= 7 GROUP BY 1, 2) WHERE i = 1""")
def _knn_classifier(spark, sf_dir):
    return _fitted_on_all(spark, sf_dir, "knn-classifier", {"n_neighbors": 7})


@query("naive_bayes", """WITH v AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
    e AS (SELECT 1e-9 * max(v) AS e FROM (SELECT var_pop(x) AS v FROM v GROUP BY i)),
    m AS (SELECT label AS c, i, avg(x) AS mu, var_pop(x) + any_value(e) AS s FROM v, e GROUP BY 1, 2),
    p AS (SELECT label AS c, ln(count(*) / (SELECT count(*) FROM embeddings)) AS prior FROM embeddings GROUP BY 1),
    j AS (SELECT vec_id, m.c, any_value(prior) - 0.5 * sum(ln(2 * pi() * s) + pow(x - mu, 2) / s) AS score
    FROM v JOIN m USING (i) JOIN p ON p.c = m.c GROUP BY 1, 2)
    SELECT vec_id, CAST(arg_max(c, score) AS DOUBLE) AS prediction FROM j GROUP BY 1""")
def _bayes(spark, sf_dir):
    return _fitted_on_all(spark, sf_dir, "naive-bayes", {})


# clustering

@query("kmeans")
def _kmeans(spark, sf_dir):
    return train(_vectors(spark, sf_dir), "kmeans", excluded=["vec_id", "label"], params={"n_clusters": 10, "max_iter": 20}).metrics


def _plane(spark, sf_dir):
    xy = F.array(F.col("value"), F.col("user_id").cast("double"))
    return dbscan(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), xy.alias("x")), {"eps": 1.5, "min_samples": 6})


@query("dbscan_core_points", """SELECT a.event_id AS id, count(*) >= 6 AS core FROM events a JOIN events b
    ON b.value BETWEEN a.value - 1.5 AND a.value + 1.5 AND b.user_id BETWEEN a.user_id - 1 AND a.user_id + 1
    AND pow(a.value - b.value, 2) + pow(a.user_id - b.user_id, 2) <= 2.25 GROUP BY 1""")
def _core(spark, sf_dir):
    return _plane(spark, sf_dir).select("id", "core")


@query("dbscan")
def _dbscan(spark, sf_dir):
    return _plane(spark, sf_dir).select("id", "prediction", "core")


# metrics

_GUESS = "SELECT l_extendedprice AS label, l_quantity * 2100.0 AS prediction FROM lineitem"


@query("regression_metrics", f"""SELECT round(avg(abs(label - prediction)), 4) AS mae, round(avg(pow(label - prediction, 2)), 0) AS mse,
    round(sqrt(avg(pow(label - prediction, 2))), 4) AS rmse, round(1 - avg(pow(label - prediction, 2)) / var_pop(label), 4) AS r2 FROM ({_GUESS})""")
def _regression(spark, sf_dir):
    df = regression_metrics(source(spark, sf_dir, _GUESS))
    return df.select(F.round("mae", 4).alias("mae"), F.round("mse", 0).alias("mse"), F.round("rmse", 4).alias("rmse"), F.round("r2", 4).alias("r2"))


_CLASSES = """SELECT CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS label,
              CASE WHEN value < 20 THEN 0 WHEN value < 60 THEN 1 ELSE 2 END AS prediction FROM events"""


@query("classification_metrics", f"""WITH v AS ({_CLASSES}), n AS (SELECT unnest([0, 1, 2]) AS c),
    t AS (SELECT c, count(*) FILTER (label = c) AS a, count(*) FILTER (prediction = c) AS p,
    count(*) FILTER (label = c AND prediction = c) AS r FROM v, n GROUP BY c)
    SELECT round(sum(r) / sum(a), 6) AS accuracy, round(sum(a * r / p) / sum(a), 6) AS precision,
    round(sum(a * r / a) / sum(a), 6) AS recall, round(sum(a * 2 * r / (a + p)) / sum(a), 6) AS f1 FROM t""")
def _classification(spark, sf_dir):
    return rounded(classification_metrics(source(spark, sf_dir, _CLASSES)))


@query("confusion_matrix", f"""WITH v AS ({_CLASSES}), n AS (SELECT unnest([0, 1, 2]) AS c)
    SELECT CAST(a.c AS DOUBLE) AS actual, CAST(b.c AS DOUBLE) AS predicted,
    count(*) FILTER (label = a.c AND prediction = b.c) AS count FROM v, n a, n b GROUP BY 1, 2""")
def _confusion(spark, sf_dir):
    return confusion_matrix(source(spark, sf_dir, _CLASSES))


@query("clustering_metrics", f"""WITH d AS (SELECT p.*, a.label AS own FROM ({_PAIRS}) p JOIN embeddings a ON a.vec_id = p.query),
    m AS (SELECT query, own, label, sum(distance) AS s, count(*) AS n FROM d GROUP BY 1, 2, 3),
    t AS (SELECT query, max(CASE WHEN own = label THEN s / (n - 1) END) AS a, min(CASE WHEN own <> label THEN s / n END) AS b FROM m GROUP BY 1)
    SELECT (SELECT count(DISTINCT label) FROM embeddings) AS clusters, CAST(NULL AS DOUBLE) AS inertia,
    round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM t""")
def _clustering(spark, sf_dir):
    return rounded(clustering_metrics(_points(spark, sf_dir).withColumnRenamed("label", "prediction"), euclidean=True))


# runs: one per event type, scored by how well a constant describes its values

@query("best_runs", """WITH r AS (SELECT event_type, avg(abs(value - 40)) AS mae, 1 - avg(pow(value - 40, 2)) / var_pop(value) AS r2 FROM events GROUP BY 1),
    n AS (SELECT *, row_number() OVER (ORDER BY event_type) AS run_id FROM r)
    SELECT 'mae' AS metric, CAST(arg_min(run_id, mae) AS BIGINT) AS run_id, round(min(mae), 6) AS value FROM n
    UNION ALL SELECT 'r2', CAST(arg_max(run_id, r2) AS BIGINT), round(max(r2), 6) FROM n""")
def _best(spark, sf_dir):
    ids = F.array_position(F.array(*[F.lit(t) for t in ("click", "error", "purchase", "signup", "view")]), F.col("event_type"))
    off = F.col("value") - 40
    runs = table(spark, sf_dir, "events").groupBy(ids.alias("run_id")).agg(
        F.avg(F.abs(off)).alias("mae"), (1 - F.avg(off * off) / F.var_pop("value")).alias("r2"))
    runs = runs.select("run_id", F.create_map(F.lit("mae"), "mae", F.lit("r2"), "r2").alias("metrics"))
    return rounded(best_runs(runs))


# one tree with one split on a column whose every value is a bin has a closed form, whatever the ensemble around it

_QUANTITY = "SELECT l_quantity, l_extendedprice * (1 + (l_quantity > 30)::INT) AS cost FROM lineitem"
_SPARK_QUANTITY = "SELECT l_quantity, l_extendedprice * IF(l_quantity > 30, 2, 1) AS cost FROM lineitem"
_SPLIT = f"""WITH t AS ({_QUANTITY}), g AS (SELECT l_quantity AS q, count(*) AS n, sum(cost) AS s FROM t GROUP BY 1),
    c AS (SELECT q, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER () AS n, sum(s) OVER () AS s FROM g WINDOW w AS (ORDER BY q)),
    b AS (SELECT * FROM c WHERE nl < n ORDER BY sl * sl / nl + (s - sl) * (s - sl) / (n - nl) DESC LIMIT 1)
    SELECT DISTINCT l_quantity, round(CASE WHEN l_quantity <= q THEN sl / nl ELSE (s - sl) / (n - nl) END, 4) AS prediction FROM t, b"""


def _first_split(name, algorithm, params):
    def run(spark, sf_dir):
        rows = assemble(source(spark, sf_dir, _SPARK_QUANTITY), ["l_quantity"], "cost")
        model = fit_model(algorithm, rows.select("features", "label"), {"max_depth": 1, "max_bins": 64, **params})
        return rounded(model.transform(rows).select("l_quantity", "prediction").distinct(), 4)
    query(f"first_split_{name}", _SPLIT)(run)


_first_split("decision_tree_regressor", "decision-tree-regressor", {})
_first_split("random_forest_regressor", "random-forest-regressor", {"n_estimators": 1, "bootstrap": False})
_first_split("gradient_boosting_regressor", "gradient-boosting-regressor", {"n_estimators": 1})
_first_split("xgboost_regressor", "xgboost-regressor", {"n_estimators": 1})

_MAJORITY = """WITH t AS (SELECT l_quantity, CASE WHEN (l_quantity > 30) <> (l_discount > 0.07) THEN 1 ELSE 0 END AS y FROM lineitem),
    g AS (SELECT l_quantity AS q, count(*) AS n, sum(y) AS s FROM t GROUP BY 1),
    c AS (SELECT q, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER () AS n, sum(s) OVER () AS s FROM g WINDOW w AS (ORDER BY q)),
    b AS (SELECT * FROM c WHERE nl < n ORDER BY sl * sl / nl + (s - sl) * (s - sl) / (n - nl) DESC LIMIT 1)
    SELECT DISTINCT l_quantity, CAST(CASE WHEN CASE WHEN l_quantity <= q THEN sl / nl ELSE (s - sl) / (n - nl) END > 0.5
    THEN 1 ELSE 0 END AS DOUBLE) AS prediction FROM t, b"""
_SPARK_MAJORITY = "SELECT l_quantity, IF((l_quantity > 30) <> (l_discount > 0.07), 1, 0) AS y FROM lineitem"


def _first_vote(name, algorithm, params):
    def run(spark, sf_dir):
        rows = assemble(source(spark, sf_dir, _SPARK_MAJORITY), ["l_quantity"], "y")
        model = fit_model(algorithm, rows.select("features", "label"), {"max_depth": 1, "max_bins": 64, **params})
        return model.transform(rows).select("l_quantity", "prediction").distinct()
    query(f"first_split_{name}", _MAJORITY)(run)


_first_vote("decision_tree_classifier", "decision-tree-classifier", {})
_first_vote("random_forest_classifier", "random-forest-classifier", {"n_estimators": 1, "bootstrap": False})
_first_vote("xgboost_classifier", "xgboost-classifier", {"n_estimators": 1})
_first_vote("adaboost_classifier", "adaboost-classifier", {"n_estimators": 1})


@query("logistic_regression_closed_form", """WITH p AS (SELECT avg(CASE WHEN event_type = 'click' THEN (value > 50)::INT END) AS a,
    avg(CASE WHEN event_type <> 'click' THEN (value > 50)::INT END) AS b FROM events)
    SELECT round(ln(a / (1 - a)) - ln(b / (1 - b)), 4) AS slope, round(ln(b / (1 - b)), 4) AS intercept FROM p""")
def _logistic_closed(spark, sf_dir):
    df = source(spark, sf_dir, "SELECT IF(event_type = 'click', 1.0D, 0.0D) AS x, IF(value > 50, 1, 0) AS y FROM events")
    rows = assemble(df, ["x"], "y").select("features", "label")
    model = fit_model("logistic-regression", rows, {"penalty": None, "tol": 1e-12, "max_iter": 500})
    return rounded(spark.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "slope double, intercept double"), 4)


# two separate values are two clusters, each value its own centre

@query("kmeans_two_values", """SELECT CASE WHEN l_quantity > 25 THEN 10.0 ELSE 0.0 END::DOUBLE AS centre, count(*) AS rows,
    CAST(0 AS DOUBLE) AS inertia FROM lineitem GROUP BY 1""")
def _two_values(spark, sf_dir):
    df = source(spark, sf_dir, "SELECT IF(l_quantity > 25, 10.0D, 0.0D) AS x FROM lineitem")
    model = fit_model("kmeans", assemble(df, ["x"]).select("features"), {"n_clusters": 2})
    centres = F.array(*[F.lit(float(c[0])) for c in model.clusterCenters()])
    placed = model.transform(assemble(df, ["x"])).select(F.round(F.get(centres, F.col("prediction")), 6).alias("centre"))
    inertia = F.lit(round(float(model.summary.trainingCost), 6))
    return placed.groupBy("centre").agg(F.count("*").alias("rows")).withColumn("inertia", inertia)
