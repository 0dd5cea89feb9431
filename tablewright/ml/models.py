"""The algorithms by name.

Each entry fits on a table with a ``features`` vector and a ``label`` and gives a
model whose ``transform`` adds ``prediction``. Where the library's objective is scaled
differently from the usual one, the regularisation is converted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor)
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import col
from .bayes import GaussianClassifier
from .boosting import boosted_classifier, boosted_regressor
from .dbscan import dbscan
from .neighbors import NeighborClassifier, NeighborRegressor

FEATURES, LABEL, PREDICTION = "features", "label", "prediction"
DEEPEST = 30  # the library's limit on tree depth
SEED = 48


def assemble(df: DataFrame, features: list[str], target: str | None = None) -> DataFrame:
    """Add the feature vector and, for supervised work, the label as double."""
    out = df.withColumn(FEATURES, array_to_vector(F.array(*[col(c).cast("double") for c in features])))
    return out if target is None else out.withColumn(LABEL, col(target).cast("double"))


def _shape(train: DataFrame) -> tuple[int, float]:
    row = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(LABEL).alias("sd")).first()
    return row["n"], row["sd"] or 0.0


def _common(p: dict) -> dict:
    if p.get("positive"):
        raise ValueError("coefficients cannot be forced to be positive")
    return {"fitIntercept": bool(p.get("fit_intercept", True)), "maxIter": int(p.get("max_iter") or 1000),
            "tol": float(p.get("tol", 1e-6)), "standardization": False}


def _linear(train, p):
    return LinearRegression(**{**_common(p), "maxIter": 100}).fit(train)


def _ridge(train, p):
    """Sum of squares + alpha |w|^2; the library halves and averages squares over a label of unit deviation."""
    n, sd = _shape(train)
    return LinearRegression(regParam=float(p.get("alpha", 1.0)) * sd / n, elasticNetParam=0.0, **_common(p)).fit(train)


def _lasso(train, p):
    return LinearRegression(regParam=float(p.get("alpha", 1.0)), elasticNetParam=1.0, **_common(p)).fit(train)


def _elastic_net(train, p):
    alpha, ratio = float(p.get("alpha", 1.0)), float(p.get("l1_ratio", 0.5))
    _, sd = _shape(train)
    total = ratio + (1 - ratio) * sd
    return LinearRegression(regParam=alpha * total, elasticNetParam=ratio / total if total else 0.0, **_common(p)).fit(train)


def _feature_share(value, default: str) -> str:
    if value in (None, "None"):
        return "all"
    if isinstance(value, str) and value in ("sqrt", "log2", "all", "onethird", "auto"):
        return value
    number = float(value if value is not None else default)
    return "all" if number == 1.0 else str(number if number < 1 else int(number))


def _depth(p: dict, default=None) -> int:
    """No depth means as deep as the library goes; an explicit greater one is refused."""
    depth = p.get("max_depth", default)
    if depth in (None, "None"):
        return DEEPEST
    if int(depth) > DEEPEST:
        raise ValueError(f"max_depth is at most {DEEPEST}")
    return int(depth)


def _tree(p: dict, default_depth=None) -> dict:
    return {"maxDepth": _depth(p, default_depth), "minInstancesPerNode": int(p.get("min_samples_leaf", 1)),
            "minInfoGain": float(p.get("min_impurity_decrease", 0.0)), "maxBins": int(p.get("max_bins", 32)),
            "seed": int(p.get("random_state") or SEED)}


def _forest(p: dict, max_features) -> dict:
    return {**_tree(p), "numTrees": int(p.get("n_estimators", 100)), "bootstrap": bool(p.get("bootstrap", True)),
            "subsamplingRate": float(p.get("max_samples") or 1.0),
            "featureSubsetStrategy": _feature_share(p.get("max_features", max_features), max_features)}


def _boost(p: dict, rate: float, depth: int) -> dict:
    return {**_tree(p, depth), "maxIter": int(p.get("n_estimators", 100)), "stepSize": float(p.get("learning_rate", rate)),
            "subsamplingRate": float(p.get("subsample", 1.0)),
            "featureSubsetStrategy": _feature_share(p.get("colsample_bytree", p.get("max_features", "1.0")), "1.0")}


def _gradient_boosting(train, p):
    losses = {"squared_error": "squared", "absolute_error": "absolute"}
    loss = p.get("loss", "squared_error")
    if loss not in losses:
        raise ValueError(f"boosting supports the losses {sorted(losses)}, not {loss!r}")
    return GBTRegressor(lossType=losses[loss], **_boost(p, 0.1, 3)).fit(train)


def classes_of(train: DataFrame) -> list[float]:
    return [r[0] for r in train.select(LABEL).distinct().orderBy(LABEL).collect()]


def _one_per_class(train, classifier):
    """A two-class learner as it is, or one per class against the rest."""
    if len(classes_of(train)) <= 2:
        return classifier.fit(train)
    return OneVsRest(classifier=classifier, featuresCol=FEATURES, labelCol=LABEL).fit(train)


def _gbt_classifier(train, p):
    return _one_per_class(train, GBTClassifier(**_boost(p, 0.3, 6)))


def _logistic(train, p):
    penalty, c = p.get("penalty", "l2"), float(p.get("C", 1.0))
    n = train.count()
    ratio = {"l2": 0.0, "l1": 1.0, "elasticnet": float(p.get("l1_ratio") or 0.5)}.get(penalty, 0.0)
    strength = 0.0 if penalty in (None, "None", "none") else 1.0 / (c * n)
    return LogisticRegression(regParam=strength, elasticNetParam=ratio, standardization=False, tol=float(p.get("tol", 1e-4)),
                              maxIter=int(p.get("max_iter", 100)), fitIntercept=bool(p.get("fit_intercept", True))).fit(train)


def _svm(train, p):
    if p.get("kernel", "linear") != "linear":
        raise ValueError("only the linear kernel scales out; the others are not offered")
    strength = 1.0 / (float(p.get("C", 1.0)) * train.count())
    return _one_per_class(train, LinearSVC(regParam=strength, standardization=False, tol=float(p.get("tol", 1e-3)),
                                           maxIter=int(p["max_iter"]) if int(p.get("max_iter", -1)) > 0 else 100))


def _kmeans(train, p):
    return KMeans(k=int(p.get("n_clusters", 8)), maxIter=int(p.get("max_iter", 300)), tol=float(p.get("tol", 1e-4)),
                  seed=int(p.get("random_state") or SEED), initMode="random" if p.get("init") == "random" else "k-means||").fit(train)


def _criterion(p: dict) -> dict:
    return {"impurity": "entropy" if p.get("criterion") in ("entropy", "log_loss") else "gini"}


REGRESSION: dict[str, Callable] = {
    "linear-regression": _linear,
    "ridge-regression": _ridge,
    "lasso-regression": _lasso,
    "elasticnet": _elastic_net,
    "decision-tree-regressor": lambda t, p: DecisionTreeRegressor(**_tree(p)).fit(t),
    "random-forest-regressor": lambda t, p: RandomForestRegressor(**_forest(p, "1.0")).fit(t),
    "gradient-boosting-regressor": _gradient_boosting,
    "xgboost-regressor": lambda t, p: GBTRegressor(**_boost(p, 0.3, 6)).fit(t),
    "adaboost-regressor": boosted_regressor,
    "knn-regressor": lambda t, p: NeighborRegressor(t, p),
}
CLASSIFICATION: dict[str, Callable] = {
    "logistic-regression": _logistic,
    "decision-tree-classifier": lambda t, p: DecisionTreeClassifier(**_tree(p), **_criterion(p)).fit(t),
    "random-forest-classifier": lambda t, p: RandomForestClassifier(**_forest(p, "sqrt"), **_criterion(p)).fit(t),
    "svm-classifier": _svm,
    "knn-classifier": lambda t, p: NeighborClassifier(t, p),
    "naive-bayes": lambda t, p: GaussianClassifier(t, p),
    "xgboost-classifier": _gbt_classifier,
    "adaboost-classifier": boosted_classifier,
}
CLUSTERING: dict[str, Callable] = {"kmeans": _kmeans, "dbscan": dbscan}
ALGORITHMS = {**dict.fromkeys(REGRESSION, "regression"), **dict.fromkeys(CLASSIFICATION, "classification"),
              **dict.fromkeys(CLUSTERING, "clustering")}


_TREE = {"max_depth", "min_samples_leaf", "min_impurity_decrease", "max_bins", "random_state"}
_FOREST = _TREE | {"n_estimators", "bootstrap", "max_samples", "max_features"}
_BOOST = _TREE | {"n_estimators", "learning_rate", "subsample", "colsample_bytree", "max_features"}
_LINEAR = {"positive", "fit_intercept", "max_iter", "tol"}
#: the parameters each algorithm honours; any other is refused, not ignored
HONOURED = {
    "linear-regression": _LINEAR, "ridge-regression": _LINEAR | {"alpha"}, "lasso-regression": _LINEAR | {"alpha"},
    "elasticnet": _LINEAR | {"alpha", "l1_ratio"}, "decision-tree-regressor": _TREE, "random-forest-regressor": _FOREST,
    "gradient-boosting-regressor": _BOOST | {"loss"}, "xgboost-regressor": _BOOST,
    "adaboost-regressor": {"n_estimators", "learning_rate", "loss", "max_depth", "max_bins", "random_state"},
    "knn-regressor": {"n_neighbors", "weights", "p", "metric"},
    "logistic-regression": {"penalty", "C", "l1_ratio", "tol", "max_iter", "fit_intercept"},
    "decision-tree-classifier": _TREE | {"criterion"}, "random-forest-classifier": _FOREST | {"criterion"},
    "svm-classifier": {"kernel", "C", "tol", "max_iter"}, "knn-classifier": {"n_neighbors", "weights", "p", "metric"},
    "naive-bayes": {"priors", "var_smoothing"}, "xgboost-classifier": _BOOST,
    "adaboost-classifier": {"n_estimators", "learning_rate", "max_depth", "max_bins", "random_state"},
    "kmeans": {"n_clusters", "max_iter", "tol", "random_state", "init"}, "dbscan": {"eps", "min_samples", "metric", "p", "id"},
}
#: the learners that cut features into bins, which they do by what the schema says of each feature
TREES = {name for name, honoured in HONOURED.items() if "max_bins" in honoured}
# fixed values: form fields with one meaning here, accepted with that value only
NEUTRAL = {"min_samples_split": (2,), "max_leaf_nodes": (None, "None"), "ccp_alpha": (0, 0.0), "reg_alpha": (0, 0.0), "gamma": (0, 0.0),
           "min_child_weight": (1,), "n_jobs": (None, "None", 1, -1), "algorithm": ("auto",), "leaf_size": (30,)}


def check_parameters(name: str, params: dict) -> None:
    """Raise on a parameter that would have no effect."""
    idle = sorted(k for k, v in params.items() if k not in HONOURED[name] and v not in NEUTRAL.get(k, ()))
    if idle:
        raise ValueError(f"{name} does not honour {idle}")


def fit_model(name: str, train: DataFrame, params: dict | None = None):
    """Fit an algorithm on assembled rows (clustering by density is fitted through ``train``)."""
    builders = {**REGRESSION, **CLASSIFICATION, "kmeans": _kmeans}
    if name not in builders:
        raise ValueError(f"unknown algorithm {name!r}")
    check_parameters(name, params or {})
    return builders[name](train, params or {})
