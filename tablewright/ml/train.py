"""Prepare, fit and evaluate in one call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from .metrics import classification_metrics, clustering_metrics, regression_metrics
from ..functions.columns import col
from .models import ALGORITHMS, TREES, check_parameters, fit_model
from .dbscan import dbscan
from .prepare import choose_columns, feature_rules, prepare


@dataclass
class Trained:
    model: object
    metrics: DataFrame
    predictions: DataFrame


def train(df: DataFrame, algorithm: str, target: str | None = None, excluded: list[str] | None = None,
          params: dict | None = None, **split) -> Trained:
    """Fit an algorithm and measure it: on test rows, and for regression on training rows too."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    check_parameters(algorithm, params or {})
    kind = ALGORITHMS[algorithm]
    if kind == "clustering":
        return _cluster(df, algorithm, excluded, params or {})
    ready = prepare(df, target, excluded, **split)
    rows, test = ready.vectors(described=algorithm in TREES)
    model = fit_model(algorithm, rows, params)
    predictions = model.transform(test)
    if kind == "classification":
        return Trained(model, classification_metrics(predictions), predictions)
    fitted = regression_metrics(model.transform(rows), prefix="train_").drop("train_mse")
    return Trained(model, _beside(regression_metrics(predictions), fitted), predictions)


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two one-row tables as one row."""
    a, b = left.first(), right.first()
    schema = ", ".join(f"{c} double" for c in [*left.columns, *right.columns])
    return left.sparkSession.createDataFrame([(*a, *b)], schema)


def _cluster(df: DataFrame, algorithm: str, excluded: list[str] | None, params: dict) -> Trained:
    """All columns are features unless excluded; rows get a hashed id from all columns."""
    _, features = choose_columns(df, None, excluded, clustering=True)
    rules = feature_rules(df, features)
    numbers = rules.vectors(df, [], described=False)
    if algorithm == "kmeans":
        model = fit_model("kmeans", numbers, params)
        found = model.transform(numbers)
        points = found.select(F.xxhash64(vector_to_array("features")).alias("id"),
                              vector_to_array("features").alias("x"), "prediction")
        return Trained(model, clustering_metrics(points, model.summary.trainingCost), found)
    key = params.get("id")
    if key is None:
        raise ValueError("density clustering needs params['id'], a column that identifies rows")
    points = rules.vectors(df, [key], described=False)
    found = dbscan(points.select(col(key).alias("id"), vector_to_array("features").alias("x")), params)
    return Trained(None, clustering_metrics(found), found)
