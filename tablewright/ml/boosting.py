"""AdaBoost on library trees: AdaBoost.R2 (Drucker 1997) and SAMME (Zhu et al. 2009)."""

from __future__ import annotations

import math

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, functions as F

from ..functions.checkpoints import settled

ROUNDS, DEPTH = 50, {"regression": 3, "classification": 1}  # fixed values: defaults of the algorithm
SETTLE_EVERY = 10


class Committee:
    """Weighted trees; predictions are gathered into one array per row and combined there."""

    def __init__(self, trees: list, weights: list[float], regression: bool, classes: list[float]):
        self.trees, self.weights, self.regression, self.classes = trees, weights, regression, classes

    def transform(self, df: DataFrame) -> DataFrame:
        base = df.columns
        out = df
        for i, tree in enumerate(self.trees):
            scored = tree.transform(out)
            out = scored.select(*out.columns, F.col("prediction").alias(f"__p{i}"))
        votes = [F.struct(F.col(f"__p{i}").alias("p"), F.lit(w).alias("w")) for i, w in enumerate(self.weights)]
        chosen = self._median(votes) if self.regression else self._majority(votes)
        return out.withColumn("prediction", chosen).select(*base, "prediction")

    def _median(self, votes):
        """The first prediction, in order, at which half the weight is reached."""
        half = 0.5 * sum(self.weights)
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("p"))

        def step(state, vote):
            total = state["sum"] + vote["w"]
            pick = F.when(state["p"].isNull() & (total >= half), vote["p"]).otherwise(state["p"])
            return F.struct(total.alias("sum"), pick.alias("p"))

        return F.aggregate(F.array_sort(F.array(*votes)), start, step, lambda s: s["p"])

    def _majority(self, votes):
        tallies = []
        for c in self.classes:
            total = F.lit(0.0)
            for v in votes:
                total = total + F.when(v["p"] == F.lit(c), v["w"]).otherwise(0.0)
            tallies.append(F.struct(total.alias("w"), (-F.lit(c)).alias("order"), F.lit(c).alias("label")))
        return (F.greatest(*tallies) if len(tallies) > 1 else tallies[0])["label"]


def _start(train: DataFrame) -> DataFrame:
    rows = train.count()
    return train.select("features", "label", F.lit(1.0 / rows).alias("weight"))


def _scored(tree, data: DataFrame) -> DataFrame:
    return tree.transform(data).select("features", "label", "weight", "prediction")


def boosted_regressor(train: DataFrame, params: dict) -> Committee:
    """Rows with a large relative error gain weight each round."""
    rounds, rate, loss = int(params.get("n_estimators", ROUNDS)), float(params.get("learning_rate", 1.0)), params.get("loss", "linear")
    shapes = {"linear": lambda e: e, "square": lambda e: e * e, "exponential": lambda e: 1 - F.exp(-e)}
    if loss not in shapes:
        raise ValueError(f"unknown loss {loss!r}")
    data, trees, weights = settled(_start(train)), [], []
    for i in range(rounds):
        tree = DecisionTreeRegressor(maxDepth=int(params.get("max_depth", DEPTH["regression"])), weightCol="weight",
                                     maxBins=int(params.get("max_bins", 32)), seed=i).fit(data)
        scored = _scored(tree, data)
        error = F.abs(F.col("label") - F.col("prediction"))
        worst = scored.agg(F.max(error)).first()[0]
        if not worst:
            return Committee([*trees, tree], [*weights, 1.0], True, [])
        share = shapes[loss](error / F.lit(worst))
        row = scored.agg(F.sum(F.col("weight") * share).alias("e"), F.sum("weight").alias("w")).first()
        average = row["e"] / row["w"]
        if average >= 0.5:
            if not trees:
                return Committee([tree], [1.0], True, [])
            break
        beta = average / (1 - average)
        trees.append(tree)
        weights.append(rate * math.log(1 / beta))
        grown = F.col("weight") * F.pow(F.lit(beta), (1 - share) * rate)
        data = scored.select("features", "label", (grown / F.lit(row["w"])).alias("weight"))
        if (i + 1) % SETTLE_EVERY == 0:
            data = settled(data)
    return Committee(trees, weights, True, [])


def boosted_classifier(train: DataFrame, params: dict) -> Committee:
    """Misclassified rows gain weight each round; learners must beat chance."""
    rounds, rate = int(params.get("n_estimators", ROUNDS)), float(params.get("learning_rate", 1.0))
    classes = [r[0] for r in train.select("label").distinct().orderBy("label").collect()]
    odds = math.log(max(1, len(classes) - 1))
    data, trees, weights = settled(_start(train)), [], []
    for i in range(rounds):
        tree = DecisionTreeClassifier(maxDepth=int(params.get("max_depth", DEPTH["classification"])), weightCol="weight",
                                     maxBins=int(params.get("max_bins", 32)), seed=i).fit(data)
        scored = _scored(tree, data)
        wrong = F.col("label") != F.col("prediction")
        row = scored.agg(F.sum(F.when(wrong, F.col("weight")).otherwise(0.0)).alias("e"), F.sum("weight").alias("w")).first()
        error = row["e"] / row["w"]
        if error <= 0:
            return Committee([*trees, tree], [*weights, 1.0], False, classes)
        if error >= 1 - 1 / len(classes):
            if not trees:
                return Committee([tree], [1.0], False, classes)
            break
        alpha = rate * (math.log((1 - error) / error) + odds)
        trees.append(tree)
        weights.append(alpha)
        grown = F.col("weight") * F.when(wrong, F.lit(math.exp(alpha))).otherwise(1.0)
        data = scored.select("features", "label", (grown / F.lit(row["w"])).alias("weight"))
        if (i + 1) % SETTLE_EVERY == 0:
            data = settled(data)
    return Committee(trees, weights, False, classes)
