"""A table of finished runs."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

SCHEMA = "run_id bigint, algorithm string, parameters string, metrics map<string,double>, at timestamp, active boolean"

# fixed values: metrics where more is better; the others are best when small
MORE_IS_BETTER = ["r2", "train_r2", "accuracy", "precision", "recall", "f1", "silhouette"]


def _versions(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(SCHEMA + ", deleted boolean").parquet(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], SCHEMA + ", deleted boolean")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs that were not deleted; the newest of them is the active one."""
    known = _versions(spark, path)
    gone = known.filter("deleted").select("run_id").distinct()
    kept = known.filter("NOT deleted").join(F.broadcast(gone), "run_id", "left_anti")
    newest = kept.agg(F.max("run_id")).first()[0]
    return kept.withColumn("active", F.col("run_id") == F.lit(newest)).drop("deleted")


def append_run(spark: SparkSession, path: str, algorithm: str, parameters: dict, metrics: dict[str, float],
               at: dt.datetime | None = None) -> int:
    """Add a run under the next number. One writer at a time, as for any numbering."""
    last = _versions(spark, path).agg(F.max("run_id")).first()[0]
    run = (last or 0) + 1
    clean = {k: float(v) for k, v in metrics.items() if v is not None}
    row = (run, algorithm, json.dumps(parameters, sort_keys=True), clean, at or dt.datetime.now(), True, False)
    spark.createDataFrame([row], SCHEMA + ", deleted boolean").coalesce(1).write.mode("append").parquet(path)
    return run


def delete_run(spark: SparkSession, path: str, run: int) -> None:
    """Mark a run as deleted with an appended row, so a lost writer can never damage the others."""
    row = (run, None, None, None, dt.datetime.now(), False, True)
    spark.createDataFrame([row], SCHEMA + ", deleted boolean").coalesce(1).write.mode("append").parquet(path)


def best_runs(runs: DataFrame) -> DataFrame:
    """The best run per metric (the earlier one on a tie)."""
    each = runs.select("run_id", F.explode("metrics").alias("metric", "value"))
    more = F.col("metric").isin(MORE_IS_BETTER)
    score = F.when(more, F.col("value")).otherwise(-F.col("value"))
    best = F.max_by(F.struct("run_id", "value"), F.struct(score.alias("s"), (-F.col("run_id")).alias("r")))
    return each.groupBy("metric").agg(best.alias("b")).select("metric", F.col("b.run_id").alias("run_id"), F.col("b.value").alias("value"))
