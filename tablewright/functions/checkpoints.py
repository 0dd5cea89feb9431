"""Cutting lineage in loops."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def checkpoint_folder(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only a session without one, as in tests, gets its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get(SETTING, None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError(f"set {SETTING} to a folder all executors share")
            folder = os.path.join(tempfile.gettempdir(), "tablewright-checkpoints")
        context.setCheckpointDir(folder)


def settled(df: DataFrame) -> DataFrame:
    """The table written to the checkpoint folder: later plans start from the files."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
