"""Files in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Read Parquet by its suffix and anything else as CSV with a header row.

    Giving ``schema`` saves the extra pass that CSV type inference takes.
    """
    suffix = path.rstrip("/").lower().rsplit(".", 1)[-1]
    if suffix in ("xlsx", "xls"):
        raise ValueError("Excel workbooks cannot be read in parallel; convert to CSV or Parquet first")
    if suffix == "parquet":
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.parquet(path)
    reader = spark.read.option("header", True).option("multiLine", False)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def save(df: DataFrame, path: str, mode: str = "error", partition_by: list[str] | None = None) -> None:
    """Write the table; the suffix picks CSV, otherwise Parquet."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path.lower().endswith(".csv"):
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)
