"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..functions.checkpoints import checkpoint_folder


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """The table written as Parquet under ``spark.checkpoint.dir`` and read back, so later plans start from files.

    Hadoop removes the folder when the driver's file system closes.
    """
    spark = df.sparkSession
    checkpoint_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def sampled_labels(labels: DataFrame, id_col: str, label_col: str, most: int, seed: int = 7) -> list[tuple]:
    """About ``most`` labelled ids (all, if there are fewer) as ``(id, label)``, by a hash filter sized from the count.

    Rows without id or label are left out; an id labelled twice counts once, with its greatest label.
    """
    from pyspark.sql import functions as F
    clean = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
             .where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label")))
    total = clean.count()
    if total > most:
        cut = int(most / total * 2**32)
        clean = clean.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(2**32)) < cut)
    return [(r[0], r[1]) for r in clean.collect()]


def frequent(counted: DataFrame, most: int, n_col: str = "n") -> DataFrame:
    """Rows of a table of counts (best a stored one) that are greater than any cut leaving more than ``most`` rows.

    Rows tied at the cut stay out, so the answer does not depend on how the rows are spread. Only the numbers of rows
    by size of count come to the driver: first by eighths of a power of two, then by count inside one of these.
    """
    from pyspark.sql import functions as F
    step = F.floor(F.log2(n_col) * 8)
    sizes = dict(counted.groupBy(step.alias("step")).count().collect())
    total = 0
    for k in sorted(sizes, reverse=True):
        if total + sizes[k] > most:
            break
        total += sizes[k]
    else:
        return counted
    inside = sorted(counted.where(step == k).groupBy(n_col).count().collect(), reverse=True)
    for n, rows in inside:
        total += rows
        if total > most:
            return counted.where(F.col(n_col) > n)
    return counted


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of the table has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
