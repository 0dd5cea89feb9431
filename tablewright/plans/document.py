"""The step list as a small versioned JSON document."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

VERSION = "1.0"  # fixed value: document format version


def to_document(steps: list[dict]) -> str:
    return json.dumps({"version": VERSION, "steps": steps}, ensure_ascii=False, indent=2)


def from_document(text: str) -> list[dict]:
    """The steps of a document; an unreadable one counts as empty."""
    try:
        steps = json.loads(text).get("steps", [])
    except (ValueError, AttributeError):
        return []
    return steps if isinstance(steps, list) else []


def _opened(spark: SparkSession, path: str):
    """A path of any file system the session reads, and that file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), target


def write_steps(path: str, steps: list[dict], spark: SparkSession | None = None) -> None:
    files, target = _opened(spark or SparkSession.active(), path)
    out = files.create(target, True)
    try:
        out.write(bytearray(to_document(steps).encode()))
    finally:
        out.close()


def read_steps(path: str, spark: SparkSession | None = None) -> list[dict]:
    """The steps of a stored document; a missing file counts as empty, any other failure to read is raised."""
    spark = spark or SparkSession.active()
    files, target = _opened(spark, path)
    if not files.exists(target):
        return []
    source = files.open(target)
    try:
        return from_document(bytes(source.readAllBytes()).decode())
    finally:
        source.close()
