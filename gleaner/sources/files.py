"""Readers by file ending, and what a file holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """JSON (a list gives a row an item), CSV with a header, or a text file as one row. Another ending raises ValueError; a missing file raises Spark's error."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "json":
        reader = spark.read.option("multiLine", True)
        return (reader.schema(schema) if schema else reader).json(path)
    if kind == "csv":
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    if kind == "txt":
        return spark.read.text(path, wholetext=True)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no reader for {path!r}")


def info(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes) of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"))
