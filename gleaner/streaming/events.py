"""Structured Streaming over the events table: counts by type, and closed sessions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.shared import shared_dir


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def drained(df: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that is there into Parquet files of a new folder, written by the tasks, and returns them read again."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = f"{folder}/rows"
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "complete":  # each batch is the whole result so far
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(rows))
    else:
        writer = writer.format("parquet").option("path", rows)
    writer.start().awaitTermination()
    return spark.read.schema(df.schema).parquet(rows)


def counts(events: DataFrame) -> DataFrame:
    """Running counts and sums by event type."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Sessions by user, given out once the watermark has passed their end."""
    by = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return by.select("user_id", F.col("s.start").alias("session_start"), "n")
