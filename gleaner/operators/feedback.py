"""Learning from ratings: summaries, patterns, health, and smoothed metrics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALPHA = 0.1


def rated(events: DataFrame) -> DataFrame:
    """Events as feedback: rating 1 to 5 by the value's bands of 20."""
    return events.withColumn("rating", F.greatest(F.lit(1), F.least(F.lit(5), F.floor(F.col("value") / 20).cast("int") + 1)))


def summary(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("rating"), 6).alias("mean_rating"), F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"))


def patterns(ratings: DataFrame) -> DataFrame:
    """(event_type, low_share, alarm): an alarm if over 30% are rated two or less."""
    low = F.avg((F.col("rating") <= 2).cast("double"))
    return ratings.groupBy("event_type").agg(F.round(low, 6).alias("low_share"), (low > 0.3).alias("alarm"))


def histogram(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("rating").agg(F.count("*").alias("n"))


def health(ratings: DataFrame, target: float = 4.0) -> DataFrame:
    """(health, band) of mean ratings by type against a target."""
    by = ratings.groupBy("event_type").agg(F.avg("rating").alias("m"))
    out = by.agg(F.round(F.avg(F.least(F.lit(1.0), F.col("m") / target)), 6).alias("health"))
    return out.withColumn("band", F.when(F.col("health") >= 0.9, "good").when(F.col("health") >= 0.7, "fair").otherwise("poor"))


def ema(ratings: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(event_type, day, mean, ema): exponential average of daily means. Days are pre-aggregated, so a type's fold is one row a day."""
    daily = ratings.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("rating").alias("mean"))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("day")
        return rows.assign(ema=rows["mean"].ewm(alpha=alpha, adjust=False).mean())

    return daily.groupBy("event_type").applyInPandas(fold, "event_type string, day date, mean double, ema double").select("event_type", F.col("day").cast("string").alias("day"), F.round("mean", 6).alias("mean"), F.round("ema", 6).alias("ema"))
