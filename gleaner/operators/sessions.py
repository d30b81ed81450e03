"""Session memory, caches and traffic trends over ordered events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions.text import question_type, tokens


def windows(events: DataFrame, gap_seconds: int = 3600) -> DataFrame:
    """(user_id, session_start, session_end, n): a session ends after an idle gap."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    idle = F.col("ts") - F.lag("ts").over(order)
    new = (~F.coalesce(idle < F.expr(f"INTERVAL {gap_seconds} SECONDS"), F.lit(False))).cast("int")  # a gap as long as the limit ends a session
    return events.withColumn("new", new).withColumn("session", F.sum("new").over(order)).groupBy("user_id", "session").agg(F.min("ts").alias("session_start"), F.max("ts").alias("session_end"), F.count("*").alias("n")).drop("session")


def recent_context(turns: DataFrame, n: int = 5) -> DataFrame:
    """Each user turn with the texts of up to n user turns before it."""
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(-n, -1)
    return turns.where("role = 'user'").select("conv_id", "turn", F.size(F.collect_list("text").over(before)).cast("long").alias("n_before"), F.md5(F.array_join(F.collect_list("text").over(before), "\n")).alias("context_md5"))


def summary(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("n_types"), F.round(F.avg("value"), 4).alias("mean_value"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def preferences(events: DataFrame, k: int = 3) -> DataFrame:
    """Each user's most frequent event types."""
    counted = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("n"), "event_type"))).where(F.col("place") <= k)


def trends(events: DataFrame, n: int = 20) -> DataFrame:
    """Each event's mean of the user's last n values against the n before."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    now, before = F.avg("value").over(order.rowsBetween(-n + 1, 0)), F.avg("value").over(order.rowsBetween(-2 * n + 1, -n))
    return events.select("event_id", F.round(now, 8).alias("recent"), F.round(before, 8).alias("earlier"))


def rate(events: DataFrame, n: int = 100) -> DataFrame:
    """Events a minute over each user's last n."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-n + 1, 0)
    seconds = F.unix_timestamp(F.max("ts").over(order).cast("timestamp")) - F.unix_timestamp(F.min("ts").over(order).cast("timestamp"))
    return events.select("event_id", F.round(F.when(seconds > 0, F.count("*").over(order) * 60 / seconds), 6).alias("per_minute"))


def exact_hits(turns: DataFrame) -> DataFrame:
    """(key, asked, hits): user questions by their normalised text; all but the first are cache hits."""
    key = F.md5(F.lower(F.trim("text")))
    return turns.where("role = 'user'").groupBy(key.alias("key")).agg(F.count("*").alias("asked"), (F.count("*") - 1).alias("hits"))


def live_entries(events: DataFrame, hours: int = 24, keep: int = 1000) -> DataFrame:
    """Cache entries of the last hours before the newest event, the newest first, at most so many."""
    newest = events.agg(F.max("ts")).first()[0]
    return events.where(F.col("ts") > F.lit(newest) - F.expr(f"INTERVAL {hours} HOURS")).orderBy(F.desc("ts"), "event_id").limit(keep).select("event_id", "ts")


def deduplicated(results: DataFrame) -> DataFrame:
    """First result of each beginning of a text."""
    order = W.partitionBy(F.substring("text", 1, 100)).orderBy("doc_id")
    return results.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("doc_id")


def patterns(turns: DataFrame, long_words: int = 15) -> DataFrame:
    """(conv_id, n, n_intents, n_long, pattern) of each conversation's user turns; none before three turns."""
    own = turns.where("role = 'user'").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_distinct(question_type(F.col("text"))).alias("n_intents"), F.count_if(F.size(tokens(F.col("text"))) > long_words).alias("n_long"))
    return own.withColumn("pattern", F.when(F.col("n") < 3, "none").when(F.col("n_long") >= 3, "complex").when(F.col("n_intents") >= 3, "exploring").otherwise("steady"))
