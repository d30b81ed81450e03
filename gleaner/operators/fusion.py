"""Rank fusion over candidates (qid, retriever, doc_id, score, rank)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RRF_K = 60
WEIGHTS = {"bm25": 0.5, "coverage": 0.2, "dense": 0.3}


def normalize(candidates: DataFrame, how: str = "min_max") -> DataFrame:
    """Scores normalised within each query and retriever; a list of zeros stays as it is."""
    own = W.partitionBy("qid", "retriever")
    s = F.col("score")
    low, high, mean, sd = F.min(s).over(own), F.max(s).over(own), F.avg(s).over(own), F.stddev_pop(s).over(own)
    zero = F.max(F.abs(s)).over(own) == 0
    flat: dict[str, Column] = {
        "min_max": F.when(high == low, F.lit(1.0)).otherwise((s - low) / (high - low)),
        "z_score": F.when(high == low, F.lit(0.0)).otherwise((s - mean) / sd),
        "softmax": F.exp(s - high) / F.sum(F.exp(s - F.col("_high"))).over(own),
        "none": s,
    }
    return candidates.withColumn("_high", high).withColumn("norm", F.round(F.when(zero, s).otherwise(flat[how]), 6)).drop("_high")


def fuse(candidates: DataFrame, method: str, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(qid, doc_id, score). candidates carry norm except for the rank methods."""
    s = F.col("norm")
    group = lambda *agg: candidates.groupBy("qid", "doc_id").agg(*agg)
    if method == "rrf":
        out = group(F.sum(1 / (RRF_K + F.col("rank"))).alias("score"))
    elif method == "weighted":
        total = sum(weights.values())
        weight = F.coalesce(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v / total))])[F.col("retriever")], F.lit(0.0))
        out = group(F.sum(weight * s).alias("score"))
    elif method == "borda":
        size = F.count("*").over(W.partitionBy("qid", "retriever"))
        out = candidates.withColumn("points", (size - F.col("rank") + 1).cast("double")).groupBy("qid", "doc_id").agg(F.sum("points").alias("score"))
    elif method == "combsum":
        out = group(F.sum(s).alias("score"))
    elif method == "combmnz":
        out = group((F.sum(F.greatest(s, F.lit(0.0))) * F.count_if(s > 0)).alias("score"), F.count_if(s > 0).alias("hits")).where("hits > 0").drop("hits")
    elif method == "max":
        out = group(F.max(s).alias("score")).where("score > 0")
    elif method == "min":
        out = group(F.min(s).alias("score"))
    else:
        raise ValueError(f"no fusion method {method!r}")
    return out.withColumn("score", F.round("score", 9))


def quality(candidates: DataFrame) -> DataFrame:
    """Of each query and retriever: results, and the spread of scores."""
    s = F.col("score")
    return candidates.groupBy("qid", "retriever").agg(
        F.count("*").alias("n"), F.round(F.min(s), 9).alias("low"), F.round(F.max(s), 9).alias("high"), F.round(F.avg(s), 9).alias("mean"), F.round(F.stddev_pop(s), 9).alias("sd"), F.round(F.median(s), 9).alias("middle")
    )
