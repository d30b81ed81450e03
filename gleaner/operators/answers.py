"""Claims, their support by evidence, verdicts, and calibration of confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import tokens

SUPPORT, NEUTRAL = 0.3, 0.1


def claims(answers: DataFrame) -> DataFrame:
    """(conv_id, turn, pos, claim): sentences over ten characters."""
    sentences = F.filter(F.transform(F.split("text", r"[.!?]+"), lambda s: F.trim(s)), lambda s: F.length(s) > 10)
    return answers.select("conv_id", "turn", F.posexplode(sentences).alias("pos", "claim"))


def supported(claimed: DataFrame, evidence: DataFrame) -> DataFrame:
    """(conv_id, turn, pos, share, label): share of a claim's words that its evidence (conv_id, turn, evidence) has."""
    own = tokens(F.col("claim"))
    share = F.when(F.size(own) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(own, tokens(F.col("evidence")))) / F.size(F.array_distinct(own)))
    out = claimed.join(evidence, ["conv_id", "turn"], "left").select("conv_id", "turn", "pos", F.round(F.coalesce(share, F.lit(0.0)), 6).alias("share"))
    return out.withColumn("label", F.when(F.col("share") >= SUPPORT, "entailed").when(F.col("share") >= NEUTRAL, "neutral").otherwise("contradicted"))


def verdicts(judged: DataFrame) -> DataFrame:
    """(conv_id, turn, n, verdict): too many contradictions first, then enough support, then what is missing."""
    part = lambda label: F.avg((F.col("label") == label).cast("double"))
    out = judged.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), part("contradicted").alias("c"), part("entailed").alias("e"), part("neutral").alias("u"))
    return out.select("conv_id", "turn", "n", F.when(F.col("c") > 0.2, "regenerate").when(F.col("e") >= 0.7, "satisfactory").when(F.col("u") > 0.5, "expand").otherwise("clarify").alias("verdict"))


def calibration(predicted: DataFrame) -> DataFrame:
    """(bin, n, mean_p, mean_y, gap) over ten bins (lo, hi], the first closed. predicted: p, y."""
    of = F.greatest(F.lit(0), F.ceil(F.col("p") * 10) - 1).cast("long")
    return predicted.groupBy(of.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg("y"), 6).alias("mean_y"), F.round(F.abs(F.avg("p") - F.avg("y")), 6).alias("gap"))


def calibration_error(predicted: DataFrame) -> DataFrame:
    """(n, mae, ece)."""
    bins = calibration(predicted).agg(F.sum(F.col("n") * F.col("gap")).alias("weighted"), F.sum("n").alias("n"))
    return bins.join(F.broadcast(predicted.agg(F.round(F.avg(F.abs(F.col("p") - F.col("y"))), 6).alias("mae"))), F.lit(True)).select("n", "mae", F.round(F.col("weighted") / F.col("n"), 5).alias("ece"))


def citations(answers: DataFrame) -> DataFrame:
    """(answer_id, cited): distinct [n] marks."""
    marks = F.array_distinct(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), F.lit(1)))
    return answers.select("answer_id", F.explode(marks.cast("array<long>")).alias("cited"))


def validated(cited: DataFrame, evidence: DataFrame) -> DataFrame:
    """(answer_id, n_valid, n_invalid): citations whose document is in the evidence (doc_id), and the others."""
    met = cited.join(evidence.select(F.col("doc_id").alias("cited"), F.lit(1).alias("there")), "cited", "left")
    return met.groupBy("answer_id").agg(F.count("there").alias("n_valid"), F.count_if(F.col("there").isNull()).alias("n_invalid"))


def evidence_confidence(judged: DataFrame) -> DataFrame:
    """(conv_id, turn, confidence): mean and best support of an answer's claims, and how many it has."""
    by = judged.groupBy("conv_id", "turn").agg(F.avg("share").alias("mean"), F.max("share").alias("best"), F.count("*").alias("n"))
    return by.select("conv_id", "turn", F.round(F.least(F.lit(1.0), 0.4 * F.col("mean") + 0.4 * F.col("best") + 0.2 * F.least(F.col("n") / 3, F.lit(1.0))), 6).alias("confidence"))
