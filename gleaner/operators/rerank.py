"""Reranking and relevance signals over candidates (qid, query, doc_id, text, score, rank)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions.shared import cut
from gleaner.functions.text import jaccard, overlap, tokens
from gleaner.operators import sparse

#: Weights of the signals, and the BM25 score that counts as full.
BM25_FULL, W_BM25, W_OVERLAP, W_LENGTH = 50, 0.25, 0.6, 0.15


def _words() -> tuple[Column, Column]:
    return tokens(F.col("query")), tokens(F.col("text"))


def by_overlap(candidates: DataFrame, bonus: float = 0.1) -> DataFrame:
    """Adds a bonus for the share of query words present; old_rank keeps the first rank."""
    q, w = _words()
    boosted = candidates.withColumn("overlap", overlap(q, w)).withColumn("boosted", F.round(F.col("score") + bonus * F.col("overlap"), 6))
    order = W.partitionBy("qid").orderBy(F.desc("boosted"), "doc_id")
    return boosted.withColumnRenamed("rank", "old_rank").withColumn("rank", F.row_number().over(order))


def length_penalty(words: Column) -> Column:
    n = F.size(words)
    return F.when(n < 100, F.lit(0.8)).when(n <= 500, F.lit(1.0)).when(n > 1000, F.lit(0.7)).otherwise(F.lit(0.9))


def cascade(candidates: DataFrame, keep: int = 7) -> DataFrame:
    """Stage one by boosted score, stage two by overlap and length; the best few stay."""
    first = by_overlap(candidates).withColumn("first_rank", F.col("rank")).drop("rank")
    final = first.withColumn("final", F.round(0.7 * F.col("overlap") + 0.3 * length_penalty(_words()[1]), 6))
    return final.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("final"), "doc_id"))).where(F.col("rank") <= keep)


def impact(reranked: DataFrame) -> DataFrame:
    moved = F.col("rank") - F.col("old_rank")
    return reranked.groupBy("qid").agg(F.count_if(moved < 0).alias("promoted"), F.count_if(moved > 0).alias("demoted"), F.round(F.avg(F.abs(moved)), 6).alias("mean_move"))


def diverse(candidates: DataFrame, prefix: int = 200, always: int = 3) -> DataFrame:
    """The first few, and of the others the first with each beginning."""
    same = W.partitionBy("qid", F.substring("text", 1, prefix)).orderBy("rank")
    return candidates.withColumn("_same", F.row_number().over(same)).where((F.col("rank") <= always) | (F.col("_same") == 1)).drop("_same")


def above_threshold(candidates: DataFrame, share: float = 0.6, least: float = 0.3, always: int = 3) -> DataFrame:
    top = F.max("score").over(W.partitionBy("qid"))
    return candidates.withColumn("_top", top).where((F.col("rank") <= always) | (F.col("score") >= F.greatest(share * F.col("_top"), F.lit(least)))).drop("_top")


def greedy_filter(candidates: DataFrame, least_length: int = 20, most_alike: float = 0.9) -> DataFrame:
    """Drops short texts, and texts too like one kept before. A query's candidates are a bounded list (the cut at k), folded in order."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        kept, out = [], []
        for r in rows.sort_values("rank").itertuples():
            own = set(r.words)
            if len(r.text.strip()) >= least_length and all(not (own | k) or len(own & k) / len(own | k) <= most_alike for k in kept):
                kept.append(own)
                out.append((r.qid, r.doc_id, r.rank))
        return pd.DataFrame(out, columns=["qid", "doc_id", "rank"])

    return candidates.withColumn("words", tokens(F.col("text"))).groupBy("qid").applyInPandas(fold, "qid long, doc_id long, rank int")


def jaccard_to_best(candidates: DataFrame) -> DataFrame:
    """Resemblance of each candidate to its query's first."""
    worded = candidates.select("qid", "doc_id", "rank", tokens(F.col("text")).alias("w"))
    best = worded.where("rank = 1").select("qid", F.col("doc_id").alias("best_id"), F.col("w").alias("bw"))
    return worded.where("rank > 1").join(best, "qid").select("qid", "best_id", "doc_id", F.round(jaccard(F.col("w"), F.col("bw")), 6).alias("resemblance"))


def signals(candidates: DataFrame) -> DataFrame:
    q, w = _words()
    out = candidates.withColumns({"text_overlap": F.round(overlap(q, w), 6), "length_penalty": length_penalty(w), "bm25": F.col("score")})
    combined = W_BM25 * F.greatest(F.lit(0.0), F.col("bm25") / BM25_FULL) + W_OVERLAP * F.col("text_overlap") + W_LENGTH * F.col("length_penalty")
    return out.withColumn("combined", F.round(F.least(F.lit(1.0), combined), 6))


def normalized(signalled: DataFrame) -> DataFrame:
    own = W.partitionBy("qid")
    low, high, c = F.min("combined").over(own), F.max("combined").over(own), F.col("combined")
    flat = F.when(c > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return signalled.withColumn("combined_norm", F.round(F.when(high == low, flat).otherwise((c - low) / (high - low)), 6))


def correlations(signalled: DataFrame) -> DataFrame:
    pair = lambda a, b, name: F.round(F.corr(a, b), 6).alias(name)
    return signalled.agg(pair("text_overlap", "length_penalty", "overlap_length"), pair("text_overlap", "bm25", "overlap_bm25"), pair("length_penalty", "bm25", "length_bm25"))


def multihop(docs: DataFrame, queries: DataFrame, hops: int = 2, k: int = 5, words: int = 5) -> DataFrame:
    """(qid, doc_id, hop, score, rank): each hop adds capitalised words of the best three documents to the query; a document keeps its first hop. Hops are cut."""
    found, now = None, queries
    for hop in range(1, hops + 1):
        terms = sparse.query_terms(now)
        best = cut(sparse.best(sparse.index(docs, terms), terms, k)).withColumn("hop", F.lit(hop))
        found = best if found is None else found.unionByName(best)
        names = F.filter(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)), lambda w: F.rlike(w, F.lit(r"^\p{Lu}\p{L}{4,}$")))
        first = best.where("rank <= 3")
        texts = docs.join(sparse._small(first.select("doc_id").distinct()), "doc_id", "left_semi")  # so only these texts leave their tasks
        more = first.join(texts, "doc_id").groupBy("qid").agg(F.array_join(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(names)))), 1, words), " ").alias("more"))
        now = now.join(more, "qid", "left").select("qid", F.concat_ws(" ", "query", "more").alias("query"))
    first = W.partitionBy("qid", "doc_id").orderBy("hop")
    return found.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
