"""Exact vector retrieval: squared Euclidean distance, similarity 1 / (1 + d2)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of query vectors and of vectors that a task holds at a time, about; vectors that meet the queries at a time.
QUERY_BYTES, VECTOR_BYTES, BLOCK = 32 << 20, 64 << 20, 2048


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, threshold: float | None = None, exclude_self: bool = False) -> DataFrame:
    """(qid, doc_id, score, rank). vectors: doc_id, v; queries: qid, q. A threshold is applied after the cut at k.

    Up to QUERY_BYTES of queries go to the tasks, which keep each query's best few of their own vectors. More queries and the
    vectors are dealt to a grid: each cell has a block of either, both of bounded size, and keeps the best few of its own.
    So what is shuffled after that is that and not all pairs. Null vectors and vectors of another length than the query's have no score.
    """
    schema = "qid long, doc_id long, score double"
    if k < 1:
        return vectors.sparkSession.createDataFrame([], f"{schema}, rank int")
    asked, held = queries.where("q is not null").select("qid", "q"), vectors.where("v is not null").select("doc_id", "v")
    counted = queries.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("size")).first()
    row_bytes = 8 * max(1, counted["size"] or 1)
    blocks = max(1, -(-counted["n"] * row_bytes // QUERY_BYTES))
    if blocks == 1:
        shared = vectors.sparkSession.sparkContext.broadcast(_by_size([(r["qid"], r["q"]) for r in asked.collect()]))  # QUERY_BYTES at most, about
        found = held.mapInPandas(lambda batches: _best(shared.value, batches, k, exclude_self), schema)
    else:
        found = _grid(asked, held, blocks, max(1, -(-held.count() * row_bytes // VECTOR_BYTES)), k, exclude_self, schema)
    order = W.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.where(F.col("score") >= threshold) if threshold else ranked


def _grid(asked: DataFrame, held: DataFrame, rows: int, columns: int, k: int, exclude_self: bool, schema: str) -> DataFrame:
    """Each query's best in each column of a grid of blocks of queries by blocks of vectors."""
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(own("qid", rows).alias("x"), every(columns).alias("y"), F.lit(True).alias("asked"), F.col("qid").alias("id"), F.col("q").cast("array<double>").alias("v"))
    right = held.select(every(rows).alias("x"), own("doc_id", columns).alias("y"), F.lit(False).alias("asked"), F.col("doc_id").alias("id"), F.col("v").cast("array<double>").alias("v"))

    def cell(both: pd.DataFrame) -> pd.DataFrame:
        q, v = both[both["asked"]], both[~both["asked"]]
        out = _best(_by_size(list(zip(q["id"], q["v"]))), [v.rename(columns={"id": "doc_id"})], k, exclude_self)
        return pd.concat([pd.DataFrame({"qid": [], "doc_id": [], "score": []}).astype({"qid": np.int64, "doc_id": np.int64}), *out])

    return left.unionByName(right).groupBy("x", "y").applyInPandas(cell, schema)


def _by_size(asked: list[tuple]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the queries (id, vector), by the vectors' length."""
    return {n: (np.array([i for i, q in asked if len(q) == n], np.int64), np.array([q for _, q in asked if len(q) == n], float)) for n in {len(q) for _, q in asked}}


def _best(by_size: dict, batches: Iterable[pd.DataFrame], k: int, exclude_self: bool) -> Iterator[pd.DataFrame]:
    """The best k of each query among the batches' vectors (doc_id, v), by rounded score and then id."""
    held = {n: [np.empty((len(i), 0), np.int64), np.empty((len(i), 0))] for n, (i, _) in by_size.items()}
    for batch in batches:
        sizes = batch["v"].map(len)
        for n, (qid, q) in by_size.items():
            rows = batch[sizes == n]
            for at in range(0, len(rows), BLOCK):
                part = rows.iloc[at : at + BLOCK]
                own, x = part["doc_id"].to_numpy(np.int64), np.array(part["v"].tolist(), float)
                d = np.zeros((len(q), len(x)))
                for j in range(n):  # summed in the order of the components, as anywhere else
                    d += (x[:, j][None, :] - q[:, j][:, None]) ** 2
                score = np.round(1 / (1 + d), 6)
                if exclude_self:
                    score[qid[:, None] == own[None, :]] = -1
                docs, scores = np.hstack([held[n][0], np.broadcast_to(own, score.shape)]), np.hstack([held[n][1], score])
                best = np.lexsort((docs, -scores), axis=1)[:, :k]
                held[n] = [np.take_along_axis(docs, best, 1), np.take_along_axis(scores, best, 1)]
    for n, (qid, _) in by_size.items():
        docs, scores = held[n]
        kept = scores.ravel() >= 0
        yield pd.DataFrame({"qid": np.repeat(qid, docs.shape[1])[kept], "doc_id": docs.ravel()[kept], "score": scores.ravel()[kept]})
