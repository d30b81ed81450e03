"""Rule-based plans, complexity and cost as columns over a table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import keywords, question_type, tokens

#: Intent and complexity.
COMPLEXITY = {"who": 0.2, "when": 0.2, "where": 0.2, "what": 0.3, "how": 0.7, "why": 0.8, "comparison": 0.9, "general": 0.5}
#: Speed, accuracy, cost of a retriever.
PROFILES = {"dense": (0.7, 0.9, 0.8), "bm25": (0.9, 0.7, 0.3), "graph": (0.5, 0.8, 0.9)}


def names(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\p{Lu}\p{L}{3,}"), F.lit(0)))


def features(queries: DataFrame) -> DataFrame:
    """queries (qid, query) with intent, n_words, n_names, n_keywords."""
    return queries.select("qid", "query", question_type(F.col("query")).alias("intent"), F.size(tokens(F.col("query"))).cast("long").alias("n_words"), F.size(names(F.col("query"))).cast("long").alias("n_names"), F.size(keywords(F.col("query"))).cast("long").alias("n_keywords"))


def complexity(queries: DataFrame) -> DataFrame:
    base = F.coalesce(F.create_map(*[x for k, v in COMPLEXITY.items() for x in (F.lit(k), F.lit(v))])[F.col("intent")], F.lit(0.5))
    score = 0.4 * F.least(F.col("n_words") / 20, F.lit(1.0)) + 0.3 * F.least(F.col("n_names") / 5, F.lit(1.0)) + 0.3 * base
    out = features(queries).withColumn("complexity", F.round(score, 6))
    return out.withColumn("level", F.when(F.col("complexity") < 0.3, "easy").when(F.col("complexity") > 0.7, "hard").otherwise("medium"))


def plans(queries: DataFrame) -> DataFrame:
    """(qid, dense_k, bm25_k, graph_k, hops): base sizes by intent, adapted to names and length, within 1 to 500."""
    f = complexity(queries)
    deep = F.col("intent").isin("why", "how", "comparison")
    base = F.when(deep, F.lit(150)).when(F.col("n_names") == 0, F.lit(100)).when(F.col("n_names") > 3, F.lit(75)).otherwise(F.lit(50))
    k = F.least(F.lit(200), base + F.when(F.col("n_words") > 15, F.lit(25)).otherwise(F.lit(0)))
    return f.select("qid", k.alias("dense_k"), k.alias("bm25_k"), F.when(F.col("n_names") >= 2, F.lit(75)).otherwise(F.lit(0)).alias("graph_k"), F.when(deep, F.lit(1)).otherwise(F.lit(0)).alias("hops"))


def costs(planned: DataFrame) -> DataFrame:
    """(qid, seconds, total_k, cost) of each plan."""
    total = F.col("dense_k") + F.col("bm25_k") + F.col("graph_k")
    seconds = sum((F.col(f"{n}_k") / 100 * (2 / p[0]) for n, p in PROFILES.items()), F.lit(0.0)) + total / 200
    cost = sum((F.col(f"{n}_k") / 100 * p[2] for n, p in PROFILES.items()), F.lit(0.0))
    return planned.select("qid", F.round(seconds * (1 + 0.5 * F.col("hops")), 4).alias("seconds"), total.cast("long").alias("total_k"), F.round(cost, 4).alias("cost"))


def for_speed(planned: DataFrame) -> DataFrame:
    """The two fastest retrievers, smaller k, one hop at most."""
    cap = lambda c: F.least(F.col(c), F.lit(75))
    return planned.select("qid", cap("dense_k").alias("dense_k"), cap("bm25_k").alias("bm25_k"), F.lit(0).alias("graph_k"), F.least("hops", F.lit(1)).alias("hops"))


#: Rounds of shrinking at most: by a fifth each, from 500 to ten.
ROUNDS = 20


def constrained(planned: DataFrame, seconds: float, most_k: int) -> DataFrame:
    """(qid, dense_k, bm25_k, graph_k, hops, rerank, seconds, rounds, fits): plans within most_k results a retriever, shrunk until their estimate is within so many seconds.

    A round takes a fifth off every retriever's results (ten stay), leaves out the slowest retriever while there
    are several, a hop, and reranking. What is still too slow with ten results each doesn't fit. The rounds are a
    fold over a constant number of steps inside the row.
    """
    slowest_first = sorted(PROFILES, key=lambda n: PROFILES[n][0])
    ks = [f"{n}_k" for n in PROFILES]

    def estimate(x: Column) -> Column:
        total = sum((x[k] for k in ks), F.lit(0))
        took = sum((x[f"{n}_k"] / 100 * (2 / p[0]) for n, p in PROFILES.items()), F.lit(0.0)) + F.when(x["rerank"], total / 200).otherwise(0.0)
        return F.round(took * (1 + 0.5 * x["hops"]), 6)

    def shrink(x: Column) -> Column:
        used = sum(((x[k] > 0).cast("int") for k in ks), F.lit(0))
        new, faster = {}, F.lit(True)
        for n in slowest_first:
            k = x[f"{n}_k"]
            less = F.when(k > 10, F.greatest(F.lit(10), F.floor(k * 0.8))).otherwise(k)
            new[f"{n}_k"] = F.when((used > 1) & (k > 0) & faster, F.lit(0)).otherwise(less).cast("long")
            faster = faster & (k == 0)
        return F.struct(*[new[k].alias(k) for k in ks], F.greatest(x["hops"] - 1, F.lit(0)).cast("long").alias("hops"), F.lit(False).alias("rerank"), (x["rounds"] + 1).alias("rounds"))

    start = F.struct(*[F.least(F.col(k), F.lit(most_k)).cast("long").alias(k) for k in ks], F.col("hops").cast("long").alias("hops"), F.lit(True).alias("rerank"), F.lit(0).cast("long").alias("rounds"))
    more = lambda x: (estimate(x) > seconds) & (F.greatest(*[x[k] for k in ks]) > 10)
    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda x, _: F.when(more(x), shrink(x)).otherwise(x))
    out = planned.select("qid", done.alias("x"))
    return out.select("qid", *[F.col(f"x.{k}") for k in ks], "x.hops", "x.rerank", estimate(F.col("x")).alias("seconds"), "x.rounds", (estimate(F.col("x")) <= seconds).alias("fits"))
