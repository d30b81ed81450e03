"""Answers of earlier questions: the most similar one of a session's last questions, and results lifted by what the session is about."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions.shared import cut
from gleaner.functions.text import tokens

#: Questions back that are looked at, and the cosine from which one answers another.
LAST, SIMILAR = 10, 0.8


def similar_questions(asked: DataFrame, last: int = LAST, least: float = SIMILAR) -> DataFrame:
    """(session, turn, before, similarity, hit): for each question the most similar of the session's last ones, by cosine of TF-IDF vectors; of equally similar ones the latest.

    asked: session, turn, text; turns of a session are distinct. Each question's words meet those of the questions before it
    by session, place and word, so work grows with the words, whatever the length of a session or
    of a text. Questions with nothing before them that shares a word have null and no hit.
    """
    placed = asked.select("session", "turn").withColumn("place", F.row_number().over(W.partitionBy("session").orderBy("turn")))
    worded = asked.select("session", "turn", F.explode(tokens(F.col("text"))).alias("term")).groupBy("session", "turn", "term").agg(F.count("*").alias("tf"))
    n = asked.count()
    # counts of words are added up in the tasks before they meet
    idf = worded.groupBy("term").agg((F.ln((1 + F.lit(float(n))) / (1 + F.count("*"))) + 1).alias("idf"))
    weighted = cut(worded.join(idf, "term").join(placed, ["session", "turn"]).select("session", "place", "term", (F.col("tf") * F.col("idf")).alias("w")))
    norms = weighted.groupBy("session", "place").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    back = weighted.select("session", "place", "term", "w", F.explode(F.sequence(F.greatest(F.lit(1), F.col("place") - last), F.col("place") - 1)).alias("earlier")).where("place > 1")
    met = back.join(weighted.select("session", F.col("place").alias("earlier"), "term", F.col("w").alias("v")), ["session", "earlier", "term"])
    dots = met.groupBy("session", "place", "earlier").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    of = lambda place, norm: norms.select("session", F.col("place").alias(place), F.col("norm").alias(norm))
    cosines = dots.join(of("place", "a"), ["session", "place"]).join(of("earlier", "b"), ["session", "earlier"]).select("session", "place", "earlier", F.round(F.col("dot") / (F.col("a") * F.col("b")), 6).alias("similarity"))
    best = cosines.groupBy("session", "place").agg(F.max(F.struct("similarity", "earlier")).alias("best")).select("session", "place", F.col("best.earlier").alias("earlier"), "best.similarity")
    turn_of = placed.select("session", F.col("place").alias("earlier"), F.col("turn").alias("before"))
    out = placed.join(best, ["session", "place"], "left").join(turn_of, ["session", "earlier"], "left")
    return out.select("session", "turn", "before", "similarity", F.coalesce(F.col("similarity") >= least, F.lit(False)).alias("hit"))


#: What an entity in common and an equal topic add to a result's score.
PER_ENTITY, SAME_TOPIC = 0.1, 0.2


def lifted(results: DataFrame, contexts: DataFrame) -> DataFrame:
    """(qid, doc_id, score, lifted, rank): results (qid, doc_id, score, entities, topic) with what their query's context (qid, c_entities, c_topic) adds."""
    shared = F.size(F.array_intersect(F.coalesce("entities", F.array().cast("array<string>")), F.coalesce("c_entities", F.array().cast("array<string>"))))
    more = PER_ENTITY * shared + F.when(F.col("topic") == F.col("c_topic"), F.lit(SAME_TOPIC)).otherwise(F.lit(0.0))
    out = results.join(contexts, "qid", "left").select("qid", "doc_id", "score", F.round(F.col("score") + more, 6).alias("lifted"))
    return out.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("lifted"), "doc_id")))


#: Weights of the six signals, and what a session's entities, topic and last questions count for.
WEIGHTS = {"dense": 0.25, "bm25": 0.20, "entity_overlap": 0.20, "session_relevance": 0.15, "cluster_match": 0.10, "text_overlap": 0.10}
OF_ENTITIES, OF_TOPIC, OF_QUESTION, QUESTIONS = 0.5, 0.3, 0.2, 3
#: A BM25 score that counts in full.
FULL_BM25 = 50
#: What takes a value that lies between two roundings to the upper one on every engine.
NUDGE = 1e-9


def six_signals(found: DataFrame) -> DataFrame:
    """(qid, doc_id, the signals of WEIGHTS to four digits, combined, rank) of candidates.

    found: qid, doc_id, score (BM25), dense, words and entities and topic of the document (d_), of the query (q_), and of its session:
    s_entities, s_topic, s_questions (the words of its last questions). Words and entities are sets; nulls count as none.
    """
    some = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    share = lambda a, b: F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))
    d, q, s = (some(F.col(f"{x}_entities")) for x in "dqs")
    words = some(F.col("q_words"))
    asked = F.aggregate(F.coalesce("s_questions", F.array().cast("array<array<string>>")), F.lit(0.0), lambda t, w: t + OF_QUESTION * share(words, w))
    session = F.least(F.lit(1.0), OF_ENTITIES * share(s, d) + F.when(F.col("s_topic") == F.col("d_topic"), F.lit(OF_TOPIC)).otherwise(0.0) + asked)
    most = F.greatest(F.size(d), F.size(q))
    values = {
        "dense": F.coalesce("dense", F.lit(0.0)), "bm25": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score") / FULL_BM25)),
        "entity_overlap": F.when(most == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(d, q)) / most), "session_relevance": session,
        "cluster_match": (F.coalesce(F.col("q_topic") == F.col("d_topic"), F.lit(False))).cast("double"), "text_overlap": share(words, some(F.col("d_words"))),
    }
    out = found.select("qid", "doc_id", *[F.round(v + NUDGE, 4).alias(name) for name, v in values.items()])
    total = sum((weight * F.col(name) for name, weight in WEIGHTS.items()), F.lit(0.0))
    ranked = out.withColumn("combined", F.round(total, 6))  # all digits that four of a signal give
    return ranked.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("combined"), "doc_id")))
