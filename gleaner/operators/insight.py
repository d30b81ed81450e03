"""Signals from sessions and topics, evidence spans, confidence of citations, plans for other goals, and what feedback teaches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions.text import overlap, tokens
from gleaner.operators.planning import PROFILES

#: Topic and its words, the first that has one decides.
TOPICS = [
    ("technology", ["python", "programming", "algorithm", "machine", "learning", "ai", "computer", "software"]),
    ("mythology", ["rama", "krishna", "hanuman", "ramayana", "mahabharata", "hindu", "deity"]),
    ("science", ["physics", "chemistry", "biology", "theory", "research", "study"]),
]
#: What a correction is about, and the words that tell it.
CORRECTIONS = [
    ("outdated", ["outdated", "old", "recent", "latest", "current"]),
    ("incomplete", ["missing", "incomplete", "more", "additional", "also"]),
    ("inaccurate", ["wrong", "incorrect", "false", "error", "mistake"]),
    ("unclear", ["unclear", "confusing", "explain", "clarify", "better"]),
]
#: Groups of keys by what their names contain, the first decides.
KEY_GROUPS = [
    ("identifiers", ["id", "uuid", "key", "index"]),
    ("metadata", ["created", "updated", "modified", "timestamp", "date"]),
    ("content", ["text", "content", "description", "body", "message"]),
]
#: Intents by words that speak for them; the one with most decides, then the earlier one.
INTENTS = [
    ("fact", ["what", "who", "when", "where", "which"]),
    ("causal", ["why", "because", "cause", "reason"]),
    ("procedure", ["how", "steps", "guide", "way"]),
    ("comparison", ["compare", "versus", "difference", "better", "than"]),
    ("summary", ["summarize", "summary", "overview", "about"]),
    ("list", ["list", "all", "every", "examples"]),
    ("opinion", ["think", "should", "best", "recommend"]),
    ("follow_up", ["also", "more", "again", "else"]),
]
#: Age in days at most, and the score.
FRESHNESS = [(1, 1.0), (7, 0.9), (30, 0.8), (90, 0.6)]


def topic(words: Column) -> Column:
    out = F.lit("general")
    for name, terms in reversed(TOPICS):
        out = F.when(F.arrays_overlap(words, F.array(*map(F.lit, terms))), F.lit(name)).otherwise(out)
    return out


def key_group(name: Column) -> Column:
    out = F.lit("other")
    for group, parts in reversed(KEY_GROUPS):
        out = F.when(F.rlike(F.lower(name), F.lit("|".join(parts))), F.lit(group)).otherwise(out)
    return out


def intents(queries: DataFrame) -> DataFrame:
    """(qid, intent, hits, share): the intent most of whose words a query has, and its share of all hits; general without any."""
    words = tokens(F.col("query"))
    hits = [F.size(F.array_intersect(words, F.array(*map(F.lit, terms)))) for _, terms in INTENTS]
    counted = queries.select("qid", F.array(*[F.struct(h.alias("hits"), F.lit(-k).alias("first"), F.lit(name).alias("intent")) for k, (h, (name, _)) in enumerate(zip(hits, INTENTS))]).alias("c"))
    best = counted.select("qid", F.array_max("c").alias("best"), F.aggregate("c", F.lit(0), lambda s, x: s + x["hits"]).alias("all"))
    return best.select("qid", F.when(F.col("all") == 0, F.lit("general")).otherwise(F.col("best.intent")).alias("intent"), F.col("best.hits").cast("long").alias("hits"), F.round(F.when(F.col("all") == 0, F.lit(0.0)).otherwise(F.col("best.hits") / F.col("all")), 6).alias("share"))


def session_relevance(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, topic, relevance): how much a user turn has of the up to three user turns before it; a fifth of its overlap with each, and three tenths for the last one's topic, at most 1."""
    order = W.partitionBy("conv_id").orderBy("turn")
    own = turns.where("role = 'user'").select("conv_id", "turn", tokens(F.col("text")).alias("w"))
    before = own.withColumns({f"b{i}": F.lag("w", i).over(order) for i in (1, 2, 3)})
    shares = [F.when(F.col(f"b{i}").isNotNull(), 0.2 * overlap(F.col(f"b{i}"), F.col("w"))).otherwise(0.0) for i in (1, 2, 3)]
    same = F.when(F.col("b1").isNotNull() & (topic(F.col("b1")) == topic(F.col("w"))), F.lit(0.3)).otherwise(F.lit(0.0))
    return before.select("conv_id", "turn", topic(F.col("w")).alias("topic"), F.round(F.least(F.lit(1.0), reduce(lambda a, b: a + b, shares) + same), 6).alias("relevance"))


def freshness(age_days: Column) -> Column:
    """By age; half for an unknown one."""
    out = F.lit(0.4)
    for days, score in reversed(FRESHNESS):
        out = F.when(age_days <= days, F.lit(score)).otherwise(out)
    return F.when(age_days.isNull(), F.lit(0.5)).otherwise(out)


def spans(answers: DataFrame, evidence: DataFrame, k: int = 5, least: float = 0.3) -> DataFrame:
    """(conv_id, turn, pos, score, rank): sentences of the evidence that share words with the answer: common over own words, the best few above a share."""
    sentences = F.filter(F.transform(F.split("evidence", r"[.!?]+"), lambda s: F.trim(s)), lambda s: F.length(s) > 10)
    cut_up = evidence.select("conv_id", "turn", F.posexplode(sentences).alias("pos", "span"))
    met = cut_up.join(answers.select("conv_id", "turn", tokens(F.col("text")).alias("aw")), ["conv_id", "turn"]).withColumn("sw", tokens(F.col("span")))
    scored = met.select("conv_id", "turn", "pos", F.round(overlap(F.col("sw"), F.col("aw")), 6).alias("score")).where(F.col("score") > least)
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("conv_id", "turn").orderBy(F.desc("score"), "pos"))).where(F.col("rank") <= k)


def calibration_metrics(predicted: DataFrame) -> DataFrame:
    """(n, mae, rmse, pearson) of predictions (p, y)."""
    d = F.col("p") - F.col("y")
    return predicted.agg(F.count("*").alias("n"), F.round(F.avg(F.abs(d)), 6).alias("mae"), F.round(F.sqrt(F.avg(d * d)), 6).alias("rmse"), F.round(F.corr("p", "y"), 6).alias("pearson"))


def citation_confidence(answers: DataFrame, known: DataFrame) -> DataFrame:
    """(answer_id, n_cited, coverage, accuracy, density, confidence) of answers with [id] marks against known ids (doc_id).

    coverage: sentences with a mark; accuracy: marks of known documents; density: how near marks a
    sentence come to 0.3. Weights .3, .3, .15 of .75, as there are no scores of references.
    """
    marks = F.regexp_extract_all("answer", F.lit(r"\[([A-Za-z0-9_-]+)\]"), F.lit(1))
    sentences = F.filter(F.split("answer", r"[.!?]+"), lambda s: F.length(F.trim(s)) > 5)
    base = answers.select("answer_id", marks.alias("marks"), F.size(sentences).alias("n"), F.size(F.filter(sentences, lambda s: F.rlike(s, F.lit(r"\[[A-Za-z0-9_-]+\]")))).alias("cited"))
    valid = base.select("answer_id", F.explode("marks").alias("mark")).join(known.select(F.col("doc_id").cast("string").alias("mark")).distinct(), "mark").groupBy("answer_id").agg(F.count("*").alias("valid"))
    share = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    n_marks = F.size("marks")
    met = base.join(valid, "answer_id", "left").select(
        "answer_id", n_marks.cast("long").alias("n_cited"), F.round(share(F.col("cited"), F.col("n")), 6).alias("coverage"), F.round(share(F.coalesce("valid", F.lit(0)), n_marks), 6).alias("accuracy"),
        F.round(F.greatest(F.lit(0.0), 1 - F.abs(share(n_marks, F.col("n")) - 0.3) / 0.3), 6).alias("density"),
    )
    return met.withColumn("confidence", F.round((0.3 * F.col("coverage") + 0.3 * F.col("accuracy") + 0.15 * F.col("density")) / 0.75, 6))


_K = ["dense", "bm25", "graph"]


def for_accuracy(planned: DataFrame) -> DataFrame:
    """Half as many more results from each retriever, 200 at most, and one hop more, three at most; reranked."""
    more = [F.least(F.floor(F.col(f"{r}_k") * 1.5), F.lit(200)).cast("long").alias(f"{r}_k") for r in _K]
    return planned.select("qid", *more, F.when(F.col("hops") > 0, F.least(F.col("hops") + 1, F.lit(3))).otherwise(F.lit(0)).alias("hops"), F.lit(True).alias("rerank"))


def for_resources(planned: DataFrame) -> DataFrame:
    """The two cheapest retrievers, scaled to 200 results together (ten each at least), one hop at most; reranked up to 100 results."""
    cheap = sorted(_K, key=lambda r: PROFILES[r][2])[:2]
    used = [F.when(F.lit(r in cheap) | (F.col("graph_k") == 0), F.col(f"{r}_k")).otherwise(F.lit(0)) for r in _K]
    total = reduce(lambda a, b: a + b, used)
    scaled = [F.when(u == 0, F.lit(0)).when(total > 200, F.greatest(F.lit(10), F.floor(u * 200 / total))).otherwise(u).cast("long").alias(f"{r}_k") for r, u in zip(_K, used)]
    return planned.select("qid", *scaled, F.least("hops", F.lit(1)).alias("hops"), (total <= 100).alias("rerank"))


def balanced(planned: DataFrame) -> DataFrame:
    """Each retriever's results halfway to its part of 300, two hops at most; reranked."""
    n = reduce(lambda a, b: a + b, [(F.col(f"{r}_k") > 0).cast("int") for r in _K])
    half = [F.when(F.col(f"{r}_k") > 0, F.floor((F.col(f"{r}_k") + F.floor(F.lit(300) / F.greatest(n, F.lit(1)))) / 2)).otherwise(F.lit(0)).cast("long").alias(f"{r}_k") for r in _K]
    return planned.select("qid", *half, F.least("hops", F.lit(2)).alias("hops"), F.lit(True).alias("rerank"))


def similar_performance(done: DataFrame, reach: float = 0.05) -> DataFrame:
    """(strategy, complexity, n_similar, mean_score): of each strategy and complexity, the mean over feedback of the same strategy and nearly the same complexity.

    A band join would pair all with all; here equal complexities are summed first, and a range
    window adds up what lies within reach.
    """
    milli = F.round(F.col("complexity") * 1000).cast("long")
    summed = done.groupBy("strategy", milli.alias("milli")).agg(F.count("*").alias("n"), F.sum("score").alias("sum"))
    around = W.partitionBy("strategy").orderBy("milli").rangeBetween(-round(reach * 1000), round(reach * 1000))
    return summed.select("strategy", (F.col("milli") / 1000).alias("complexity"), F.sum("n").over(around).alias("n_similar"), F.round(F.sum("sum").over(around) / F.sum("n").over(around), 6).alias("mean_score"))


def correction_topics(texts: DataFrame) -> DataFrame:
    """(topic, n): how often words of each topic occur in corrections (text)."""
    named = F.coalesce(*[F.when(F.col("word").isin(words), F.lit(t)) for t, words in CORRECTIONS])
    return texts.select(F.explode(tokens(F.col("text"))).alias("word")).select(named.alias("topic")).where("topic is not null").groupBy("topic").agg(F.count("*").alias("n"))


def intent_performance(rated: DataFrame, least: int = 3) -> DataFrame:
    """(intent, n, mean_rating, negative_share, alarm) of ratings (intent, rating) by intent, for those rated often enough."""
    by = rated.groupBy("intent").agg(F.count("*").alias("n"), F.avg("rating").alias("m"), F.avg((F.col("rating") <= 2).cast("double")).alias("neg")).where(F.col("n") >= least)
    return by.select("intent", "n", F.round("m", 6).alias("mean_rating"), F.round("neg", 6).alias("negative_share"), ((F.col("m") < 3) | (F.col("neg") > 0.4)).alias("alarm"))


def validation_effect(judged: DataFrame) -> DataFrame:
    """(n, n_lenient, n_strict): answers judged good but rated low, and judged bad but rated high. judged: good (boolean), rating."""
    return judged.agg(F.count("*").alias("n"), F.count_if(F.col("good") & (F.col("rating") <= 2)).alias("n_lenient"), F.count_if(~F.col("good") & (F.col("rating") >= 4)).alias("n_strict"))


def answer_errors(answers: DataFrame) -> DataFrame:
    """(conv_id, turn, errors): what is wrong with an answer record (text): too short or long, no end of a sentence, no summary, extreme repetition."""
    words = tokens(F.col("text"))
    n = F.size(words)
    rules = [
        ("empty", F.length(F.trim(F.coalesce("text", F.lit("")))) == 0),
        ("short", F.length(F.coalesce("text", F.lit(""))) < 50),
        ("long", F.length("text") > 5000),
        ("no_end", ~F.rlike(F.trim(F.coalesce("text", F.lit(""))), F.lit(r"[.!?]$"))),
        ("repeats", (n >= 10) & (F.size(F.array_distinct(words)) * 2 < n)),
    ]
    return answers.select("conv_id", "turn", F.array_join(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules])), ",").alias("errors"))


def item_chunks(turns: DataFrame, budget: int = 512) -> DataFrame:
    """(conv_id, chunk, n_items, tokens): a conversation's turns packed in order up to a budget of estimated tokens; one that doesn't fit opens a new chunk. A conversation is one row's work."""
    from gleaner.operators.profile import packed

    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.floor(F.length(F.coalesce("text", F.lit(""))) / 4).cast("int").alias("size")))).alias("items"))
    sized = listed.select("conv_id", F.transform("items", lambda x: x["size"]).alias("sizes"))
    each = sized.select("conv_id", F.explode(F.arrays_zip(packed(F.col("sizes"), F.col("sizes"), budget).alias("chunk"), F.col("sizes").alias("size"))).alias("x"))
    return each.groupBy("conv_id", "x.chunk").agg(F.count("*").alias("n_items"), F.sum("x.size").alias("tokens"))


def json_profile(rows: DataFrame, column: str) -> DataFrame:
    """(key, group, kind, n, n_distinct) of the top keys of JSON objects: kind is told by whether all values look like numbers."""
    pairs = rows.select(F.explode(F.from_json(F.col(column), "map<string,string>")).alias("key", "value"))
    number = F.rlike("value", F.lit(r"^-?[0-9]+(\.[0-9]+)?$"))
    by = pairs.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_distinct"), F.when(F.min(number), F.lit("number")).otherwise(F.lit("text")).alias("kind"))
    return by.select("key", key_group(F.col("key")).alias("group"), "kind", "n", "n_distinct")
