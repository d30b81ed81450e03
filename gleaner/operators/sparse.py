"""Keyword retrieval over batches of queries: BM25 and TF-IDF.

A document's words are filtered by the queries' terms inside its row, so only matches leave it.
The matches are written once (index()), a row for each document, with how many documents have each
term and how long documents are on average; all scores are made from them. best() adds up a document's
scores inside its task, which keeps each query's best few, so pairs of queries and documents are
neither written nor shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gleaner.functions.shared import cut
from gleaner.functions.text import tokens

K1, B = 1.2, 0.75
#: Query terms up to this many rows are broadcast; more are joined by shuffle.
BROADCAST_TERMS = 200_000
#: Ids that are looked at together for documents that a query doesn't match.
PREFIX = 200_000
#: Scores, and parts of scores, that a task holds at a time, about.
CELLS = 1 << 20


def query_terms(queries: DataFrame, id_col: str = "qid", text_col: str = "query") -> DataFrame:
    """(qid, term, qn)."""
    return queries.select(F.col(id_col).alias("qid"), F.explode(tokens(F.col(text_col))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qn"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_TERMS else df


def matches(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, dl, term, tf) for the terms only."""
    words = docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("words"))
    each = words.select("doc_id", F.size("words").alias("dl"), F.explode("words").alias("term"))
    return each.join(_small(terms.select("term").distinct()), "term", "left_semi").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))


@dataclass(frozen=True)
class Index:
    """found: (doc_id, dl, term, tf), df: (term, df), documents and their mean words; rows: the matches as a row for each document, by the places of their words in the sorted vocabulary."""

    found: DataFrame
    df: DataFrame
    n: int
    average: float
    rows: DataFrame | None = None
    vocabulary: list[str] | None = None


def index(docs: DataFrame, terms: DataFrame) -> Index:
    """What all scores of these terms need, made once."""
    distinct = terms.select("term").distinct()
    if distinct.count() > BROADCAST_TERMS:
        found = cut(matches(docs, terms))
        return Index(found, found.groupBy("term").agg(F.count("*").alias("df")), *statistics(docs))
    vocabulary = sorted(r["term"] for r in distinct.collect())  # BROADCAST_TERMS at most
    rows = _merged(cut(_matched(docs, vocabulary)))
    names = F.broadcast(docs.sparkSession.createDataFrame(list(enumerate(vocabulary)), "place int, term string"))
    postings = rows.select("doc_id", F.inline(F.arrays_zip(F.col("dls").alias("dl"), F.col("places").alias("place"), F.col("tfs").alias("tf"))))
    found = postings.join(names, "place").select("doc_id", "dl", "term", F.col("tf").cast("long").alias("tf"))
    counts = rows.select(F.explode("places").alias("place")).groupBy("place").agg(F.count("*").alias("df"))
    total = rows.agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
    n = total["n"] or 0
    return Index(found, cut(counts.join(names, "place").select("term", "df")), n, total["words"] / n if n else 0.0, rows, vocabulary)


def _matched(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, n, words, places, tfs, dls) for each row of docs: its count of words, and its words of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.string())
        for batch in batches:
            words, size = batch.column("words"), len(batch)
            lengths = np.diff(words.offsets.to_numpy())
            place = pc.fill_null(pc.index_in(words.flatten(), value_set=known), -1).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(size), lengths)[place >= 0]
            key, tf = np.unique(row * len(known) + place[place >= 0], return_counts=True)
            row, place = np.divmod(key, max(1, len(known)))
            ends = np.zeros(size + 1, np.int32)
            np.cumsum(np.bincount(row, minlength=size), out=ends[1:])
            lists = [pa.ListArray.from_arrays(ends, x.astype(np.int32)) for x in (place, tf, lengths[row])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.ones(size, np.int64)), pa.array(lengths.astype(np.int64)), *lists], ["doc_id", "n", "words", "places", "tfs", "dls"])

    words = docs.select(F.col("doc_id").cast("long"), tokens(F.col("text")).alias("words"))
    return words.mapInArrow(run, "doc_id long, n long, words long, places array<int>, tfs array<int>, dls array<int>")


def _merged(rows: DataFrame) -> DataFrame:
    """A row for each id; where no id is repeated, that is what there is. As in matches(), rows with the same id and length are one."""
    if rows.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
        return rows
    each = rows.select("doc_id", F.inline_outer(F.arrays_zip(F.col("dls").alias("dl"), F.col("places").alias("place"), F.col("tfs").alias("tf"))))
    one = each.groupBy("doc_id", "dl", "place").agg(F.sum("tf").cast("int").alias("tf")).groupBy("doc_id").agg(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "tf", "dl"))).alias("p"))
    sizes = rows.groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    both = sizes.join(one.withColumnRenamed("doc_id", "same"), F.col("doc_id").eqNullSafe(F.col("same")))
    return cut(both.select("doc_id", "n", "words", F.col("p.place").alias("places"), F.col("p.tf").alias("tfs"), F.col("p.dl").alias("dls")))


def best(ix: Index, terms: DataFrame, k: int, by: str = "bm25") -> DataFrame:
    """(qid, doc_id, score, rank): top() of bm25() or coverage(), the same scores added up inside tasks where the index has rows."""
    if ix.rows is None or terms.count() > BROADCAST_TERMS:
        return top(bm25(ix, terms) if by == "bm25" else coverage(ix, terms), k)
    part, share = (F.col("qn") * bm25_idf(ix.n), F.lit(1)) if by == "bm25" else (F.lit(1.0), F.count("*").over(W.partitionBy("qid")))
    # BROADCAST_TERMS at most
    asked = [tuple(r) for r in terms.join(F.broadcast(ix.df), "term", "left").select("qid", share.alias("share"), "term", part.alias("part")).collect()]
    shared, average, qid = ix.rows.sparkSession.sparkContext.broadcast((ix.vocabulary, asked)), ix.average, terms.schema["qid"].dataType
    kind = to_arrow_type(qid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _best(*shared.value, batches, k, (lambda tf, dl: weight(tf, dl, average)) if by == "bm25" else None, kind)

    return top(ix.rows.select("doc_id", "places", "tfs", "dls").mapInArrow(run, f"qid {qid.simpleString()}, doc_id long, score double"), k)


def _best(vocabulary: list[str], asked: list[tuple], batches: Iterator[pa.RecordBatch], k: int, weighed, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Each query's best k of a task's documents, by rounded score and then id (null first, as Spark sorts). asked: qid, divisor, term, factor; weighed: by counts and lengths, if at all."""
    place_of = {w: i for i, w in enumerate(vocabulary)}
    sizes = {q: n for q, n, _, _ in asked}
    qids, divisor = list(sizes), np.array(list(sizes.values()), float)
    number = {q: i for i, q in enumerate(qids)}
    asked = sorted((place_of[t], number[q], w) for q, _, t, w in asked if w is not None)
    place, query, of_query = (np.array(x, kind) for x, kind in zip(zip(*asked) if asked else ([], [], []), (np.int64, np.int64, float)))
    size = np.bincount(place, minlength=len(vocabulary)).astype(np.int64)
    first, null = np.cumsum(size) - size, np.iinfo(np.int64).min
    least, last = np.full(len(qids), -np.inf), np.full(len(qids), np.iinfo(np.int64).max)  # the k-th best so far
    held, waiting = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)], []

    def settle() -> None:
        nonlocal held, waiting
        q, doc, score = (np.concatenate(x) for x in zip(held, *waiting))
        order = np.lexsort((doc, -score, q))
        q, doc, score = q[order], doc[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        at = rank == k - 1
        least[q[at]], last[q[at]] = score[at], doc[at]
        held, waiting = [x[rank < k] for x in (q, doc, score)], []

    for batch in batches:
        ids = pc.fill_null(batch.column("doc_id"), null).to_numpy()
        places, tf, dl = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("places", "tfs", "dls"))
        row = np.repeat(np.arange(len(ids)), np.diff(batch.column("places").offsets.to_numpy()))
        parts = weighed(tf, dl) if weighed else np.ones(len(tf))
        # documents taken together: so many of their scores, and of their words' queries, are held at a time
        cost = np.bincount(row, size[places], len(ids)) + len(qids)
        block = (np.cumsum(cost) // CELLS).astype(np.int64)
        for low, high in zip(*(np.searchsorted(block, np.unique(block), side) for side in ("left", "right"))):
            these = slice(*np.searchsorted(row, [low, high]))
            n = size[places[these]]
            one = np.repeat(np.arange(these.start, these.stop), n)
            at = np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n) + first[places[one]]
            cell = (row[one] - low) * len(qids) + query[at]
            cells = (high - low) * len(qids)
            hits = np.nonzero(np.bincount(cell, minlength=cells))[0]
            doc, q = np.divmod(hits, max(1, len(qids)))
            total, doc = np.bincount(cell, of_query[at] * parts[one], cells)[hits] / divisor[q], ids[low + doc]
            score = np.copysign(np.floor(np.abs(total) * 1e6 + 0.5) / 1e6, total) + 0.0  # half up, as Spark rounds
            good = (score > least[q]) | (score == least[q]) & (doc < last[q])
            waiting.append((q[good], doc[good], score[good]))
            if sum(len(x[0]) for x in waiting) > CELLS:
                settle()
    if waiting:
        settle()
    q, doc, score = held
    yield pa.RecordBatch.from_arrays([pa.array([qids[i] for i in q.tolist()], kind), pa.array(doc, mask=doc == null), pa.array(score)], ["qid", "doc_id", "score"])


def statistics(docs: DataFrame, text_col: str = "text") -> tuple[int, float]:
    """(documents, mean words)."""
    r = docs.agg(F.count("*").alias("n"), F.avg(F.size(tokens(F.col(text_col)))).alias("a")).first()
    return r["n"], r["a"] or 0.0


def bm25_idf(n: int) -> Column:
    return F.ln((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))


def weight(tf, dl, average: float):
    """Of a word's count in a document of a length: of columns as of arrays."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))


def bm25_weight(average: float) -> Column:
    return weight(F.col("tf"), F.col("dl"), average)


def bm25_contributions(ix: Index, terms: DataFrame) -> DataFrame:
    """(qid, doc_id, term, idf, contribution) of each query term that a document has."""
    weighted = terms.join(ix.df, "term")
    return ix.found.join(_small(weighted), "term").select("qid", "doc_id", "term", bm25_idf(ix.n).alias("idf"), (F.col("qn") * bm25_idf(ix.n) * bm25_weight(ix.average)).alias("contribution"))


def bm25(ix: Index, terms: DataFrame) -> DataFrame:
    """(qid, doc_id, score) of documents with a query term; scores are rounded, so that ties break alike everywhere."""
    return bm25_contributions(ix, terms).groupBy("qid", "doc_id").agg(F.round(F.sum("contribution"), 6).alias("score"))


def bm25_all(docs: DataFrame, ix: Index, terms: DataFrame, k: int) -> DataFrame:
    """Each query's best k of all documents: those that match nothing score 0, which ranks above common words' negative scores.

    Only a query with fewer than k scores above 0 needs documents that it doesn't match, the k with the smallest ids.
    """
    scored = cut(bm25(ix, terms))
    good = scored.where("score > 0").groupBy("qid").agg(F.count("*").alias("good"))
    asked = terms.select("qid").distinct().join(good, "qid", "left").where(F.coalesce("good", F.lit(0)) < k).select("qid")
    zero = first_unmatched(docs.select("doc_id"), cut(asked), scored.select("qid", "doc_id"), k)
    return top(scored.unionByName(zero.withColumn("score", F.lit(0.0))), k)


def first_unmatched(ids: DataFrame, asked: DataFrame, matched: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id): for each query asked the k smallest ids (all, if there are fewer) that it doesn't match.

    A prefix of the ids, a few times k of them, settles the queries that leave k of it unmatched; the others see longer ones.
    A prefix is one array of at most PREFIX ids, and a query's matches in it are taken out inside its row. What even that
    doesn't settle are queries that match nearly everything; their ids are taken out of all, which is about as many as they match.
    """
    span = ids.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).first()
    out, share = None, min(1.0, 8 * k / max(span["n"], 1))
    while span["n"] and not asked.isEmpty():
        bound = span["high"] if share >= 1 else span["low"] + int((span["high"] - span["low"]) * share)
        prefix = ids.where(F.col("doc_id") <= bound)
        if prefix.count() > PREFIX:
            pairs = ids.join(F.broadcast(asked.agg(F.collect_list("qid").alias("qids"))), F.lit(True)).select(F.explode("qids").alias("qid"), "doc_id") if asked.count() <= BROADCAST_TERMS else asked.crossJoin(ids)
            left = pairs.join(matched, ["qid", "doc_id"], "left_anti")
            place = F.row_number().over(W.partitionBy("qid").orderBy("doc_id"))
            found, settled = left.withColumn("place", place).where(F.col("place") <= k).select("qid", "doc_id"), asked
        else:
            one = prefix.agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
            own = matched.where(F.col("doc_id") <= bound).join(_small(asked), "qid", "left_semi").groupBy("qid").agg(F.collect_set("doc_id").alias("own"))
            seen = asked.join(own, "qid", "left").join(F.broadcast(one), F.lit(True))  # one row of PREFIX ids at most
            free = cut(seen.select("qid", F.filter(F.array_except("ids", F.coalesce("own", F.array().cast("array<long>"))), lambda x: x.isNotNull()).alias("free")).where((F.size("free") >= k) | F.lit(share >= 1)).select("qid", F.slice("free", 1, k).alias("free")))
            found, settled = free.select("qid", F.explode("free").alias("doc_id")), free.select("qid")
        out = found if out is None else out.unionByName(found)
        if share >= 1 or settled is asked:
            break
        asked, share = cut(asked.join(settled, "qid", "left_anti")), min(1.0, share * 8)
    return out if out is not None else matched.limit(0)


def tfidf(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, doc_id, score): cosine of smoothed TF-IDF vectors; norms are over all words of a document.

    The corpus's postings are written once; document counts of words are pre-aggregated in tasks.
    """
    n = docs.count()
    each = cut(docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf")))
    idf = each.groupBy("term").agg((F.ln((1 + F.lit(float(n))) / (1 + F.count("*"))) + 1).alias("idf"))
    weighted = each.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    own = W.partitionBy("qid")
    wanted = terms.join(idf, "term").withColumn("qw", F.col("qn") * F.col("idf"))
    wanted = wanted.withColumn("qw", F.col("qw") / F.sqrt(F.sum(F.col("qw") * F.col("qw")).over(own))).select("term", F.struct("qid", "qw").alias("q"))
    # a word meets the queries that ask for it as one list, so norms and products come from one pass over the postings
    asked = wanted.groupBy("term").agg(F.collect_list("q").alias("asked"))
    met = weighted.join(_small(asked), "term", "left")
    norms = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("doc_id")))
    dots = met.withColumn("norm", norms).where("asked is not null").select("doc_id", "norm", "w", F.inline("asked"))
    return dots.groupBy("qid", "doc_id", "norm").agg(F.sum(F.col("w") * F.col("qw")).alias("dot")).select("qid", "doc_id", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))


def coverage(ix: Index, terms: DataFrame) -> DataFrame:
    """(qid, doc_id, score): share of the query's distinct words that a document has."""
    sizes = terms.groupBy("qid").agg(F.count("*").alias("size"))
    hit = ix.found.join(_small(terms), "term").groupBy("qid", "doc_id").agg(F.count("*").alias("hit"))
    return hit.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_TERMS else sizes, "qid").select("qid", "doc_id", F.round(F.col("hit") / F.col("size"), 6).alias("score"))


def top(scored: DataFrame, k: int, by: str = "score") -> DataFrame:
    """Best k of each query with their ranks; ties go to the smaller id. The limit reaches the tasks before the shuffle."""
    order = W.partitionBy("qid").orderBy(F.desc(by), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
