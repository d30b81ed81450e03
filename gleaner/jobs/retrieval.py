"""Registered retrieval queries, each with its DuckDB SQL."""

from __future__ import annotations

from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.shared import cut
from gleaner.functions.text import preview, tokens
from gleaner.operators import dense, fusion, rerank, sparse
from gleaner.sources import keyword_index, vector_index

#: Queries up to this many rows are broadcast.
BROADCAST_QUERIES = 10_000


def _t(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _documents(spark, d) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", "text")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_QUERIES else df


def benchmark_queries(spark, d) -> DataFrame:
    """(qid, query): the words of each benchmark item."""
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.array_join(tokens(F.col("text")), " ").alias("query"))


def _indexed(spark, d) -> tuple[sparse.Index, DataFrame]:
    terms = sparse.query_terms(benchmark_queries(spark, d))
    return sparse.index(_documents(spark, d), terms), terms


def _best(spark, d, k: int) -> DataFrame:
    return sparse.best(*_indexed(spark, d), k)


def vectors(spark, d) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))


def vector_queries(spark, d) -> DataFrame:
    """Every vector whose id is divisible by 50, against all."""
    return vectors(spark, d).where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), F.col("v").alias("q"))


def candidates(spark, d, k: int = 20) -> DataFrame:
    """(qid, retriever, doc_id, score, rank) of three retrievers; a benchmark item's vector is the one of its id."""
    ix, terms = _indexed(spark, d)
    q = vectors(spark, d).join(_small(benchmark_queries(spark, d).select("qid")), F.col("doc_id") == F.col("qid")).select("qid", F.col("v").alias("q"))
    parts = {"bm25": sparse.best(ix, terms, k), "coverage": sparse.best(ix, terms, k, "coverage"), "dense": dense.nearest(vectors(spark, d), q, k)}
    out = None
    for name, rows in parts.items():
        rows = rows.select("qid", F.lit(name).alias("retriever"), "doc_id", "score", "rank")
        out = rows if out is None else out.unionByName(rows)
    return out


TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
_BASE = f"""
d AS (SELECT doc_id, text, {TOKENS} AS w FROM documents),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS a FROM d),
qs AS (SELECT item_id AS qid, array_to_string({TOKENS}, ' ') AS query FROM benchmark),
qt AS (SELECT qid, term, count(*) AS qn FROM (SELECT qid, unnest(string_split(query, ' ')) AS term FROM qs) GROUP BY ALL),
m AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM m GROUP BY term),
con AS (SELECT qid, doc_id, term, ln((n - df + 0.5) / (df + 0.5)) AS idf, qn * ln((n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS c
        FROM m JOIN f USING (term) JOIN qt USING (term), st),
bm AS (SELECT qid, doc_id, round(sum(c), 6) AS score FROM con GROUP BY ALL),
cov AS (SELECT qid, doc_id, round(count(*) / any_value(size), 6) AS score FROM m JOIN qt USING (term) JOIN (SELECT qid, count(*) AS size FROM qt GROUP BY qid) USING (qid) GROUP BY ALL)"""


def _ranked(name: str, k: int) -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM {name} QUALIFY rank <= {k})"


_D2 = "list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"
_NEAR = f"SELECT q.vec_id AS qid, v.vec_id AS doc_id, round(1 / (1 + {_D2}), 6) AS score FROM embeddings v, embeddings q"
_CANDIDATES = f"""{_BASE},
dn AS ({_NEAR} WHERE q.vec_id IN (SELECT qid FROM qs)),
cand AS (SELECT qid, 'bm25' AS retriever, doc_id, score, rank FROM {_ranked("bm", 20)} UNION ALL SELECT qid, 'coverage', doc_id, score, rank FROM {_ranked("cov", 20)} UNION ALL SELECT qid, 'dense', doc_id, score, rank FROM {_ranked("dn", 20)})"""
_NORMS = {
    "min_max": "CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END",
    "z_score": "CASE WHEN hi = lo THEN 0.0 ELSE (score - mean) / sd END",
    "softmax": "exp(score - hi) / sum(exp(score - hi)) OVER (PARTITION BY qid, retriever)",
}


def _normed(how: str) -> str:
    return f"""{_CANDIDATES},
ns AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi, avg(score) OVER w AS mean, stddev_pop(score) OVER w AS sd, max(abs(score)) OVER w AS big FROM cand WINDOW w AS (PARTITION BY qid, retriever)),
nm AS (SELECT qid, retriever, doc_id, score, rank, round(CASE WHEN big = 0 THEN score ELSE {_NORMS[how]} END, 6) AS norm FROM ns)"""


_FUSED = {
    "rrf": "SELECT qid, doc_id, sum(1 / (60 + rank)) AS s FROM nm GROUP BY ALL",
    "weighted": "SELECT qid, doc_id, sum(CASE retriever WHEN 'bm25' THEN 0.5::DOUBLE WHEN 'coverage' THEN 0.2::DOUBLE ELSE 0.3::DOUBLE END * norm) AS s FROM nm GROUP BY ALL",
    "borda": "SELECT qid, doc_id, sum(p)::DOUBLE AS s FROM (SELECT *, count(*) OVER (PARTITION BY qid, retriever) - rank + 1 AS p FROM nm) GROUP BY ALL",
    "combsum": "SELECT qid, doc_id, sum(norm) AS s FROM nm GROUP BY ALL",
    "combmnz": "SELECT qid, doc_id, sum(greatest(norm, 0)) * count(*) FILTER (norm > 0) AS s FROM nm GROUP BY ALL HAVING count(*) FILTER (norm > 0) > 0",
    "max": "SELECT qid, doc_id, max(norm) AS s FROM nm GROUP BY ALL HAVING max(norm) > 0",
    "min": "SELECT qid, doc_id, min(norm) AS s FROM nm GROUP BY ALL",
}


def _fuse(method: str, spark, d, k: int = 10) -> DataFrame:
    found = candidates(spark, d)
    return sparse.top(fusion.fuse(found if method in ("rrf", "borda") else fusion.normalize(found), method), k)


def _explain(s, d):
    ix, terms = _indexed(s, d)
    best = cut(sparse.best(ix, terms, 1).select("qid", "doc_id"))
    found = ix.found.join(_small(best.select("doc_id").distinct()), "doc_id", "left_semi")
    return sparse.bm25_contributions(replace(ix, found=found), terms).join(best, ["qid", "doc_id"]).select("qid", "doc_id", "term", F.round("idf", 6).alias("idf"), F.round("contribution", 6).alias("contribution"))


def _hybrid(s, d):
    fused = cut(_fuse("rrf", s, d))
    texts = _t(s, d, "documents").join(_small(fused.select("doc_id").distinct()), "doc_id", "left_semi")
    return fused.join(texts.select("doc_id", preview(F.col("text"), 80).alias("preview")), "doc_id", "left").select("qid", "doc_id", "score", "rank", "preview")


def _contributions(s, d):
    """Of each fused result: which retrievers found it, and at what ranks."""
    found = candidates(s, d)
    best = sparse.top(fusion.fuse(found, "rrf"), 10).select("qid", "doc_id", "rank")
    by = found.groupBy("qid", "doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("retriever", "rank"))), lambda x: F.concat(x["retriever"], F.lit(":"), x["rank"].cast("string"))), ",").alias("found_by"), F.count("*").alias("n_retrievers"))
    return best.join(by, ["qid", "doc_id"])


def _with_text(s, d, k):
    """BM25 candidates with their words and their queries'."""
    return _best(s, d, k).join(_documents(s, d), "doc_id").join(_small(benchmark_queries(s, d)), "qid")


def _cascade(s, d):
    return rerank.cascade(_with_text(s, d, 30)).select("qid", "doc_id", "first_rank", "final", "rank")


def _multihop(s, d):
    return rerank.multihop(_documents(s, d), benchmark_queries(s, d), hops=2, k=5)


def _precision(s, d):
    labels = _t(s, d, "labels")
    n_good = labels.agg(F.coalesce(F.sum("quality"), F.lit(0)).cast("long").alias("n_good"))
    best = _best(s, d, 10).join(labels, "doc_id", "left")
    good = F.coalesce(F.col("quality"), F.lit(0))
    by = best.groupBy("qid").agg(F.round(F.sum(F.when(F.col("rank") <= 5, good).otherwise(0)) / 5, 6).alias("p_at_5"), F.sum(good).cast("long").alias("hits_at_10"))
    total = n_good.first()["n_good"]  # one number
    return by.withColumn("recall_at_10", F.round(F.col("hits_at_10") / F.lit(max(total, 1)), 6))


def _signal_statistics(s, d):
    x = rerank.signals(_with_text(s, d, 30))
    parts = [F.struct(F.lit(c).alias("signal"), F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_pop(c), 6).alias("sd")) for c in ("text_overlap", "length_penalty", "bm25", "combined")]
    return x.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def _bm25_stored(s, d):
    return keyword_index.search(s, keyword_index.put(_documents(s, d)), benchmark_queries(s, d), 10)


def _bm25_changed(s, d):
    """An index of all documents, from which those labelled toxic are deleted and in which the good ones are replaced by their text after their source's name; compacted in between."""
    docs, labels = _t(s, d, "documents"), _t(s, d, "labels")
    path = keyword_index.put(docs)
    keyword_index.delete(s, path, labels.where("toxic = 1"))
    keyword_index.compact(s, path)
    good = docs.join(labels.where("quality = 1 and toxic = 0").select("doc_id").distinct(), "doc_id", "left_semi")
    keyword_index.put(good.select("doc_id", F.concat_ws(" ", "source", "text").alias("text")), path)
    return keyword_index.search(s, path, benchmark_queries(s, d), 10)


def _vector_rows(s, d):
    return _t(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def _ivf(s, d):
    """Every vector whose id is divisible by 50 searches two thirds of the cells, as these data's directions have no structure."""
    rows = _vector_rows(s, d)
    path = vector_index.build(rows)
    cells = vector_index.Reader(s, path).model.centres.shape[0]
    return vector_index.search(s, path, vector_queries(s, d), 10, probe=-(-2 * cells // 3), shortlist=100)


def _vector_changes(s, d):
    """What an index of all vectors holds after those of label 0 are deleted, those of label 1 halved, and both are compacted."""
    e = _t(s, d, "embeddings")
    path = vector_index.build(_vector_rows(s, d))
    vector_index.delete(s, path, e.where("label = 0"), "vec_id")
    vector_index.put(e.where("label = 1").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x / 2).alias("v")), path)
    vector_index.compact(s, path)
    return vector_index.Reader(s, path).vectors().select("id", F.size("v").cast("long").alias("dimension"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


_TFIDF = f"""WITH {_BASE},
e AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
i AS (SELECT term, ln((1 + (SELECT n FROM st)) / (1 + count(*))) + 1 AS idf FROM e GROUP BY term),
x AS (SELECT doc_id, term, tf * idf AS w FROM e JOIN i USING (term)),
nr AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM x GROUP BY doc_id),
qw AS (SELECT qid, term, qn * idf AS q0 FROM qt JOIN i USING (term)),
qx AS (SELECT qid, term, q0 / sqrt(sum(q0 * q0) OVER (PARTITION BY qid)) AS qw FROM qw),
sc AS (SELECT qid, doc_id, round(sum(w * qw) / any_value(norm), 6) AS score FROM x JOIN qx USING (term) JOIN nr USING (doc_id) GROUP BY ALL)
SELECT * FROM {_ranked("sc", 10)}"""

_RERANK = f"""WITH {_BASE},
c AS (SELECT b.*, list_distinct(string_split(query, ' ')) AS qw, len(list_intersect(string_split(query, ' '), w)) / len(list_distinct(string_split(query, ' '))) AS ov, w, text
      FROM {_ranked("bm", 30)} b JOIN d USING (doc_id) JOIN qs USING (qid))"""

QUERIES = {
    "bm25_batch": lambda s, d: _best(s, d, 10),
    "bm25_stored": _bm25_stored,
    "bm25_stored_changes": _bm25_changed,
    "ivf_search": _ivf,
    "vector_index_changes": _vector_changes,
    "bm25_topk": lambda s, d: sparse.bm25_all(_documents(s, d), *_indexed(s, d), 10),
    "tfidf_topk": lambda s, d: sparse.top(sparse.tfidf(_documents(s, d), sparse.query_terms(benchmark_queries(s, d))), 10),
    "term_importance": lambda s, d: sparse.bm25_contributions(*_indexed(s, d)).select("term", F.round("idf", 6).alias("idf")).distinct(),
    "explain_terms": _explain,
    "dense_batch": lambda s, d: dense.nearest(vectors(s, d), vector_queries(s, d), 10),
    "dense_similar": lambda s, d: dense.nearest(vectors(s, d), vector_queries(s, d), 5, exclude_self=True),
    "dense_threshold": lambda s, d: dense.nearest(vectors(s, d), vector_queries(s, d), 10, threshold=0.45),
    **{f"norm_{how}": (lambda how: lambda s, d: fusion.normalize(candidates(s, d), how))(how) for how in _NORMS},
    **{f"fuse_{m}": partial(_fuse, m) for m in _FUSED},
    "fusion_contributions": _contributions,
    "fusion_quality": lambda s, d: fusion.quality(candidates(s, d)),
    "hybrid_retrieve": _hybrid,
    "overlap_rerank": lambda s, d: rerank.by_overlap(_with_text(s, d, 20)).select("qid", "doc_id", "score", "boosted", "rank"),
    "cascade_rerank": _cascade,
    "rerank_impact": lambda s, d: rerank.impact(rerank.by_overlap(_with_text(s, d, 30))),
    "diversity_filter": lambda s, d: rerank.diverse(_with_text(s, d, 30)).select("qid", "doc_id", "rank"),
    "quality_threshold": lambda s, d: rerank.above_threshold(_with_text(s, d, 30)).select("qid", "doc_id", "score", "rank"),
    "quality_filter_greedy": lambda s, d: rerank.greedy_filter(_with_text(s, d, 30)),
    "jaccard_pairs": lambda s, d: rerank.jaccard_to_best(_with_text(s, d, 30)),
    "signals": lambda s, d: rerank.signals(_with_text(s, d, 30)).select("qid", "doc_id", "text_overlap", "length_penalty", "bm25", "combined"),
    "signals_normalized": lambda s, d: rerank.normalized(rerank.signals(_with_text(s, d, 30))).select("qid", "doc_id", "combined_norm"),
    "signal_statistics": _signal_statistics,
    "signal_corr": lambda s, d: rerank.correlations(rerank.signals(_with_text(s, d, 30))),
    "multihop_retrieve": _multihop,
    "precision_recall_at_k": _precision,
}

_SIGNALS = f"""{_RERANK},
sg AS (SELECT qid, doc_id, round(ov, 6) AS text_overlap, CASE WHEN len(w) < 100 THEN 0.8 WHEN len(w) <= 500 THEN 1.0 WHEN len(w) > 1000 THEN 0.7 ELSE 0.9 END::DOUBLE AS length_penalty, score AS bm25 FROM c),
sc AS (SELECT *, round(least(1.0::DOUBLE, 0.25::DOUBLE * greatest(0.0::DOUBLE, bm25 / 50) + 0.6::DOUBLE * text_overlap + 0.15::DOUBLE * length_penalty), 6) AS combined FROM sg)"""

ORACLE = {
    "bm25_batch": f"WITH {_BASE} SELECT * FROM {_ranked('bm', 10)}",
    "bm25_stored": f"WITH {_BASE} SELECT * FROM {_ranked('bm', 10)}",
    "bm25_stored_changes": f"WITH now AS (SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0) THEN concat_ws(' ', source, text) ELSE text END AS text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)), {_BASE.replace('FROM documents', 'FROM now')} SELECT * FROM {_ranked('bm', 10)}",
    "vector_index_changes": "SELECT vec_id AS id, len(embedding)::BIGINT AS dimension, round(CASE WHEN label = 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END * list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings WHERE label <> 0",
    "bm25_topk": f"""WITH {_BASE},
al AS (SELECT q.qid, d.doc_id, coalesce(score, 0.0) AS score FROM qs q, d LEFT JOIN bm ON bm.qid = q.qid AND bm.doc_id = d.doc_id)
SELECT * FROM {_ranked('al', 10)}""",
    "tfidf_topk": _TFIDF,
    "term_importance": f"WITH {_BASE} SELECT DISTINCT term, round(idf, 6) AS idf FROM con",
    "explain_terms": f"WITH {_BASE} SELECT con.qid, con.doc_id, term, round(idf, 6) AS idf, round(c, 6) AS contribution FROM con JOIN {_ranked('bm', 1)} b ON con.qid = b.qid AND con.doc_id = b.doc_id",
    "dense_batch": f"WITH dn AS ({_NEAR} WHERE q.vec_id % 50 = 0) SELECT * FROM {_ranked('dn', 10)}",
    "dense_similar": f"WITH dn AS ({_NEAR} WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id) SELECT * FROM {_ranked('dn', 5)}",
    "dense_threshold": f"WITH dn AS ({_NEAR} WHERE q.vec_id % 50 = 0) SELECT * FROM {_ranked('dn', 10)} WHERE score >= 0.45",
    **{f"norm_{how}": f"WITH {_normed(how)} SELECT * FROM nm" for how in _NORMS},
    **{f"fuse_{m}": f"WITH {_normed('min_max')}, fs AS (SELECT qid, doc_id, round(s, 9) AS score FROM ({sql})) SELECT * FROM {_ranked('fs', 10)}" for m, sql in _FUSED.items()},
    "fusion_quality": f"WITH {_CANDIDATES} SELECT qid, retriever, count(*) AS n, round(min(score), 9) AS low, round(max(score), 9) AS high, round(avg(score), 9) AS mean, round(stddev_pop(score), 9) AS sd, round(median(score), 9) AS middle FROM cand GROUP BY ALL",
    "hybrid_retrieve": f"WITH {_normed('min_max')}, fs AS (SELECT qid, doc_id, round(s, 9) AS score FROM ({_FUSED['rrf']})) SELECT t.qid, t.doc_id, t.score, t.rank, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS preview FROM {_ranked('fs', 10)} t LEFT JOIN d USING (doc_id)",
    "fusion_contributions": f"""WITH {_normed('min_max')}, fs AS (SELECT qid, doc_id, round(s, 9) AS score FROM ({_FUSED['rrf']})),
by_doc AS (SELECT qid, doc_id, string_agg(retriever || ':' || rank, ',' ORDER BY retriever) AS found_by, count(*) AS n_retrievers FROM cand GROUP BY ALL)
SELECT t.qid, t.doc_id, t.rank, found_by, n_retrievers FROM {_ranked('fs', 10)} t JOIN by_doc USING (qid, doc_id)""",
    "overlap_rerank": f"{_RERANK}, b AS (SELECT qid, doc_id, score, round(score + 0.1::DOUBLE * ov, 6) AS boosted FROM c WHERE rank <= 20) SELECT *, row_number() OVER (PARTITION BY qid ORDER BY boosted DESC, doc_id) AS rank FROM b",
    "cascade_rerank": f"{_RERANK}, a AS (SELECT qid, doc_id, score, ov, len(w) AS n, row_number() OVER (PARTITION BY qid ORDER BY round(score + 0.1::DOUBLE * ov, 6) DESC, doc_id) AS first_rank FROM c), b AS (SELECT *, round(0.7::DOUBLE * ov + 0.3::DOUBLE * CASE WHEN n < 100 THEN 0.8 WHEN n <= 500 THEN 1.0 WHEN n > 1000 THEN 0.7 ELSE 0.9 END::DOUBLE, 6) AS final FROM a) SELECT qid, doc_id, first_rank, final, row_number() OVER (PARTITION BY qid ORDER BY final DESC, doc_id) AS rank FROM b QUALIFY rank <= 7",
    "rerank_impact": f"{_RERANK}, b AS (SELECT qid, rank AS old_rank, row_number() OVER (PARTITION BY qid ORDER BY round(score + 0.1::DOUBLE * ov, 6) DESC, doc_id) AS rank FROM c) SELECT qid, count(*) FILTER (rank < old_rank) AS promoted, count(*) FILTER (rank > old_rank) AS demoted, round(avg(abs(rank - old_rank)), 6) AS mean_move FROM b GROUP BY qid",
    "diversity_filter": f"{_RERANK} SELECT qid, doc_id, rank FROM c QUALIFY rank <= 3 OR row_number() OVER (PARTITION BY qid, substr(text, 1, 200) ORDER BY rank) = 1",
    "quality_threshold": f"{_RERANK} SELECT qid, doc_id, score, rank FROM c QUALIFY rank <= 3 OR score >= greatest(0.6::DOUBLE * max(score) OVER (PARTITION BY qid), 0.3::DOUBLE)",
    "jaccard_pairs": f"{_RERANK}, b AS (SELECT qid, doc_id AS best_id, w AS bw FROM c WHERE rank = 1) SELECT qid, best_id, doc_id, round(len(list_intersect(w, bw)) / len(list_distinct(list_concat(w, bw))), 6) AS resemblance FROM c JOIN b USING (qid) WHERE rank > 1",
    "signals": f"{_SIGNALS} SELECT * FROM sc",
    "signals_normalized": f"{_SIGNALS}, r AS (SELECT *, min(combined) OVER (PARTITION BY qid) AS lo, max(combined) OVER (PARTITION BY qid) AS hi FROM sc) SELECT qid, doc_id, round(CASE WHEN hi = lo THEN CASE WHEN combined > 0 THEN 1.0 ELSE 0.0 END ELSE (combined - lo) / (hi - lo) END, 6) AS combined_norm FROM r",
    "signal_statistics": " UNION ALL ".join(
        f"SELECT * FROM ({_SIGNALS} SELECT '{c}' AS signal, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS sd FROM sc)" for c in ("text_overlap", "length_penalty", "bm25", "combined")
    ),
    "signal_corr": f"{_SIGNALS} SELECT round(corr(text_overlap, length_penalty), 6) AS overlap_length, round(corr(text_overlap, bm25), 6) AS overlap_bm25, round(corr(length_penalty, bm25), 6) AS length_bm25 FROM sc",
    "precision_recall_at_k": f"WITH {_BASE} SELECT qid, round(sum(CASE WHEN rank <= 5 THEN coalesce(quality, 0) ELSE 0 END) / 5, 6) AS p_at_5, sum(coalesce(quality, 0))::BIGINT AS hits_at_10, round(sum(coalesce(quality, 0)) / (SELECT greatest(sum(quality), 1) FROM labels), 6)::DOUBLE AS recall_at_10 FROM {_ranked('bm', 10)} b LEFT JOIN labels USING (doc_id) GROUP BY qid",
}
