"""Registered queries on cached questions, schemas of JSON and constrained plans, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import tokens
from gleaner.jobs import retrieval
from gleaner.operators import cache, dense, evidence, fusion, insight, json_schema, planning, sparse


def _t(s, d, name) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _similar(s, d):
    return cache.similar_questions(_t(s, d, "conversations").where("role = 'user'").select(F.col("conv_id").alias("session"), "turn", "text"))


def _schema(s, rows: DataFrame, column: str) -> DataFrame:
    return json_schema.schema(json_schema.counts(json_schema.walk(rows, column)))


def _nested(s, d):
    """Documents as JSON: their fields, an object, and an array with an object for each line."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.struct(F.length(x).alias("n"), (F.length(x) > 80).alias("long")))
    rows = _t(s, d, "documents").select(F.struct("doc_id", "lang", F.struct("source", (F.col("n_chars") / 2).alias("half")).alias("meta"), lines.alias("lines")).alias("x"))
    return _schema(s, rows.select(F.to_json("x", {"ignoreNullFields": "false"}).alias("j")), "j")


def _boosted(s, d):
    """BM25's best documents for each benchmark item, lifted by names they share with the item and by the item's topic."""
    named = lambda c: F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\p{Lu}\p{L}+"), F.lit(0)))
    best = retrieval._best(s, d, 20).drop("rank").join(_t(s, d, "documents").select("doc_id", named(F.col("text")).alias("entities"), insight.topic(tokens(F.col("text"))).alias("topic")), "doc_id")
    context = _t(s, d, "benchmark").select(F.col("item_id").alias("qid"), named(F.col("text")).alias("c_entities"), insight.topic(tokens(F.col("text"))).alias("c_topic"))
    return cache.lifted(best, context)


def _six(s, d):
    """BM25's best documents for each benchmark item; the items of the ids before it are its session. A text's vector is the one of its id."""
    named = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\p{Lu}\p{L}+"), F.lit(0)), lambda x: F.lower(x)))
    # words and names are taken once a text, before candidates meet
    of = lambda rows, key, x: rows.select(F.col(key), F.array_distinct(tokens(F.col("text"))).alias(f"{x}_words"), named(F.col("text")).alias(f"{x}_entities"), insight.topic(tokens(F.col("text"))).alias(f"{x}_topic"))
    items = of(_t(s, d, "benchmark").select(F.col("item_id").alias("qid"), "text"), "qid", "q")
    back = items.select(F.explode(F.array(*[F.lit(n) for n in range(1, cache.QUESTIONS + 1)])).alias("back"), "qid", F.struct("q_words", "q_entities", "q_topic").alias("x"))
    before = back.groupBy((F.col("qid") + F.col("back")).alias("qid")).agg(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("o"), "x"))).alias("p"))  # QUESTIONS items each
    session = before.select("qid", F.array_distinct(F.flatten("p.x.q_entities")).alias("s_entities"), F.element_at("p", -1)["x"]["q_topic"].alias("s_topic"), F.col("p.x.q_words").alias("s_questions"))
    asked = items.join(session, "qid", "left")
    vector = retrieval.vectors(s, d)
    best = retrieval._best(s, d, 20).select("qid", "doc_id", "score").join(vector.select("doc_id", F.col("v").alias("dv")), "doc_id", "left").join(vector.select(F.col("doc_id").alias("qid"), F.col("v").alias("qv")), "qid", "left")
    near = best.select("qid", "doc_id", "score", F.round(1 / (1 + dense.squared_distance(F.col("dv"), F.col("qv"))), 6).alias("dense"))
    return cache.six_signals(near.join(of(_t(s, d, "documents").select("doc_id", "text"), "doc_id", "d"), "doc_id").join(asked, "qid"))


def _spans(s, d):
    """Of each benchmark item's three best documents, what speaks for the best one's text as an answer to the item."""
    best = retrieval._best(s, d, 3).select("qid", "doc_id", "rank").join(_t(s, d, "documents").select("doc_id", "text"), "doc_id")
    answer = best.where("rank = 1").select("qid", F.col("text").alias("answer"))
    asked = _t(s, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return evidence.merged_spans(best.join(answer, "qid").join(asked, "qid").select("qid", "doc_id", F.col("text").alias("evidence"), "answer", "query"), "qid", "doc_id")


#: Limits of the plans below: seconds, results of a retriever.
SECONDS, MOST_K = 4.0, 120


def _benchmark_plans(s, d):
    return planning.plans(retrieval.benchmark_queries(s, d))


def _planned(s, d):
    """Retrieval by each benchmark item's own plan, shrunk until it fits the limits: as many results of each retriever as it says, fused by reciprocal ranks."""
    chosen = planning.constrained(_benchmark_plans(s, d), SECONDS, MOST_K)
    found = retrieval.candidates(s, d, MOST_K)
    k = F.when(F.col("retriever") == "bm25", F.col("bm25_k")).when(F.col("retriever") == "dense", F.col("dense_k")).otherwise(F.col("graph_k"))
    kept = found.where("retriever <> 'coverage'").join(chosen.select("qid", "bm25_k", "dense_k", "graph_k"), "qid").where(F.col("rank") <= k).select("qid", "retriever", "doc_id", "score", "rank")
    return sparse.top(fusion.fuse(kept, "rrf"), 10)


QUERIES = {
    "similar_question": _similar,
    "context_boost": _boosted,
    "signals_six": _six,
    "evidence_spans_merged": _spans,
    "json_schema": lambda s, d: _schema(s, _t(s, d, "events"), "props"),
    "json_schema_nested": _nested,
    "plan_constrained": lambda s, d: planning.constrained(_benchmark_plans(s, d), SECONDS, MOST_K),
    "hybrid_planned": _planned,
}

_TOKENS = retrieval.TOKENS


def _schema_sql(rows: str) -> str:
    kinds = {"null": "'NULL'", "boolean": "'BOOLEAN'", "integer": "'BIGINT', 'UBIGINT'", "number": "'DOUBLE'", "string": "'VARCHAR'", "array": "'ARRAY'", "object": "'OBJECT'"}
    case = "CASE " + " ".join(f"WHEN type IN ({v}) THEN '{k}'" for k, v in kinds.items()) + " END"
    shown = ", ".join(f"CASE WHEN count(*) FILTER (kind = '{k}') > 0 THEN '{k}:' || count(*) FILTER (kind = '{k}') END" for k in kinds)
    return rf"""WITH j AS ({rows}), v AS (SELECT regexp_replace(regexp_replace(fullkey, '\[[0-9]+\]', '[]', 'g'), '"', '', 'g') AS path, {case} AS kind, atom FROM j, json_tree(j.j)),
c AS (SELECT path, count(*) AS n, count(*) FILTER (kind = 'null') AS nulls, count(DISTINCT CASE kind WHEN 'integer' THEN 'number' ELSE kind END) FILTER (kind <> 'null') AS several,
  max(CASE kind WHEN 'integer' THEN 'a' WHEN 'number' THEN 'b' END) AS num, any_value(kind) FILTER (kind <> 'null') AS one,
  array_to_string(list_filter([{shown}], lambda x: x IS NOT NULL), ',') AS kinds, avg(length(atom ->> '$')) FILTER (kind = 'string') AS mean_length,
  min(CASE WHEN kind IN ('integer', 'number') THEN atom::VARCHAR::DOUBLE END) AS least, max(CASE WHEN kind IN ('integer', 'number') THEN atom::VARCHAR::DOUBLE END) AS most FROM v GROUP BY path)
SELECT path, CASE WHEN several > 1 THEN 'mixed' WHEN num = 'b' THEN 'number' WHEN num = 'a' THEN 'integer' ELSE coalesce(one, 'null') END AS type, n, round(nulls / n, 6) AS null_share, kinds, round(mean_length, 6) AS mean_length, least, most FROM c"""


def _topic(words: str) -> str:
    return "CASE " + " ".join("WHEN list_has_any({}, [{}]) THEN '{}'".format(words, ", ".join(f"'{w}'" for w in terms), t) for t, terms in insight.TOPICS) + " ELSE 'general' END"


_NAMED = r"list_distinct(regexp_extract_all(coalesce(text, ''), '\p{Lu}\p{L}+'))"
_LOWER_NAMED = r"list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '\p{Lu}\p{L}+'), lambda x: lower(x)))"
_COST = " + ".join(f"{n}_k / 100 * (2 / {p[0]}::DOUBLE)" for n, p in planning.PROFILES.items())
_SECONDS = f"round(({_COST} + CASE WHEN rerank THEN (dense_k + bm25_k + graph_k) / 200 ELSE 0 END) * (1 + 0.5::DOUBLE * hops), 6)"
_USED = "((dense_k > 0)::INT + (bm25_k > 0)::INT + (graph_k > 0)::INT)"


def _counted(text: str) -> str:
    """Distinct words of a text that count."""
    words = _TOKENS.replace("coalesce(text, '')", f"coalesce({text}, '')")
    return "list_filter(list_distinct({}), lambda y: y NOT IN ({}))".format(words, ", ".join(f"'{w}'" for w in evidence.STOPS))


def _shrunk(c: str, dropped: str) -> str:
    return f"CASE WHEN {dropped} THEN 0 WHEN {c} > 10 THEN greatest(10, floor({c} * 0.8::DOUBLE)) ELSE {c} END::BIGINT"


def _plans_sql() -> str:
    """Benchmark items' plans, and the rounds that shrink them."""
    from gleaner.jobs.analytics import _PLANS, _QUERIES

    plans = _PLANS.replace(_QUERIES, r"q AS (SELECT item_id AS qid, array_to_string(" + _TOKENS + r", ' ') AS query FROM benchmark)", 1).replace("WITH ", "WITH RECURSIVE ", 1)
    order = sorted(planning.PROFILES, key=lambda n: planning.PROFILES[n][0])  # the slowest first
    drop = {n: f"({_USED} > 1 AND {n}_k > 0" + "".join(f" AND {m}_k = 0" for m in order[:i]) + ")" for i, n in enumerate(order)}
    k = ", ".join(f"{_shrunk(f'{n}_k', drop[n])} AS {n}_k" for n in ("dense", "bm25", "graph"))
    return f"""{plans},
first AS (SELECT qid, dense_k, bm25_k, graph_k, hops, true AS rerank FROM (SELECT qid, {", ".join(f"least({n}_k, {MOST_K})::BIGINT AS {n}_k" for n in ("dense", "bm25", "graph"))}, hops::BIGINT AS hops FROM p)),
r AS (SELECT 0 AS i, * FROM first UNION ALL
  SELECT i + 1, qid, {k}, greatest(hops - 1, 0), false FROM r WHERE {_SECONDS} > {SECONDS} AND greatest(dense_k, bm25_k, graph_k) > 10 AND i < {planning.ROUNDS}),
pc AS (SELECT qid, dense_k, bm25_k, graph_k, hops, rerank, {_SECONDS} AS seconds, i::BIGINT AS rounds, {_SECONDS} <= {SECONDS} AS fits FROM r QUALIFY row_number() OVER (PARTITION BY qid ORDER BY i DESC) = 1)"""


ORACLE = {
    "similar_question": f"""WITH q AS (SELECT conv_id AS session, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, {_TOKENS} AS w FROM conversations WHERE role = 'user'),
tf AS (SELECT session, place, term, count(*) AS tf FROM (SELECT session, place, unnest(w) AS term FROM q) GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*)::DOUBLE FROM q)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
x AS (SELECT session, place, term, tf * idf AS w FROM tf JOIN idf USING (term)), nr AS (SELECT session, place, sqrt(sum(w * w)) AS norm FROM x GROUP BY ALL),
dt AS (SELECT a.session, a.place, b.place AS earlier, sum(a.w * b.w) AS dot FROM x a JOIN x b ON a.session = b.session AND a.term = b.term AND b.place BETWEEN a.place - {cache.LAST} AND a.place - 1 GROUP BY ALL),
cs AS (SELECT dt.session, dt.place, earlier, round(dot / (n1.norm * n2.norm), 6) AS similarity FROM dt JOIN nr n1 ON n1.session = dt.session AND n1.place = dt.place JOIN nr n2 ON n2.session = dt.session AND n2.place = earlier),
bs AS (SELECT session, place, max({{'s': similarity, 'e': earlier}}) AS b FROM cs GROUP BY ALL)
SELECT q.session, q.turn, e.turn AS before, b.s AS similarity, coalesce(b.s >= {cache.SIMILAR}, false) AS hit FROM q LEFT JOIN bs ON bs.session = q.session AND bs.place = q.place LEFT JOIN q e ON e.session = q.session AND e.place = b.e""",
    "context_boost": f"""WITH {retrieval._BASE}, dd AS (SELECT doc_id, {_NAMED} AS en, {_topic(_TOKENS)} AS topic FROM documents), cc AS (SELECT item_id AS qid, {_NAMED} AS en, {_topic(_TOKENS)} AS topic FROM benchmark),
l AS (SELECT b.qid, b.doc_id, score, round(score + {cache.PER_ENTITY}::DOUBLE * len(list_intersect(dd.en, cc.en)) + CASE WHEN dd.topic = cc.topic THEN {cache.SAME_TOPIC}::DOUBLE ELSE 0 END, 6) AS lifted FROM {retrieval._ranked("bm", 20)} b JOIN dd USING (doc_id) JOIN cc ON cc.qid = b.qid)
SELECT *, row_number() OVER (PARTITION BY qid ORDER BY lifted DESC, doc_id) AS rank FROM l""",
    "signals_six": rf"""WITH {retrieval._BASE}, dd AS (SELECT doc_id, list_distinct({_TOKENS}) AS w, {_LOWER_NAMED} AS e, {_topic(_TOKENS)} AS t FROM documents), ii AS (SELECT item_id AS qid, list_distinct({_TOKENS}) AS w, {_LOWER_NAMED} AS e, {_topic(_TOKENS)} AS t FROM benchmark),
se AS (SELECT *, list_distinct(flatten(list(e) OVER x)) AS s_e, last_value(t) OVER x AS s_t, list(w) OVER x AS s_q FROM ii WINDOW x AS (ORDER BY qid RANGE BETWEEN {cache.QUESTIONS} PRECEDING AND 1 PRECEDING)),
c AS (SELECT b.qid, b.doc_id, b.score, {retrieval._D2} AS d2, dd.w, dd.e, dd.t, se.w AS qw, se.e AS qe, se.t AS qt, s_e, s_t, s_q FROM {retrieval._ranked("bm", 20)} b JOIN dd USING (doc_id) JOIN se ON se.qid = b.qid LEFT JOIN embeddings v ON v.vec_id = b.doc_id LEFT JOIN embeddings q ON q.vec_id = b.qid),
g AS (SELECT qid, doc_id, round(coalesce(round(1 / (1 + d2), 6), 0) + {cache.NUDGE}, 4) AS dense, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, score / {cache.FULL_BM25})) + {cache.NUDGE}, 4) AS bm25,
  round(CASE WHEN greatest(len(e), len(qe)) = 0 THEN 0 ELSE len(list_intersect(e, qe)) / greatest(len(e), len(qe)) END + {cache.NUDGE}, 4)::DOUBLE AS entity_overlap,
  round(least(1.0::DOUBLE, CASE WHEN coalesce(len(s_e), 0) = 0 THEN 0 ELSE {cache.OF_ENTITIES}::DOUBLE * (len(list_intersect(s_e, e)) / len(s_e)) END + CASE WHEN s_t = t THEN {cache.OF_TOPIC}::DOUBLE ELSE 0 END
    + CASE WHEN len(qw) = 0 THEN 0 ELSE coalesce(list_sum(list_transform(s_q, lambda z: {cache.OF_QUESTION}::DOUBLE * (len(list_intersect(qw, z)) / len(qw)))), 0) END) + {cache.NUDGE}, 4) AS session_relevance,
  (qt = t)::INT::DOUBLE AS cluster_match, round(CASE WHEN len(qw) = 0 THEN 0 ELSE len(list_intersect(qw, w)) / len(qw) END + {cache.NUDGE}, 4)::DOUBLE AS text_overlap FROM c),
k AS (SELECT *, round({" + ".join(f"{v}::DOUBLE * {n}" for n, v in cache.WEIGHTS.items())}, 6) AS combined FROM g)
SELECT *, row_number() OVER (PARTITION BY qid ORDER BY combined DESC, doc_id) AS rank FROM k""",
    "evidence_spans_merged": f"""WITH RECURSIVE {retrieval._BASE}, b AS (SELECT qid, doc_id, rank, text FROM {retrieval._ranked("bm", 3)} JOIN documents USING (doc_id)),
e AS (SELECT b.qid, b.doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(b.text, ''), '[.!?]+'), lambda x: trim(x, ' ')), lambda x: length(x) > {evidence.SENTENCE}) AS s,
  {_counted("a.text")} AS a, {_counted("i.text")} AS q FROM b JOIN b a ON a.qid = b.qid AND a.rank = 1 JOIN benchmark i ON i.item_id = b.qid),
l AS (SELECT qid, doc_id, s, unnest(range(len(s))) AS spot, a, q, unnest(list_transform(s, lambda x: {_counted("x")})) AS w FROM e),
x AS (SELECT qid, doc_id, s, spot, CASE WHEN len(w) = 0 THEN 0 ELSE round({evidence.OF_ANSWER}::DOUBLE * (len(list_intersect(w, a)) / len(w)) + {evidence.OF_QUERY}::DOUBLE * (len(list_intersect(w, q)) / len(w)), 6) END AS score FROM l),
g AS (SELECT qid, doc_id, any_value(s) AS s, list(score ORDER BY spot) AS sc, (list({{'l': -score, 'spot': spot}} ORDER BY score DESC, spot) FILTER (score > {evidence.MAKES}))[:{evidence.MOST}] AS seeds FROM x GROUP BY ALL),
z AS (SELECT qid, doc_id, s, sc, seeds, 0 AS i, []::BIGINT[] AS used, []::STRUCT(lo BIGINT, hi BIGINT, sc DOUBLE)[] AS spans FROM g WHERE len(seeds) > 0
  UNION ALL SELECT qid, doc_id, s, sc, seeds, i, CASE WHEN ok THEN used || range(lo, hi + 1) ELSE used END, CASE WHEN ok THEN spans || [{{'lo': lo, 'hi': hi, 'sc': -seeds[i].l}}] ELSE spans END
  FROM (SELECT *, NOT list_contains(used, spot) AND length(array_to_string(s[lo + 1:hi + 1], ' ')) BETWEEN {evidence.SPAN[0]} AND {evidence.SPAN[1]} AS ok FROM (
    SELECT qid, doc_id, s, sc, seeds, i + 1 AS i, used, spans, seeds[i + 1].spot AS spot,
      CASE WHEN spot > 0 AND sc[spot] > {evidence.EXTENDS} AND NOT list_contains(used, spot - 1) THEN spot - 1 ELSE spot END AS lo, CASE WHEN spot + 1 < len(s) AND sc[spot + 2] > {evidence.EXTENDS} AND NOT list_contains(used, spot + 1) THEN spot + 1 ELSE spot END AS hi
    FROM z WHERE i < len(seeds)))),
o AS (SELECT qid, doc_id, unnest(range(len(spans))) AS place, unnest(spans) AS p FROM z WHERE i = len(seeds))
SELECT qid, doc_id, place::INT AS place, p.lo::INT AS low, p.hi::INT AS high, p.sc AS score FROM o""",
    "json_schema": _schema_sql("SELECT props AS j FROM events"),
    "json_schema_nested": _schema_sql("SELECT to_json({'doc_id': doc_id, 'lang': lang, 'meta': {'source': source, 'half': n_chars / 2}, 'lines': list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {'n': length(x), 'long': length(x) > 80})}) AS j FROM documents"),
    "plan_constrained": f"{_plans_sql()} SELECT * FROM pc",
    "hybrid_planned": f"""WITH pc AS ({_plans_sql()} SELECT * FROM pc), {retrieval._CANDIDATES.replace("rank <= 20", f"rank <= {MOST_K}")},
fs AS (SELECT qid, doc_id, round(sum(1 / (60 + rank)), 9) AS score FROM cand JOIN pc USING (qid) WHERE rank <= CASE retriever WHEN 'bm25' THEN bm25_k WHEN 'dense' THEN dense_k ELSE 0 END GROUP BY ALL)
SELECT * FROM {retrieval._ranked("fs", 10)}""",
}
