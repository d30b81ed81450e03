"""Registered relation, path, signal, evidence, planning-goal and learning queries, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import question_type
from gleaner.jobs.analytics import _CLAIM, _INTENT, _PLANS, _QUERIES, _STAR, _answers, _claims, _events, _predicted, _queries, _star_edges, _t
from gleaner.operators import answers, feedback, insight, planning, relations
from gleaner.sources import index as stored


def _sources(s, d) -> DataFrame:
    """Nodes of the star edges that something leads from and nothing leads to."""
    e = _star_edges(s, d)
    return e.select(F.col("source").alias("node")).distinct().join(e.select(F.col("target").alias("node")).distinct(), "node", "left_anti")


def _fuzzy(s, d):
    names = _t(s, d, "part").select("p_name").distinct()
    return relations.fuzzy(names.select(F.col("p_name").alias("qid"), F.col("p_name").alias("name")), names.select(F.col("p_name").alias("id"), F.col("p_name").alias("label")))


def _freshness(s, d):
    """Events by how fresh they are at the newest one."""
    e = _events(s, d)
    newest = e.agg(F.max("ts").alias("newest"))
    aged = e.join(F.broadcast(newest), F.lit(True)).select("event_id", F.date_diff(F.col("newest"), F.col("ts")).alias("days"))  # newest is one row
    return aged.select("event_id", insight.freshness(F.col("days")).alias("freshness"))


def _cited_texts(s, d):
    """Each benchmark item's whole text with marks of documents, of which some are missing."""
    mark = lambda c: F.concat(F.lit(" ["), c.cast("string"), F.lit("]"))
    i = F.col("item_id")
    return _t(s, d, "benchmark").select(i.alias("answer_id"), F.concat("text", mark(i), F.lit(" and more words."), mark(i * 7), mark(i * 60)).alias("answer"))


def _done(s, d):
    """Feedback on plans: strategy, complexity and a score from the query's length."""
    c = planning.complexity(_queries(s, d))
    return c.select(F.col("intent").alias("strategy"), "complexity", (F.col("n_words") % 5 + 1).cast("double").alias("score"))


_RATING = {"satisfactory": 5, "expand": 3, "clarify": 2, "regenerate": 1}


def _rated_answers(s, d):
    """intent of the question, and a rating from the verdict on its answer."""
    verdict = answers.verdicts(_claims(s, d))
    asked = _t(s, d, "conversations").where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), question_type(F.col("text")).alias("intent"))
    rating = F.create_map(*[x for k, v in _RATING.items() for x in (F.lit(k), F.lit(v))])[F.col("verdict")]
    return verdict.join(asked, ["conv_id", "turn"]).select("intent", "verdict", rating.alias("rating"))


def _validation(s, d):
    """Event values as ratings, and error events as judged bad."""
    rated = feedback.rated(_events(s, d))
    return insight.validation_effect(rated.select((F.col("event_type") != "error").alias("good"), "rating"))


QUERIES = {
    "kg_relations": lambda s, d: relations.typed(_t(s, d, "documents")),
    "graph_paths": lambda s, d: relations.paths(_star_edges(s, d), _sources(s, d)),
    "graph_components": lambda s, d: relations.components(_star_edges(s, d)),
    "graph_totals": lambda s, d: relations.totals(_star_edges(s, d)),
    "pattern_entities": lambda s, d: relations.patterned(_t(s, d, "documents").select(F.col("doc_id").alias("qid"), F.coalesce("text", F.lit("")).alias("query"))),
    "fuzzy_match": _fuzzy,
    "intent_rules": lambda s, d: insight.intents(_queries(s, d)),
    "session_relevance": lambda s, d: insight.session_relevance(_t(s, d, "conversations")),
    "freshness": _freshness,
    "evidence_spans": lambda s, d: insight.spans(*_answers(s, d)),
    "calibration_metrics": lambda s, d: insight.calibration_metrics(_predicted(s, d)),
    "citation_confidence": lambda s, d: insight.citation_confidence(_cited_texts(s, d), _t(s, d, "documents")),
    "plan_optimize_accuracy": lambda s, d: insight.for_accuracy(planning.plans(_queries(s, d))),
    "plan_optimize_resources": lambda s, d: insight.for_resources(planning.plans(_queries(s, d))),
    "plan_optimize_balanced": lambda s, d: insight.balanced(planning.plans(_queries(s, d))),
    "plan_similar_feedback": lambda s, d: insight.similar_performance(_done(s, d)),
    "correction_topics": lambda s, d: insight.correction_topics(_queries(s, d).select(F.col("query").alias("text"))),
    "intent_performance": lambda s, d: insight.intent_performance(_rated_answers(s, d)),
    "validation_effectiveness": _validation,
    "answer_validate": lambda s, d: insight.answer_errors(_answers(s, d)[0]),
    "chunk_items": lambda s, d: insight.item_chunks(_t(s, d, "conversations")),
    "json_profile": lambda s, d: insight.json_profile(_t(s, d, "events"), "props"),
    "index_round_trip": lambda s, d: stored.statistics(s, stored.write_embeddings(_t(s, d, "embeddings"), "vec_id", "embedding")),
    "postings_round_trip": lambda s, d: stored.term_statistics(s, stored.write_postings(_t(s, d, "documents"))),
}


def _sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
_NAMES_NOT = ", ".join(f"'{w}'" for w in relations.NO_NAMES)
_NAME_AT = rf"regexp_full_match(w[i], '\p{{Lu}}\p{{Ll}}+') AND w[i] NOT IN ({_NAMES_NOT})"


def _relation_sql() -> str:
    has = lambda phrases: f"regexp_matches(between_, ' ({'|'.join(phrases)}) ')"
    parts = [
        f"SELECT doc_id, CASE WHEN {has(forth)} THEN x ELSE y END AS source, CASE WHEN {has(forth)} THEN y ELSE x END AS target, '{r}' AS relation FROM met WHERE {has(forth)} OR {has(back)}"
        for r, forth, back in relations.RELATIONS
    ]
    return rf"""WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '[.!?\n]+')) AS s FROM documents),
ws AS (SELECT doc_id, regexp_extract_all(s, '\p{{L}}+') AS w FROM s),
nm AS (SELECT doc_id, w, list_filter(range(1, len(w) + 1), lambda i: {_NAME_AT}) AS spots FROM ws),
pr AS (SELECT doc_id, w, unnest(spots[1:len(spots) - 1]) AS a, unnest(spots[2:]) AS b FROM nm WHERE len(spots) > 1),
met AS (SELECT doc_id, lower(w[a]) AS x, lower(w[b]) AS y, ' ' || lower(array_to_string(w[a + 1:b - 1], ' ')) || ' ' AS between_ FROM pr WHERE lower(w[a]) <> lower(w[b])),
f AS ({" UNION ALL ".join(parts)})
SELECT source, target, relation, count(*) AS n, min(doc_id) AS first_doc FROM f GROUP BY ALL"""


def _topic_sql(words: str) -> str:
    return "CASE " + " ".join(f"WHEN list_has_any({words}, {_sql_list(terms)}) THEN '{t}'" for t, terms in insight.TOPICS) + " ELSE 'general' END"


def _intent_sql() -> str:
    hits = [f"len(list_intersect(w, {_sql_list(terms)}))" for _, terms in insight.INTENTS]
    rows = ", ".join(f"{{'h': {h}, 'k': {-k}, 'i': '{name}'}}" for k, (h, (name, _)) in enumerate(zip(hits, insight.INTENTS)))
    return rf"""WITH {_QUERIES}, a AS (SELECT qid, {_WORDS.format("query")} AS w FROM q),
c AS (SELECT qid, list_max([{rows}]) AS best, {" + ".join(hits)} AS al FROM a)
SELECT qid, CASE WHEN al = 0 THEN 'general' ELSE best.i END AS intent, best.h::BIGINT AS hits, round(CASE WHEN al = 0 THEN 0 ELSE best.h / al END, 6)::DOUBLE AS share FROM c"""


_SHARE = "CASE WHEN {a} IS NULL THEN 0 WHEN len({a}) = 0 THEN 0 ELSE 0.2::DOUBLE * (len(list_intersect({a}, w)) / len(list_distinct({a}))) END"
_PATTERN_ROWS = " UNION ALL ".join(rf"SELECT qid, trim(regexp_replace(unnest(regexp_extract_all(query, '(?i){p}')), '\s+', ' ', 'g'), ' ') AS entity, {k} AS k, '{t}' AS type FROM q" for k, (t, p) in enumerate(relations.PATTERNS))
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(lower(key), '{'|'.join(parts)}') THEN '{g}'" for g, parts in insight.KEY_GROUPS) + " ELSE 'other' END"
_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"

ORACLE = {
    "kg_relations": _relation_sql(),
    "graph_paths": f"""WITH RECURSIVE {_STAR}, seeds AS (SELECT DISTINCT source AS node FROM e WHERE source NOT IN (SELECT target FROM e)),
p(seed, node, hops, path, relations) AS (SELECT node, node, 0, node, '' FROM seeds
  UNION ALL SELECT seed, e.target, hops + 1, path || '>' || e.target, CASE WHEN relations = '' THEN relation ELSE relations || '>' || relation END FROM p JOIN e ON p.node = e.source WHERE hops < 3)
SELECT seed, node, hops, path, relations FROM p WHERE hops > 0 QUALIFY row_number() OVER (PARTITION BY seed, node ORDER BY hops, path, relations) = 1""",
    "graph_components": f"WITH RECURSIVE {_STAR}, r(node, reached) AS (SELECT DISTINCT source, source FROM b UNION SELECT r.node, b.target FROM r JOIN b ON r.reached = b.source) SELECT node, min(reached) AS component FROM r GROUP BY node",
    "graph_totals": f"""WITH RECURSIVE {_STAR}, r(node, reached) AS (SELECT DISTINCT source, source FROM b UNION SELECT r.node, b.target FROM r JOIN b ON r.reached = b.source),
c AS (SELECT node, min(reached) AS component FROM r GROUP BY node), k AS (SELECT component, count(*) AS n FROM c GROUP BY component)
SELECT sum(n)::BIGINT AS n_nodes, (SELECT count(*) FROM e) AS n_edges, round(2 * (SELECT count(*) FROM e) / sum(n), 6) AS mean_degree, count(*) AS n_components, max(n) AS largest FROM k""",
    "pattern_entities": f"WITH q AS (SELECT doc_id AS qid, coalesce(text, '') AS query FROM documents), x AS ({_PATTERN_ROWS}) SELECT qid, entity, max_by(type, k) AS type FROM x GROUP BY ALL",
    "fuzzy_match": rf"""WITH n AS (SELECT DISTINCT p_name FROM part), w AS (SELECT p_name, len(ws) AS size, unnest(ws) AS word FROM (SELECT p_name, list_distinct({_WORDS.format("p_name")}) AS ws FROM n)),
m AS (SELECT a.p_name AS qid, b.p_name AS id, round(count(*) / greatest(any_value(a.size), any_value(b.size)), 6) AS score FROM w a JOIN w b USING (word) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM m QUALIFY rank <= 5""",
    "intent_rules": _intent_sql(),
    "session_relevance": f"""WITH o AS (SELECT conv_id, turn, {_TOKENS} AS w FROM conversations WHERE role = 'user'),
l AS (SELECT *, lag(w) OVER x AS b1, lag(w, 2) OVER x AS b2, lag(w, 3) OVER x AS b3 FROM o WINDOW x AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, {_topic_sql("w")} AS topic,
  round(least(1.0::DOUBLE, {" + ".join(_SHARE.format(a=a) for a in ("b1", "b2", "b3"))} + CASE WHEN b1 IS NOT NULL AND {_topic_sql("b1")} = {_topic_sql("w")} THEN 0.3::DOUBLE ELSE 0 END), 6) AS relevance FROM l""",
    "freshness": "SELECT event_id, CASE WHEN d <= 1 THEN 1.0 WHEN d <= 7 THEN 0.9 WHEN d <= 30 THEN 0.8 WHEN d <= 90 THEN 0.6 ELSE 0.4 END::DOUBLE AS freshness FROM (SELECT event_id, date_diff('day', ts, (SELECT max(ts) FROM events)) AS d FROM events)",
    "evidence_spans": rf"""WITH s AS (SELECT conv_id, turn + 1 AS turn, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(x, ' ')), lambda x: length(x) > 10) AS x FROM conversations WHERE role = 'user'),
c AS (SELECT conv_id, turn, unnest(range(len(x)))::INT AS pos, unnest(x) AS span FROM s),
m AS (SELECT conv_id, turn, pos, {_WORDS.format("span")} AS sw, {_WORDS.format("a.text")} AS aw FROM c JOIN conversations a USING (conv_id, turn) WHERE a.role = 'assistant'),
k AS (SELECT conv_id, turn, pos, round(CASE WHEN len(sw) = 0 THEN 0 ELSE len(list_intersect(sw, aw)) / len(list_distinct(sw)) END, 6)::DOUBLE AS score FROM m)
SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, pos) AS rank FROM k WHERE score > 0.3 QUALIFY rank <= 5""",
    "calibration_metrics": r"""WITH pr AS (SELECT round(length(regexp_replace(text, '[^\p{L}]', '', 'g')) / greatest(length(text), 1), 6) AS p, quality::DOUBLE AS y FROM documents JOIN labels USING (doc_id))
SELECT count(*) AS n, round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(corr(p, y), 6) AS pearson FROM pr""",
    "citation_confidence": r"""WITH a AS (SELECT item_id AS answer_id, text || ' [' || item_id || '] and more words. [' || item_id * 7 || '] [' || item_id * 60 || ']' AS answer FROM benchmark),
b AS (SELECT answer_id, regexp_extract_all(answer, '\[([A-Za-z0-9_-]+)\]', 1) AS marks, list_filter(regexp_split_to_array(answer, '[.!?]+'), lambda s: length(trim(s, ' ')) > 5) AS ss FROM a),
v AS (SELECT answer_id, count(*) AS valid FROM (SELECT answer_id, unnest(marks) AS mark FROM b) WHERE mark IN (SELECT doc_id::VARCHAR FROM documents) GROUP BY answer_id),
k AS (SELECT answer_id, len(marks)::BIGINT AS n_cited, round(CASE WHEN len(ss) = 0 THEN 0 ELSE len(list_filter(ss, lambda s: regexp_matches(s, '\[[A-Za-z0-9_-]+\]'))) / len(ss) END, 6)::DOUBLE AS coverage,
  round(CASE WHEN len(marks) = 0 THEN 0 ELSE coalesce(valid, 0) / len(marks) END, 6)::DOUBLE AS accuracy,
  round(greatest(0.0::DOUBLE, 1 - abs(CASE WHEN len(ss) = 0 THEN 0 ELSE len(marks) / len(ss) END - 0.3::DOUBLE) / 0.3::DOUBLE), 6) AS density FROM b LEFT JOIN v USING (answer_id))
SELECT *, round((0.3::DOUBLE * coverage + 0.3::DOUBLE * accuracy + 0.15::DOUBLE * density) / 0.75::DOUBLE, 6) AS confidence FROM k""",
    "plan_optimize_accuracy": f"""{_PLANS} SELECT qid, least(floor(dense_k * 1.5), 200)::BIGINT AS dense_k, least(floor(bm25_k * 1.5), 200)::BIGINT AS bm25_k, least(floor(graph_k * 1.5), 200)::BIGINT AS graph_k,
  CASE WHEN hops > 0 THEN least(hops + 1, 3) ELSE 0 END AS hops, true AS rerank FROM p""",
    # the graph retriever is the dearest, so only it is left out
    "plan_optimize_resources": f"""{_PLANS}, t AS (SELECT *, dense_k + bm25_k AS total FROM p)
SELECT qid, CASE WHEN dense_k = 0 THEN 0 WHEN total > 200 THEN greatest(10, floor(dense_k * 200 / total)) ELSE dense_k END::BIGINT AS dense_k,
  CASE WHEN bm25_k = 0 THEN 0 WHEN total > 200 THEN greatest(10, floor(bm25_k * 200 / total)) ELSE bm25_k END::BIGINT AS bm25_k, 0::BIGINT AS graph_k, least(hops, 1) AS hops, total <= 100 AS rerank FROM t""",
    "plan_optimize_balanced": f"""{_PLANS}, t AS (SELECT *, 300 // ((dense_k > 0)::INT + (bm25_k > 0)::INT + (graph_k > 0)::INT) AS part FROM p)
SELECT qid, floor((dense_k + part) / 2)::BIGINT AS dense_k, floor((bm25_k + part) / 2)::BIGINT AS bm25_k, CASE WHEN graph_k > 0 THEN floor((graph_k + part) / 2) ELSE 0 END::BIGINT AS graph_k, least(hops, 2) AS hops, true AS rerank FROM t""",
    "plan_similar_feedback": f"""{_PLANS.split(", k AS (")[0]}, dn AS (SELECT intent AS strategy, round(complexity * 1000)::BIGINT AS m, (n_words % 5 + 1)::DOUBLE AS score FROM c),
g AS (SELECT DISTINCT strategy, m FROM dn)
SELECT strategy, g.m / 1000 AS complexity, count(*) AS n_similar, round(avg(score), 6) AS mean_score FROM g JOIN dn USING (strategy) WHERE dn.m BETWEEN g.m - 50 AND g.m + 50 GROUP BY strategy, g.m""",
    "correction_topics": f"WITH x AS (SELECT unnest({_TOKENS}) AS w FROM conversations WHERE role = 'user'), t AS (SELECT CASE " + " ".join(f"WHEN w IN ({', '.join(repr(x) for x in words)}) THEN '{t}'" for t, words in insight.CORRECTIONS) + " END AS topic FROM x) SELECT topic, count(*) AS n FROM t WHERE topic IS NOT NULL GROUP BY topic",
    "intent_performance": f"""{_CLAIM}, vd AS (SELECT conv_id, turn, CASE WHEN avg((label = 'contradicted')::INT) > 0.2 THEN 1 WHEN avg((label = 'entailed')::INT) >= 0.7 THEN 5 WHEN avg((label = 'neutral')::INT) > 0.5 THEN 3 ELSE 2 END AS rating FROM l GROUP BY ALL),
aq AS (SELECT conv_id, turn + 1 AS turn, {_INTENT.replace("query", "text")} AS intent FROM conversations WHERE role = 'user')
SELECT intent, count(*) AS n, round(avg(rating), 6) AS mean_rating, round(avg((rating <= 2)::INT), 6) AS negative_share, avg(rating) < 3 OR avg((rating <= 2)::INT) > 0.4 AS alarm FROM vd JOIN aq USING (conv_id, turn) GROUP BY intent HAVING count(*) >= 3""",
    "validation_effectiveness": "WITH r AS (SELECT event_type <> 'error' AS good, greatest(1, least(5, floor(value / 20)::INT + 1)) AS rating FROM events) SELECT count(*) AS n, count(*) FILTER (good AND rating <= 2) AS n_lenient, count(*) FILTER (NOT good AND rating >= 4) AS n_strict FROM r",
    "answer_validate": rf"""WITH a AS (SELECT conv_id, turn, coalesce(text, '') AS t, {_TOKENS} AS w FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN length(trim(t, ' ')) = 0 THEN 'empty' END, CASE WHEN length(t) < 50 THEN 'short' END, CASE WHEN length(t) > 5000 THEN 'long' END,
  CASE WHEN NOT regexp_matches(trim(t, ' '), '[.!?]$') THEN 'no_end' END, CASE WHEN len(w) >= 10 AND len(list_distinct(w)) * 2 < len(w) THEN 'repeats' END], lambda x: x IS NOT NULL), ',') AS errors FROM a""",
    "chunk_items": """WITH RECURSIVE o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, length(coalesce(text, '')) // 4 AS size FROM conversations),
r(conv_id, k, chunk, held, size) AS (SELECT conv_id, k, 0, size, size FROM o WHERE k = 1
  UNION ALL SELECT o.conv_id, o.k, CASE WHEN r.held + o.size > 512 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.held + o.size > 512 THEN o.size ELSE r.held + o.size END, o.size FROM r JOIN o ON o.conv_id = r.conv_id AND o.k = r.k + 1)
SELECT conv_id, chunk, count(*) AS n_items, sum(size)::BIGINT AS tokens FROM r GROUP BY ALL""",
    "json_profile": rf"""WITH k AS (SELECT unnest(json_keys(props)) AS key, props FROM events), v AS (SELECT key, json_extract_string(props, '$.' || key) AS value FROM k)
SELECT key, {_KIND} AS "group", CASE WHEN bool_and(regexp_matches(value, '^-?[0-9]+(\.[0-9]+)?$')) THEN 'number' ELSE 'text' END AS kind, count(*) AS n, count(DISTINCT value) AS n_distinct FROM v GROUP BY key""",
    "index_round_trip": "SELECT count(*) AS n_vectors, count(DISTINCT len(embedding)) AS n_dimensions, max(len(embedding)) AS dimension FROM embeddings WHERE embedding IS NOT NULL",
    "postings_round_trip": rf"""WITH e AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM e GROUP BY term""",
}
