"""Registered graph, profile, session, planning, answer and feedback queries, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import keywords, normalized, preview, question_type
from gleaner.operators import answers, feedback, graph, planning, profile, sessions
from gleaner.operators.relations import NO_NAMES
from gleaner.streaming import events as streams
from gleaner.streaming import memory


def _t(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _events(spark, d) -> DataFrame:
    return _t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _star_edges(spark, d) -> DataFrame:
    """Regions, nations, customers and suppliers as typed edges."""
    name = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    parts = [("nation", "nation:", "n_nationkey", "region:", "n_regionkey", "IN_REGION"), ("customer", "customer:", "c_custkey", "nation:", "c_nationkey", "IN_NATION"), ("supplier", "supplier:", "s_suppkey", "nation:", "s_nationkey", "SUPPLIES_FROM")]
    out = None
    for table, a, ak, b, bk, relation in parts:
        rows = _t(spark, d, table).select(name(a, ak).alias("source"), name(b, bk).alias("target"), F.lit(relation).alias("relation"))
        out = rows if out is None else out.unionAll(rows)
    return out


def _queries(spark, d) -> DataFrame:
    """User turns as queries."""
    turns = _t(spark, d, "conversations").where("role = 'user'")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("text").alias("query"))


def _answers(spark, d) -> tuple[DataFrame, DataFrame]:
    """Assistant turns, and the user turn before each as its evidence."""
    turns = _t(spark, d, "conversations")
    evidence = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("evidence"))
    return turns.where("role = 'assistant'"), evidence


def _predicted(spark, d) -> DataFrame:
    """Share of letters of a text as its predicted quality, against the label."""
    docs = _t(spark, d, "documents").select("doc_id", F.round(F.length(F.regexp_replace("text", r"[^\p{L}]", "")) / F.greatest(F.length("text"), F.lit(1)), 6).alias("p"))
    return docs.join(_t(spark, d, "labels"), "doc_id").select("p", F.col("quality").cast("double").alias("y"))


def _cited(spark, d) -> DataFrame:
    """Each benchmark item's whole text with marks of three documents, of which the last may be missing."""
    mark = lambda c: F.concat(F.lit(" ["), c.cast("string"), F.lit("]"))
    i = F.col("item_id")
    return _t(spark, d, "benchmark").select(i.alias("answer_id"), F.concat("text", mark(i), mark(i), mark(i * 7), mark(i * 60)).alias("answer"))


def _claims(spark, d):
    a, e = _answers(spark, d)
    return answers.supported(answers.claims(a), e)


def _graph_scores(spark, d):
    """Documents by the names within one hop of the two commonest names."""
    named = graph.mentions(_t(spark, d, "documents"))
    start = graph.nodes(named).orderBy(F.desc("occurrences"), "node").limit(2).select("node")
    return graph.document_scores(named, graph.reach(graph.edges(_t(spark, d, "documents")), start, 1))


def _stream_counts(spark, d):
    return streams.drained(streams.counts(streams.stream(spark, d)), "complete")


def _stream_sessions(spark, d):
    closed = streams.drained(streams.sessions(streams.stream(spark, d)), "append")
    return closed.withColumn("session_start", _plain_time("session_start"))


def _plain_time(c: str):
    return F.to_timestamp_ntz(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def _stream_memory(spark, d):
    closed = streams.drained(memory.remembered(streams.stream(spark, d)), "append")
    return closed.withColumns({c: _plain_time(c) for c in ("session_start", "session_end")})


QUERIES = {
    "kg_nodes": lambda s, d: graph.nodes(graph.mentions(_t(s, d, "documents"))),
    "kg_edges": lambda s, d: graph.edges(_t(s, d, "documents")),
    "kg_stats": lambda s, d: graph.degrees(graph.edges(_t(s, d, "documents"))),
    "entity_docs": lambda s, d: graph.mentions(_t(s, d, "documents")).select("node", "doc_id").distinct(),
    "graph_score_docs": _graph_scores,
    "graph_bfs": lambda s, d: graph.reach(_star_edges(s, d), s.createDataFrame([("region:0",)], "node string")),
    "graph_expand": lambda s, d: graph.reach(_star_edges(s, d), s.createDataFrame([("nation:0",), ("nation:1",)], "node string"), 1),
    "graph_relations": lambda s, d: graph.relation_counts(_star_edges(s, d)),
    "profile_numeric": lambda s, d: profile.numeric(_t(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]),
    "profile_text": lambda s, d: profile.texts(_t(s, d, "customer"), ["c_name", "c_mktsegment"]),
    "infer_text_type": lambda s, d: profile.texts(_t(s, d, "pages"), ["url", "html"]),
    "text_structure": lambda s, d: profile.structure(_t(s, d, "documents")),
    "chunk_rows": lambda s, d: profile.row_chunks(_t(s, d, "orders"), "o_orderkey", 100).groupBy("chunk").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key")),
    "chunk_text": lambda s, d: profile.text_chunks(_t(s, d, "documents")),
    "content_preview": lambda s, d: _t(s, d, "documents").select("doc_id", preview(F.col("text")).alias("preview")),
    "normalize_query": lambda s, d: _queries(s, d).select("qid", normalized(F.col("query")).alias("normalized")),
    "question_type": lambda s, d: _queries(s, d).select("qid", question_type(F.col("query")).alias("intent")),
    "keywords": lambda s, d: _queries(s, d).select("qid", F.explode(keywords(F.col("query"))).alias("keyword")),
    "complexity": lambda s, d: planning.complexity(_queries(s, d)).select("qid", "intent", "n_words", "n_names", "complexity", "level"),
    "plan_generate": lambda s, d: planning.plans(_queries(s, d)),
    "plan_cost": lambda s, d: planning.costs(planning.plans(_queries(s, d))),
    "plan_optimize_speed": lambda s, d: planning.for_speed(planning.plans(_queries(s, d))),
    "session_windows": lambda s, d: sessions.windows(_events(s, d)),
    "session_recent_context": lambda s, d: sessions.recent_context(_t(s, d, "conversations")),
    "session_summary": lambda s, d: sessions.summary(_events(s, d)),
    "session_preferences": lambda s, d: sessions.preferences(_events(s, d)),
    "trend_windows": lambda s, d: sessions.trends(_events(s, d)),
    "queries_per_minute": lambda s, d: sessions.rate(_events(s, d)),
    "session_patterns": lambda s, d: sessions.patterns(_t(s, d, "conversations")),
    "cache_exact_hits": lambda s, d: sessions.exact_hits(_t(s, d, "conversations")),
    "cache_ttl_evict": lambda s, d: sessions.live_entries(_events(s, d)),
    "dedupe_results": lambda s, d: sessions.deduplicated(_t(s, d, "documents")),
    "citations_extract": lambda s, d: answers.citations(_cited(s, d)),
    "citation_validate": lambda s, d: answers.validated(answers.citations(_cited(s, d)), _t(s, d, "documents")),
    "calibration": lambda s, d: answers.calibration(_predicted(s, d)),
    "ece": lambda s, d: answers.calibration_error(_predicted(s, d)),
    "claims": lambda s, d: answers.claims(_answers(s, d)[0]),
    "claim_overlap_nli": _claims,
    "confidence_components": lambda s, d: answers.evidence_confidence(_claims(s, d)),
    "verdicts": lambda s, d: answers.verdicts(_claims(s, d)),
    "feedback_summary": lambda s, d: feedback.summary(feedback.rated(_events(s, d))),
    "rating_patterns": lambda s, d: feedback.patterns(feedback.rated(_events(s, d))),
    "rating_histogram": lambda s, d: feedback.histogram(feedback.rated(_events(s, d))),
    "health": lambda s, d: feedback.health(feedback.rated(_events(s, d))),
    "metric_ema": lambda s, d: feedback.ema(feedback.rated(_events(s, d))),
    "stream_feedback_counts": _stream_counts,
    "stream_sessions": _stream_sessions,
    "stream_memory": _stream_memory,
}

_WORD = r"'[\p{L}\p{N}_]+'"
_NO_NAMES = ", ".join(f"'{w}'" for w in NO_NAMES)
_MENTIONS = rf"""WITH m AS (SELECT doc_id, pos, t AS text, lower(t) AS node FROM (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS t FROM
  (SELECT doc_id, list_filter(regexp_extract_all(text, '\p{{L}}+'), lambda x: regexp_full_match(x, '\p{{Lu}}\p{{Ll}}+') AND x NOT IN ({_NO_NAMES})) AS x FROM documents)))"""
_EDGES = f"{_MENTIONS}, e AS (SELECT source, target, count(*) AS weight FROM (SELECT node AS source, lead(node) OVER (PARTITION BY doc_id ORDER BY pos) AS target FROM m) WHERE target IS NOT NULL AND source <> target GROUP BY ALL)"
_STAR = """e AS (SELECT 'nation:' || n_nationkey AS source, 'region:' || n_regionkey AS target, 'IN_REGION' AS relation FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'IN_NATION' FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'SUPPLIES_FROM' FROM supplier),
b AS (SELECT source, target FROM e UNION SELECT target, source FROM e)"""


def _reach(start: str, hops: int) -> str:
    return f"WITH RECURSIVE {_STAR}, r(node, hop) AS (SELECT unnest([{start}]), 0 UNION SELECT b.target, hop + 1 FROM r JOIN b ON r.node = b.source WHERE hop < {hops}) SELECT node, min(hop) AS hop FROM r GROUP BY node"


def _number(c: str) -> str:
    return f"SELECT '{c}' AS name, count(*) FILTER ({c} IS NULL) AS n_null, count(DISTINCT {c}) AS n_distinct, min({c})::DOUBLE AS low, max({c})::DOUBLE AS high, round(avg({c}), 4) AS mean FROM lineitem"


def _textual(c: str, table: str) -> str:
    share = lambda p: f"avg(regexp_matches({c}, '{p}')::INT) > 0.8"
    return f"SELECT '{c}' AS name, count(*) FILTER ({c} IS NULL) AS n_null, count(DISTINCT {c}) AS n_distinct, round(avg(length({c})), 4) AS mean_length, CASE WHEN {share(profile.EMAIL)} THEN 'email' WHEN {share(profile.URL)} THEN 'url' WHEN {share(profile.PHONE)} THEN 'phone' WHEN {share(profile.DATE)} THEN 'date' WHEN avg(length({c})) > 100 THEN 'long' WHEN avg(length({c})) < 20 THEN 'short' ELSE 'medium' END AS kind FROM {table}"


_STOP = "('the','a','an','and','or','of','to','in','on','for','is','was','with','as','by','at','it','that')"
_QUERIES = r"q AS (SELECT conv_id * 1000 + turn AS qid, text AS query FROM conversations WHERE role = 'user')"
_INTENT = "CASE WHEN regexp_matches(lower(trim(query)), 'compare|versus|\\bvs\\b') THEN 'comparison' " + " ".join(f"WHEN starts_with(lower(trim(query)), '{w}') THEN '{w}'" for w in ["who", "what", "where", "when", "why", "how"]) + " ELSE 'general' END"
_COMPLEX = rf"""WITH {_QUERIES}, f AS (SELECT qid, {_INTENT} AS intent, len(regexp_extract_all(lower(query), {_WORD})) AS n_words, len(list_distinct(regexp_extract_all(query, '\p{{Lu}}\p{{L}}{{3,}}'))) AS n_names FROM q),
c AS (SELECT *, round(0.4::DOUBLE * least(n_words / 20, 1.0) + 0.3::DOUBLE * least(n_names / 5, 1.0) + 0.3::DOUBLE * CASE intent {" ".join(f"WHEN '{k}' THEN {v}" for k, v in planning.COMPLEXITY.items())} END::DOUBLE, 6) AS complexity FROM f)"""
_PLANS = f"""{_COMPLEX}, k AS (SELECT *, least(200, CASE WHEN intent IN ('why', 'how', 'comparison') THEN 150 WHEN n_names = 0 THEN 100 WHEN n_names > 3 THEN 75 ELSE 50 END + CASE WHEN n_words > 15 THEN 25 ELSE 0 END) AS k FROM c),
p AS (SELECT qid, k AS dense_k, k AS bm25_k, CASE WHEN n_names >= 2 THEN 75 ELSE 0 END AS graph_k, CASE WHEN intent IN ('why', 'how', 'comparison') THEN 1 ELSE 0 END AS hops FROM k)"""
_RATED = "WITH r AS (SELECT *, greatest(1, least(5, floor(value / 20)::INT + 1)) AS rating FROM events)"
_CITED = r"WITH c AS (SELECT item_id AS answer_id, unnest(list_distinct([item_id, item_id * 7, item_id * 60]))::BIGINT AS cited FROM benchmark)"
_PRED = r"WITH pr AS (SELECT round(length(regexp_replace(text, '[^\p{L}]', '', 'g')) / greatest(length(text), 1), 6) AS p, quality::DOUBLE AS y FROM documents JOIN labels USING (doc_id)), bins AS (SELECT greatest(0, ceil(p * 10) - 1)::BIGINT AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS mean_y, round(abs(avg(p) - avg(y)), 6) AS gap FROM pr GROUP BY 1)"
_CLAIM = rf"""WITH s AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(x)), lambda x: length(x) > 10) AS x FROM conversations WHERE role = 'assistant'),
c AS (SELECT conv_id, turn, unnest(range(len(x)))::INT AS pos, unnest(x) AS claim FROM s),
v AS (SELECT conv_id, turn + 1 AS turn, text AS evidence FROM conversations WHERE role = 'user'),
w AS (SELECT c.conv_id, c.turn, pos, regexp_extract_all(lower(claim), {_WORD}) AS cw, regexp_extract_all(lower(coalesce(evidence, '')), {_WORD}) AS ew FROM c LEFT JOIN v USING (conv_id, turn)),
n AS (SELECT conv_id, turn, pos, round(CASE WHEN len(cw) = 0 THEN 0 ELSE len(list_intersect(cw, ew)) / len(list_distinct(cw)) END, 6) AS share FROM w),
l AS (SELECT *, CASE WHEN share >= 0.3 THEN 'entailed' WHEN share >= 0.1 THEN 'neutral' ELSE 'contradicted' END AS label FROM n)"""
_SEEN = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {} PRECEDING AND {})"

ORACLE = {
    "kg_nodes": f"{_MENTIONS} SELECT node, count(*) AS occurrences, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM m GROUP BY node",
    "kg_edges": f"{_EDGES} SELECT * FROM e",
    "kg_stats": f"{_EDGES} SELECT node, count(*) AS degree FROM (SELECT source AS node FROM e UNION ALL SELECT target FROM e) GROUP BY node ORDER BY degree DESC, node LIMIT 5",
    "entity_docs": f"{_MENTIONS} SELECT DISTINCT node, doc_id FROM m",
    "graph_score_docs": f"""{_EDGES}, st AS (SELECT node FROM m GROUP BY node ORDER BY count(*) DESC, node LIMIT 2), b AS (SELECT source, target FROM e UNION SELECT target, source FROM e),
rr AS (SELECT node, min(hop) AS hop FROM (SELECT node, 0 AS hop FROM st UNION ALL SELECT target, 1 FROM b WHERE source IN (SELECT node FROM st)) GROUP BY node)
SELECT doc_id, count(*) AS n_nodes, round(sum(1 / (1 + hop)), 6) AS score FROM (SELECT DISTINCT node, doc_id FROM m) JOIN rr USING (node) GROUP BY doc_id""",
    "graph_bfs": _reach("'region:0'", 3),
    "graph_expand": _reach("'nation:0', 'nation:1'", 1),
    "graph_relations": f"WITH {_STAR} SELECT node, relation, direction, count(*) AS n FROM (SELECT source AS node, relation, 'out' AS direction FROM e UNION ALL SELECT target, relation, 'in' FROM e) GROUP BY ALL",
    "profile_numeric": " UNION ALL ".join(map(_number, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])),
    "profile_text": " UNION ALL ".join(_textual(c, "customer") for c in ["c_name", "c_mktsegment"]),
    "infer_text_type": " UNION ALL ".join(_textual(c, "pages") for c in ["url", "html"]),
    "text_structure": """WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
SELECT doc_id, len(l)::BIGINT AS n_lines, len(list_filter(l, lambda x: regexp_matches(x, '^ *[-*] ')))::BIGINT AS n_bullets, len(list_filter(l, lambda x: regexp_matches(x, '^ *[0-9]+\\. ')))::BIGINT AS n_numbered,
len(list_filter(range(len(l)), lambda i: length(trim(l[i + 1], ' ')) > 0 AND (i = 0 OR length(trim(l[i], ' ')) = 0)))::BIGINT AS n_paragraphs FROM s""",
    "chunk_rows": "SELECT chunk, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS chunk FROM orders) GROUP BY chunk",
    "content_preview": "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM documents",
    "normalize_query": rf"WITH {_QUERIES} SELECT qid, trim(regexp_replace(lower(query), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), ' ') AS normalized FROM q",
    "question_type": f"WITH {_QUERIES} SELECT qid, {_INTENT} AS intent FROM q",
    "keywords": f"WITH {_QUERIES} SELECT DISTINCT qid, keyword FROM (SELECT qid, unnest(regexp_extract_all(lower(query), {_WORD})) AS keyword FROM q) WHERE length(keyword) > 3 AND keyword NOT IN {_STOP}",
    "complexity": f"{_COMPLEX} SELECT qid, intent, n_words, n_names, complexity, CASE WHEN complexity < 0.3 THEN 'easy' WHEN complexity > 0.7 THEN 'hard' ELSE 'medium' END AS level FROM c",
    "plan_generate": f"{_PLANS} SELECT * FROM p",
    "plan_cost": f"{_PLANS} SELECT qid, round((dense_k / 100 * (2 / 0.7::DOUBLE) + bm25_k / 100 * (2 / 0.9::DOUBLE) + graph_k / 100 * (2 / 0.5::DOUBLE) + (dense_k + bm25_k + graph_k) / 200) * (1 + 0.5::DOUBLE * hops), 4) AS seconds, (dense_k + bm25_k + graph_k)::BIGINT AS total_k, round(dense_k / 100 * 0.8::DOUBLE + bm25_k / 100 * 0.3::DOUBLE + graph_k / 100 * 0.9::DOUBLE, 4) AS cost FROM p",
    "plan_optimize_speed": f"{_PLANS} SELECT qid, least(dense_k, 75) AS dense_k, least(bm25_k, 75) AS bm25_k, 0 AS graph_k, least(hops, 1) AS hops FROM p",
    "session_windows": "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 3600 SECONDS THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n FROM s GROUP BY user_id, k",
    "session_recent_context": "SELECT conv_id, turn, count(text) OVER w AS n_before, md5(coalesce(string_agg(text, chr(10)) OVER w, '')) AS context_md5 FROM conversations WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)",
    "session_summary": "SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS n_types, round(avg(value), 4) AS mean_value, min(ts) AS first, max(ts) AS last FROM events GROUP BY user_id",
    "session_preferences": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS place FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)) WHERE place <= 3",
    "trend_windows": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 8) AS recent, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 39 PRECEDING AND 20 PRECEDING), 8) AS earlier FROM events",
    "queries_per_minute": "SELECT event_id, CASE WHEN s > 0 THEN round(n * 60 / s, 6) END AS per_minute FROM (SELECT event_id, count(*) OVER w AS n, floor(epoch(max(ts) OVER w)) - floor(epoch(min(ts) OVER w)) AS s FROM events " + _SEEN.format(99, "CURRENT ROW") + ")",
    "session_patterns": f"WITH x AS (SELECT conv_id, count(*) AS n, count(DISTINCT {_INTENT.replace('query', 'text')}) AS n_intents, count(*) FILTER (len(regexp_extract_all(lower(text), {_WORD})) > 15) AS n_long FROM conversations WHERE role = 'user' GROUP BY conv_id) SELECT *, CASE WHEN n < 3 THEN 'none' WHEN n_long >= 3 THEN 'complex' WHEN n_intents >= 3 THEN 'exploring' ELSE 'steady' END AS pattern FROM x",
    "cache_exact_hits": "SELECT md5(lower(trim(text, ' '))) AS key, count(*) AS asked, count(*) - 1 AS hits FROM conversations WHERE role = 'user' GROUP BY 1",
    "cache_ttl_evict": "SELECT event_id, ts FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOURS ORDER BY ts DESC, event_id LIMIT 1000",
    "dedupe_results": "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY substr(text, 1, 100) ORDER BY doc_id) = 1",
    "citations_extract": f"{_CITED} SELECT * FROM c",
    "citation_validate": f"{_CITED} SELECT answer_id, count(doc_id) AS n_valid, count(*) - count(doc_id) AS n_invalid FROM c LEFT JOIN documents ON cited = doc_id GROUP BY answer_id",
    "calibration": f"{_PRED} SELECT * FROM bins",
    "ece": f"{_PRED} SELECT (SELECT count(*) FROM pr) AS n, (SELECT round(avg(abs(p - y)), 6) FROM pr) AS mae, round(sum(n * gap) / sum(n), 5) AS ece FROM bins",
    "claims": f"{_CLAIM} SELECT * FROM c",
    "claim_overlap_nli": f"{_CLAIM} SELECT * FROM l",
    "confidence_components": f"{_CLAIM} SELECT conv_id, turn, round(least(1.0, 0.4::DOUBLE * avg(share) + 0.4::DOUBLE * max(share) + 0.2::DOUBLE * least(count(*) / 3, 1.0)), 6) AS confidence FROM l GROUP BY ALL",
    "verdicts": f"{_CLAIM} SELECT conv_id, turn, count(*) AS n, CASE WHEN avg((label = 'contradicted')::INT) > 0.2 THEN 'regenerate' WHEN avg((label = 'entailed')::INT) >= 0.7 THEN 'satisfactory' WHEN avg((label = 'neutral')::INT) > 0.5 THEN 'expand' ELSE 'clarify' END AS verdict FROM l GROUP BY ALL",
    "feedback_summary": f"{_RATED} SELECT event_type, count(*) AS n, round(avg(rating), 6) AS mean_rating, max_by(event_id, (ts, event_id)) AS latest FROM r GROUP BY event_type",
    "rating_patterns": f"{_RATED} SELECT event_type, round(avg((rating <= 2)::INT), 6) AS low_share, avg((rating <= 2)::INT) > 0.3 AS alarm FROM r GROUP BY event_type",
    "rating_histogram": f"{_RATED} SELECT rating, count(*) AS n FROM r GROUP BY rating",
    "health": f"{_RATED}, h AS (SELECT round(avg(least(1.0, m / 4.0)), 6) AS health FROM (SELECT avg(rating) AS m FROM r GROUP BY event_type)) SELECT health, CASE WHEN health >= 0.9 THEN 'good' WHEN health >= 0.7 THEN 'fair' ELSE 'poor' END AS band FROM h",
    "metric_ema": f"{_RATED[:5]}RECURSIVE {_RATED[5:]}, dd AS (SELECT event_type, ts::DATE AS day, avg(rating) AS mean, row_number() OVER (PARTITION BY event_type ORDER BY ts::DATE) AS k FROM r GROUP BY 1, 2), x AS (SELECT event_type, day, mean, k, mean AS ema FROM dd WHERE k = 1 UNION ALL SELECT dd.event_type, dd.day, dd.mean, dd.k, 0.1::DOUBLE * dd.mean + 0.9::DOUBLE * x.ema FROM x JOIN dd ON dd.event_type = x.event_type AND dd.k = x.k + 1) SELECT event_type, strftime(day, '%Y-%m-%d') AS day, round(mean, 6) AS mean, round(ema, 6) AS ema FROM x",
    # sessions that the final watermark, an hour before the newest event, has passed
    "stream_memory": f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL {memory.IDLE} SECONDS THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g),
w AS (SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n, list(event_type ORDER BY ts, event_id) AS types FROM s GROUP BY user_id, k),
f AS (SELECT *, CASE WHEN session_start - lag(session_end) OVER (PARTITION BY user_id ORDER BY session_start) < INTERVAL {memory.HOURS} HOURS THEN 0 ELSE 1 END AS fresh FROM w), r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY session_start) AS life FROM f)
SELECT user_id, session_start, session_end, n, least(n, {memory.RING})::INT AS n_kept, array_to_string(types[greatest(1, n - {memory.RING - 1}):], ',') AS last_types, row_number() OVER (PARTITION BY user_id, life ORDER BY session_start) AS session_no
FROM r WHERE session_end + INTERVAL {memory.IDLE} SECONDS <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
    "stream_sessions": "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 3600 SECONDS THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR",
    "stream_feedback_counts": "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type",
}
