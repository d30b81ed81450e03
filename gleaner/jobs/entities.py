"""Registered queries on entities, relations and pronouns, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.shared import cut
from gleaner.operators import entities
from gleaner.operators.relations import PATTERNS


def _documents(s, d) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


def _found(s, d) -> tuple[DataFrame, DataFrame]:
    """Sentences, and the names in them."""
    split = entities.sentences(_documents(s, d))
    names = cut(entities.name_words(split))
    return split, entities.intervals(names, cut(entities.phrases(names)))


def _typed(s, d):
    return entities.typed(_documents(s, d), _found(s, d)[1])


def _relations(s, d):
    """Relations by a phrase anywhere between two names, and by one that fills the gap between them."""
    split, found = _found(s, d)
    found = cut(found)
    across = entities.related_across(found, cut(entities.triggers(split, entities.ACROSS))).withColumn("method", F.lit("across"))
    return across.unionByName(entities.related_directly(found, entities.triggers(split, entities.DIRECT)).withColumn("method", F.lit("direct")))


QUERIES = {
    "kg_phrases": lambda s, d: entities.phrases(cut(entities.name_words(entities.sentences(_documents(s, d))))),
    "kg_entities_typed": _typed,
    "entity_statistics": lambda s, d: entities.statistics(_typed(s, d)),
    "relations_all": _relations,
    "coreference": lambda s, d: entities.resolved(s.read.parquet(f"{d}/conversations.parquet")),
}

_STOP = ", ".join(f"'{w}'" for w in entities.STOP_ENTITIES)
_WORDS = r"regexp_extract_all(s, '\p{L}+|[^\p{L}\s]+')"
_IS = lambda w: rf"(regexp_full_match({w}, '\p{{Lu}}\p{{L}}+') AND lower({w}) NOT IN ({_STOP}))"
_BASE = rf"""t AS (SELECT row_number() OVER () AS r, doc_id, text, regexp_split_to_array(coalesce(text, ''), '[.!?\n]+') AS ss FROM documents),
se AS (SELECT r, doc_id, unnest(range(len(ss))) AS sn, unnest(ss) AS s FROM t),
ws AS (SELECT r, doc_id, sn, {_WORDS} AS w FROM se),
wo AS (SELECT r, doc_id, sn, w, unnest(range(1, len(w) + 1)) AS p FROM ws),
nm AS (SELECT r, doc_id, sn, p, w[p] AS word, CASE WHEN p < len(w) AND {_IS("w[p + 1]")} THEN w[p + 1] END AS after FROM wo WHERE {_IS("w[p]")}),
n1 AS (SELECT word, count(*) AS n FROM nm GROUP BY word),
n2 AS (SELECT word AS x, after AS y, count(*) AS n FROM nm WHERE after IS NOT NULL GROUP BY ALL HAVING count(*) >= {entities.LEAST_SEEN}),
ph AS (SELECT x, y, n2.n, round(ln(n2.n * (SELECT count(*)::DOUBLE FROM nm) / (a.n * b.n)), 6) AS pmi FROM n2 JOIN n1 a ON a.word = x JOIN n1 b ON b.word = y WHERE round(ln(n2.n * (SELECT count(*)::DOUBLE FROM nm) / (a.n * b.n)), 6) >= {entities.LEAST_PMI}),
pp AS (SELECT nm.*, p - row_number() OVER (PARTITION BY r, sn ORDER BY p) AS run FROM nm JOIN ph ON word = x AND after = y),
rn AS (SELECT r, doc_id, sn, min(p) AS a, max(p) + 2 AS z, string_agg(word, ' ' ORDER BY p) || ' ' || arg_max(after, p) AS entity FROM pp GROUP BY r, doc_id, sn, run HAVING max(p) + 2 - min(p) <= {entities.MOST_WORDS}),
iv AS (SELECT r, doc_id, sn, a, z, entity, 'phrase' AS source FROM rn UNION ALL
  SELECT r, doc_id, sn, p, p + 1, word, 'name' FROM nm WHERE NOT EXISTS (SELECT 1 FROM rn WHERE rn.r = nm.r AND rn.sn = nm.sn AND nm.p >= rn.a AND nm.p < rn.z))"""
_PATTERN_ROWS = " UNION ALL ".join(rf"SELECT doc_id, trim(regexp_replace(unnest(regexp_extract_all(coalesce(text, ''), '(?i){p}')), '\s+', ' ', 'g'), ' ') AS entity, 'pattern' AS source, '{kind}' AS type, {k} AS k FROM t" for k, (kind, p) in enumerate(PATTERNS))
_TYPED = f"""{_BASE},
en AS (SELECT doc_id, entity, source, CASE source WHEN 'phrase' THEN 'COMPOUND' ELSE 'NAME' END AS type, -1 AS k FROM iv UNION ALL {_PATTERN_ROWS}),
ty AS (SELECT doc_id, lower(entity) AS entity, max({{'c': CASE source WHEN 'phrase' THEN 0.9 WHEN 'pattern' THEN 0.8 ELSE 0.7 END::DOUBLE, 'k': k, 't': type, 's': source}}) AS b, count(*) AS n FROM en GROUP BY ALL),
tt AS (SELECT doc_id, entity, b.t AS type, b.s AS source, b.c AS confidence, n FROM ty)"""


def _told(name: str, phrases: list) -> str:
    """Places of the phrases, for each by its number of words."""
    rows = ", ".join(f"('{r}', {str(way).lower()}, '{p}', '{p.split()[0]}', {len(p.split())})" for r, way, p in phrases)
    return f"""{name}_p(relation, forth, words, head, size) AS (VALUES {rows}),
{name} AS (SELECT r, sn, relation, forth, p AS at, p + size AS z FROM (SELECT r, sn, w, p, lower(w[p]) AS head FROM wo) JOIN {name}_p USING (head) WHERE p + size - 1 <= len(w) AND lower(array_to_string(w[p:p + size - 1], ' ')) = words)"""


_PAIRS = """SELECT DISTINCT a.r, a.sn, a.doc_id, relation, CASE WHEN forth THEN lower(a.entity) ELSE lower(b.entity) END AS source, CASE WHEN forth THEN lower(b.entity) ELSE lower(a.entity) END AS target
  FROM iv a JOIN iv b ON a.r = b.r AND a.sn = b.sn AND lower(a.entity) <> lower(b.entity) JOIN {} k ON k.r = a.r AND k.sn = a.sn AND {}"""

ORACLE = {
    "kg_phrases": f"WITH {_BASE} SELECT * FROM ph",
    "kg_entities_typed": f"WITH {_TYPED} SELECT * FROM tt",
    "entity_statistics": f"WITH {_TYPED} SELECT type, count(DISTINCT entity) AS n_entities, count(DISTINCT doc_id) AS n_docs, sum(n)::BIGINT AS mentions, round(avg(confidence), 6) AS mean_confidence, count(*) FILTER (confidence >= 0.8) AS n_sure FROM tt GROUP BY type",
    "relations_all": f"""WITH {_BASE}, {_told("ka", entities.ACROSS)}, {_told("kd", entities.DIRECT)},
pa AS ({_PAIRS.format("ka", "a.z <= k.at AND k.z <= b.a")}), pd AS ({_PAIRS.format("kd", "a.z = k.at AND k.z = b.a")})
SELECT source, target, relation, count(*) AS n, min(doc_id) AS first_doc, 'across' AS method FROM pa GROUP BY ALL UNION ALL SELECT source, target, relation, count(*), min(doc_id), 'direct' FROM pd GROUP BY ALL""",
    "coreference": rf"""WITH t AS (SELECT row_number() OVER () AS r, conv_id, turn, regexp_split_to_array(coalesce(text, ''), '[.!?\n]+') AS ss FROM conversations),
ws AS (SELECT conv_id, turn, sn, {_WORDS} AS w FROM (SELECT conv_id, turn, unnest(range(len(ss))) AS sn, unnest(ss) AS s FROM t)),
wo AS (SELECT conv_id, turn, sn, unnest(range(len(w))) AS p, unnest(w) AS w FROM ws),
k AS (SELECT *, lower(w) IN ({", ".join(f"'{x}'" for x in entities.PRONOUNS)}) AS pro, {_IS("w")} AS nam FROM wo),
l AS (SELECT *, last_value(CASE WHEN nam AND NOT pro THEN w END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, sn, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS entity FROM k)
SELECT conv_id, turn, sn::INT AS sentence, p::INT AS pos, w AS pronoun, entity FROM l WHERE pro""",
}
