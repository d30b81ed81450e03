"""Typed relations between names, paths and components of graphs, pattern entities, and fuzzy matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.shared import cut
from gleaner.functions.text import tokens

#: Relation, phrases between source and target, phrases between target and source.
RELATIONS = [
    ("WORKS_FOR", ["works for", "employed by", "employee of"], ["employs", "hires"]),
    ("LOCATED_IN", ["in", "located in", "based in"], ["contains", "includes"]),
    ("FOUNDED_BY", ["founded by", "created by", "established by"], ["founded", "created", "established"]),
    ("PART_OF", ["part of", "division of", "subsidiary of"], ["includes", "contains", "owns"]),
    ("RELATED_TO", ["related to", "associated with", "connected to"], ["related to", "associated with", "connected to"]),
]
#: Type and pattern; the last one that matches a text gives its type.
PATTERNS = [
    ("DATE", r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"),
    ("YEAR", r"\b\d{4}\b"),
    ("QUANTITY", r"\b\d+(?:\.\d+)?\s*(?:million|billion|thousand|crore|lakh)\b"),
    ("MEASUREMENT", r"\b\d+(?:\.\d+)?\s*(?:kg|km|meter|feet|inch|pound|gram)\b"),
    ("TECHNOLOGY", r"\b(?:API|HTTP|JSON|XML|SQL|HTML|CSS|JavaScript|Python|Java|C\+\+)\b"),
    ("SCRIPTURE", r"\b(?:Ramayana|Mahabharata|Bhagavad Gita|Vedas|Upanishads|Puranas)\b"),
    ("CONCEPT", r"\b(?:dharma|karma|moksha|samsara|ahimsa|yoga|meditation)\b"),
    ("MOUNTAIN", r"\b(?:Mount|Mt\.)\s+[A-Z][a-z]+\b"),
    ("WATER_BODY", r"\b(?:River|Lake)\s+[A-Z][a-z]+\b"),
]
#: Words that are capitalised at the beginning of sentences and no names.
NO_NAMES = ["The", "A", "An", "And", "Or", "Of", "To", "In", "On", "For", "Is", "Was", "With", "As", "By", "At", "It", "That"]


def is_name(word: Column) -> Column:
    """Capitalised words of two letters or more, but for the commonest function words."""
    return F.rlike(word, F.lit(r"^\p{Lu}\p{Ll}+$")) & ~word.isin(NO_NAMES)


def _between(words: Column, a: Column, b: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(F.array_join(F.slice(words, a + 2, F.greatest(b - a - 1, F.lit(0))), " ")), F.lit(" "))


def typed(docs: DataFrame) -> DataFrame:
    """(source, target, relation, n, first_doc): relations told by a phrase between two names that follow one another in a sentence.

    Pairs of neighbours only, so that work is linear in the names; each type counts once a pair.
    """
    sentences = docs.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), r"[.!?\n]+")).alias("s"))
    worded = sentences.select("doc_id", F.regexp_extract_all("s", F.lit(r"\p{L}+"), F.lit(0)).alias("w"))
    named = worded.select("doc_id", "w", F.filter(F.transform("w", lambda x, i: F.when(is_name(x), i)), lambda i: i.isNotNull()).alias("at")).where(F.size("at") > 1)
    pairs = named.select("doc_id", "w", F.explode(F.arrays_zip(F.slice("at", 1, F.size("at") - 1).alias("a"), F.slice("at", 2, F.size("at") - 1).alias("b"))).alias("p"))
    met = pairs.select("doc_id", F.lower(F.get("w", F.col("p.a"))).alias("x"), F.lower(F.get("w", F.col("p.b"))).alias("y"), _between(F.col("w"), F.col("p.a"), F.col("p.b")).alias("between")).where("x <> y")
    has = lambda phrases: F.rlike("between", F.lit(" (" + "|".join(phrases) + ") "))
    row = lambda s, t, r: F.struct(F.col(s).alias("source"), F.col(t).alias("target"), F.lit(r).alias("relation"))
    found = [F.when(has(forth), row("x", "y", r)).when(has(back), row("y", "x", r)) for r, forth, back in RELATIONS]
    return met.select("doc_id", F.explode(F.array_compact(F.array(*found))).alias("r")).groupBy("r.source", "r.target", "r.relation").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def paths(edges: DataFrame, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """(seed, node, hops, path, relations): the shortest path along directed edges from each seed; of equally short ones the first by nodes, then relations.

    Each hop is cut, keeps one path for a seed and node, and goes on from new nodes only.
    """
    now = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hops"), F.col("node").alias("path"), F.lit("").alias("relations")).distinct()
    seen, new = now, now
    for hop in range(1, hops + 1):
        step = new.join(edges.select(F.col("source").alias("node"), "target", "relation"), "node").select("seed", F.col("target").alias("node"), F.lit(hop).alias("hops"), F.concat_ws(">", "path", "target").alias("path"), F.when(F.col("relations") == "", F.col("relation")).otherwise(F.concat_ws(">", "relations", "relation")).alias("relations"))
        best = step.groupBy("seed", "node").agg(F.min(F.struct("path", "relations")).alias("best")).select("seed", "node", F.lit(hop).alias("hops"), "best.*")
        new = cut(best.join(seen.select("seed", "node"), ["seed", "node"], "left_anti"))
        seen = seen.unionByName(new)
    return seen.where("hops > 0")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that can be reached either way.

    A round gives each node the smallest label of itself and its neighbours, then that label's own
    label, so that chains halve; rounds are cut and end when no label changes.
    """
    both = cut(edges.select("source", "target").unionAll(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct())
    now = cut(both.groupBy(F.col("source").alias("node")).agg(F.least(F.min("target"), F.first("source")).alias("component")))
    while True:
        near = both.join(now.select(F.col("node").alias("target"), "component"), "target").groupBy(F.col("source").alias("node")).agg(F.min("component").alias("near"))
        least = now.join(near, "node").select("node", F.least("component", "near").alias("label"), "component")
        jumped = least.join(now.select(F.col("node").alias("label"), F.col("component").alias("further")), "label").select("node", F.least("label", "further").alias("component"), (F.least("label", "further") < F.col("component")).alias("changed"))
        after = cut(jumped)
        changed, now = after.where("changed").isEmpty(), after.drop("changed")
        if changed:
            return now


def totals(edges: DataFrame) -> DataFrame:
    """(n_nodes, n_edges, mean_degree, n_components, largest) of a graph."""
    sizes = components(edges).groupBy("component").agg(F.count("*").alias("n"))
    counted = sizes.agg(F.sum("n").alias("n_nodes"), F.count("*").alias("n_components"), F.max("n").alias("largest"))
    n_edges = edges.agg(F.count("*").alias("n_edges"))
    return counted.join(F.broadcast(n_edges), F.lit(True)).select("n_nodes", "n_edges", F.round(2 * F.col("n_edges") / F.col("n_nodes"), 6).alias("mean_degree"), "n_components", "largest")  # one row each


def patterned(queries: DataFrame) -> DataFrame:
    """(qid, entity, type): what the typed patterns find in a query."""
    def of(k: int, kind: str, pattern: str) -> Column:
        row = lambda x: F.struct(F.trim(F.regexp_replace(x, r"\s+", " ")).alias("entity"), F.lit(k).alias("k"), F.lit(kind).alias("type"))
        return F.transform(F.regexp_extract_all("query", F.lit("(?i)" + pattern), F.lit(0)), row)

    found = F.concat(*[of(k, kind, pattern) for k, (kind, pattern) in enumerate(PATTERNS)])
    return queries.select("qid", F.inline(found)).groupBy("qid", "entity").agg(F.max_by("type", "k").alias("type"))


def fuzzy(asked: DataFrame, labels: DataFrame, k: int = 5) -> DataFrame:
    """(qid, id, score, rank): labels (id, label) that share words with a name (qid, name), by common words over the longer one's.

    The two meet by word, so only labels with a word in common do.
    """
    from pyspark.sql import Window as W

    words = lambda df, key, text, size: df.select(key, F.array_distinct(tokens(F.col(text))).alias("w")).select(key, F.size("w").alias(size), F.explode("w").alias("word"))
    met = words(asked, "qid", "name", "q_size").join(words(labels, "id", "label", "l_size"), "word").groupBy("qid", "id", "q_size", "l_size").agg(F.count("*").alias("common"))
    scored = met.select("qid", "id", F.round(F.col("common") / F.greatest("q_size", "l_size"), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
