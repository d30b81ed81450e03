"""Knowledge graphs as tables of mentions, nodes and typed edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.shared import cut
from gleaner.operators.relations import is_name


def _names(text: str) -> Column:
    """Capitalised words in order, without function words."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0)), is_name)


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, text, node): names in order; node is the lower-cased name."""
    return docs.select("doc_id", F.posexplode(_names("text")).alias("pos", "text")).withColumn("node", F.lower("text"))


def nodes(mentioned: DataFrame) -> DataFrame:
    """(node, occurrences, n_docs, first_doc)."""
    return mentioned.groupBy("node").agg(F.count("*").alias("occurrences"), F.count_distinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc"))


def edges(docs: DataFrame) -> DataFrame:
    """(source, target, weight): names mentioned next after one another; linear in the mentions, unlike all pairs of a text. Neighbours are paired inside the row."""
    named = docs.select(F.transform(_names("text"), lambda x: F.lower(x)).alias("n"))
    pairs = named.select(F.explode(F.arrays_zip(F.col("n").alias("source"), F.slice("n", 2, F.greatest(F.size("n"), F.lit(1))).alias("target"))).alias("p")).select("p.*")
    return pairs.where("target is not null and source <> target").groupBy("source", "target").agg(F.count("*").alias("weight"))


def degrees(edges: DataFrame, k: int = 5) -> DataFrame:
    ends = edges.select(F.col("source").alias("node")).unionAll(edges.select(F.col("target").alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(k)


def reach(edges: DataFrame, start: DataFrame, hops: int = 3) -> DataFrame:
    """(node, hop): nodes within some hops of the start nodes, either way along edges, with the fewest hops; hops are cut."""
    both = edges.select("source", "target").unionAll(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    both = cut(both) if hops > 1 else both
    seen = start.select("node", F.lit(0).alias("hop"))
    edge_of = seen
    for hop in range(1, hops + 1):
        new = edge_of.join(both, F.col("node") == F.col("source")).select(F.col("target").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hop", F.lit(hop))
        new = cut(new) if hop < hops else new
        seen, edge_of = seen.unionAll(new), new
    return seen


def relation_counts(edges: DataFrame) -> DataFrame:
    """(node, relation, direction, n): a node's edges by relation, those that lead from it (out) and those that lead to it (in)."""
    end = lambda c, way: F.struct(F.col(c).alias("node"), "relation", F.lit(way).alias("direction"))
    return edges.select(F.inline(F.array(end("source", "out"), end("target", "in")))).groupBy("node", "relation", "direction").agg(F.count("*").alias("n"))


def document_scores(mentioned: DataFrame, reached: DataFrame) -> DataFrame:
    """(doc_id, n_nodes, score): reached nodes that a document names, nearer ones for more."""
    named = mentioned.select("node", "doc_id").distinct().join(reached, "node")
    return named.groupBy("doc_id").agg(F.count("*").alias("n_nodes"), F.round(F.sum(1 / (1 + F.col("hop"))), 6).alias("score"))
