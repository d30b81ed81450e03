"""Search indexes kept as Parquet: written once, appended to, read with only the parts that a search needs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.shared import shared_dir
from gleaner.functions.text import tokens

#: Folders that postings are dealt over by term; a search for a few terms reads only theirs.
PARTS = 64


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def part_of(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


def write_postings(docs: DataFrame, path: str | None = None, mode: str = "errorifexists") -> str:
    """Postings (term, doc_id, dl, tf) of docs (doc_id, text), in folders by term; mode append adds documents. Returns the folder."""
    path = path or new_folder(docs.sparkSession, "postings")
    words = docs.select("doc_id", tokens(F.col("text")).alias("words"))
    each = words.select("doc_id", F.size("words").alias("dl"), F.explode("words").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    # a folder's rows go to several tasks, so that a common word's don't go to one
    dealt = each.withColumn("part", part_of("term")).repartition("part", F.pmod(F.xxhash64("doc_id"), F.lit(8)))
    dealt.sortWithinPartitions("part", "term").write.partitionBy("part").mode(mode).parquet(path)
    return path


def read_postings(spark: SparkSession, path: str, terms: list[str] | None = None) -> DataFrame:
    """Postings, of some terms (a short list) or all: folders of other terms aren't read, and row groups without the terms are passed over."""
    rows = spark.read.parquet(path)
    return rows if terms is None else rows.where(F.col("part").isin(sorted({r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(part_of("t")).collect()})) & F.col("term").isin(terms))


def term_statistics(spark: SparkSession, path: str) -> DataFrame:
    """(term, df, cf) of stored postings."""
    return read_postings(spark, path).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def write_embeddings(rows: DataFrame, id_col: str, vector_col: str, path: str | None = None, mode: str = "errorifexists") -> str:
    """Vectors that aren't null as (id, vector, dimension). Returns the folder."""
    path = path or new_folder(rows.sparkSession, "embeddings")
    rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.size(vector_col).alias("dimension")).write.mode(mode).parquet(path)
    return path


def statistics(spark: SparkSession, path: str) -> DataFrame:
    """(n_vectors, n_dimensions, dimension) of stored vectors; the vectors themselves aren't read."""
    return spark.read.parquet(path).agg(F.count("*").alias("n_vectors"), F.count_distinct("dimension").alias("n_dimensions"), F.max("dimension").alias("dimension"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str | None = None) -> str:
    """Nodes and edges side by side. Returns the folder."""
    path = path or new_folder(nodes.sparkSession, "graph")
    nodes.write.parquet(f"{path}/nodes")
    edges.write.parquet(f"{path}/edges")
    return path


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
