"""The corpus pipeline: quality rules, near duplicates, repeated passages, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes a stage's rows as
Parquet to the shared folder and gives the reread rows to the next. All stages but the last
return the columns of documents.

Null and empty texts go in the first stage, as they have fewer than ten words; null sources are a
source; in a group of near duplicates rows with a null id come last; repeated rows are near
duplicates of one another, so the first stays; texts of any length are taken whole; further
columns are carried along up to the last stage; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import mixing, quality, sentencepiece_fst, simhash, suffix_dedup
from gleaner.llm.common import shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or diverge from every language reference go."""
    return quality.keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, resemblance 0.8) the smallest doc_id stays."""
    return simhash.keep_one(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that come earlier in the corpus are cut out."""
    return suffix_dedup.rest_of(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights; a document taken more than once has a row for each pass."""
    return mixing.mixed(docs)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_ids, ids."""
    encoded = sentencepiece_fst.encode(docs)
    return encoded.select("row.doc_id", "row.lang", "row.source", F.size("ids").cast("long").alias("n_ids"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding", sentencepiece_ids),
]

#: The near-duplicate and suffix-array stages have no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    """A folder of the shared storage, wherever that is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages before it wrote is deleted once the next has been written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _delete(spark, f"{folder}/{k - 1}")
    return docs
