"""What the operators of this subpackage share: table access, lineage cuts, word splitting."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the separators of "plain" words.
SPACES = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII characters other than letters and digits: the separators of "letter" words.
NON_ALNUM = "".join(chr(i) for i in range(128) if not chr(i).isalnum())

#: Rows of an Arrow batch: of texts, which can be long, and of numbers.
TEXT_BATCH, NUMBER_BATCH = 512, 20_000


def batch_rows(spark: SparkSession, rows: int) -> None:
    """Rows of an Arrow batch from the next action on; few rows of long texts bound a task's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def giving_back(run):
    """A task's function over batches, after which freed memory goes back to the system: Python workers live on and lie beside the JVM in later stages."""

    @functools.wraps(run)
    def task(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None
        if trim:
            trim(0)

    return task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for lineage cuts: the one the session names, or (local sessions only) a new temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder once and returns the written rows; survives lost executors."""
    spark = df.sparkSession
    where = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: smaller than a cut, for rows that are many and narrow."""
    path = f"{shared_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plain_words(text: Column) -> Column:
    """Maximal runs without ASCII white space, as an array; null gives an empty array."""
    even = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(even, " "), "")


def letter_words(text: Column) -> Column:
    """Maximal runs of letters, digits and non-ASCII characters with A-Z lower-cased; null gives an empty array."""
    even = F.translate(F.coalesce(text, F.lit("")), NON_ALNUM + UPPER, " " * len(NON_ALNUM) + LOWER)
    return F.array_remove(F.split(even, " "), "")


def with_row(df: DataFrame, name: str = "_row") -> DataFrame:
    """Tells repeated rows apart; df must be a scan or a cut, whose rows come in the same order when a task is run again."""
    return df.withColumn(name, F.monotonically_increasing_id())


def sampled(df: DataFrame, key: str, rows: int, seed: int = 0) -> DataFrame:
    """About so many rows (all, if there are fewer), told by the hash of a key: the same rows each time, and no task sends more than its part."""
    total = df.count()
    return df if total <= rows else df.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) < int(rows / total * (1 << 40)))


#: Edges in a partition of the rounds below, about; a small graph isn't dealt over hundreds of files.
EDGES = 50_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the component's smallest node.

    Alternating large-star and small-star rounds, each cut, until nothing changes. A hub's edges
    meet its minimum in a join that Spark can split, and minima are pre-aggregated.
    """
    mark = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, after = None, mark(now)
    while after != before and after["n"]:
        parts = 1 + after["n"] // EDGES
        now = now.coalesce(parts)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(parts)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.union(least.select("u", F.col("m").alias("v"))).coalesce(parts).distinct().coalesce(parts))
        before, after = after, mark(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
