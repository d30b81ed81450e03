"""Schema profiles as long tables, text structure, and row and text chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EMAIL, URL, PHONE, DATE = r"^[^@\s]+@[^@\s]+\.[^@\s]+", r"^https?://", r"^\+?[0-9()\- ]{7,}$", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"


def numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, n_null, n_distinct, low, high, mean) of each column, in one pass."""
    parts = [F.struct(F.lit(c).alias("name"), F.count_if(F.col(c).isNull()).alias("n_null"), F.count_distinct(F.col(c)).alias("n_distinct"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"), F.round(F.avg(c), 4).alias("mean")) for c in columns]
    return df.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def texts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, n_null, n_distinct, mean_length, kind): kind is told by what over 80% of the values look like, else by length."""
    parts = []
    for c in columns:
        share = lambda p, c=c: F.avg(F.rlike(F.col(c), F.lit(p)).cast("int"))
        size = F.avg(F.length(c))
        kind = F.when(share(EMAIL) > 0.8, "email").when(share(URL) > 0.8, "url").when(share(PHONE) > 0.8, "phone").when(share(DATE) > 0.8, "date").when(size > 100, "long").when(size < 20, "short").otherwise("medium")
        parts.append(F.struct(F.lit(c).alias("name"), F.count_if(F.col(c).isNull()).alias("n_null"), F.count_distinct(F.col(c)).alias("n_distinct"), F.round(size, 4).alias("mean_length"), kind.alias("kind")))
    return df.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def structure(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_bullets, n_numbered, n_paragraphs): a paragraph is a run of lines that aren't blank."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    filled = F.transform(lines, lambda x: (F.length(F.trim(x)) > 0).cast("int"))
    split = docs.select("doc_id", "text", lines.alias("lines"), filled.alias("filled"))
    starts = F.aggregate(F.zip_with("filled", F.concat(F.array(F.lit(0)), F.slice("filled", 1, F.greatest(F.size("filled") - 1, F.lit(0)))), lambda a, b: ((a == 1) & (b == 0)).cast("int")), F.lit(0), lambda s, x: s + x)
    return split.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("lines", lambda x: F.rlike(x, F.lit(r"^ *[-*] ")))).cast("long").alias("n_bullets"),
        F.size(F.filter("lines", lambda x: F.rlike(x, F.lit(r"^ *[0-9]+\. ")))).cast("long").alias("n_numbered"),
        starts.cast("long").alias("n_paragraphs"),
    )


#: Buckets of keys at most; their counts are what one task orders.
BUCKETS = 100_000


def row_chunks(df: DataFrame, key: str, size: int) -> DataFrame:
    """df with chunk: blocks of so many rows in order of an integer key. Row numbers are running sums over key buckets, so no task holds all rows, and the buckets' number doesn't grow with the table."""
    ends = df.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
    width = max(10_000, -(-((ends["high"] or 0) - (ends["low"] or 0) + 1) // BUCKETS))
    bucketed = df.withColumn("_bucket", F.floor((F.col(key) - (ends["low"] or 0)) / width))
    counts = bucketed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    ahead = counts.select("_bucket", F.coalesce(F.sum("_n").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    number = F.row_number().over(W.partitionBy("_bucket").orderBy(key)) - 1
    return bucketed.withColumn("_number", number).join(ahead, "_bucket").withColumn("chunk", F.floor((F.col("_ahead") + F.col("_number")) / size)).drop("_bucket", "_number", "_ahead")


def packed(items: Column, sizes: Column, budget: int) -> Column:
    """The chunk number of each item: items are packed in order; one that doesn't fit opens a new chunk, unless the chunk is empty.

    The fold keeps a running total and where chunks begin, so its work goes by items; the numbers follow from the beginnings.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("size"), F.array().cast("array<int>").alias("begins"))

    def step(s, size):
        opens = (s["at"] == 0) | (s["size"] + size > budget)
        return F.struct((s["at"] + 1).alias("at"), F.when(opens, size.cast("long")).otherwise(s["size"] + size).alias("size"), F.when(opens, F.concat(s["begins"], F.array(s["at"]))).otherwise(s["begins"]).alias("begins"))

    def numbers(s):
        return F.flatten(F.transform(s["begins"], lambda b, j: F.array_repeat(j, F.coalesce(F.get(s["begins"], j + 1), s["at"]) - b)))

    # the folded value is bound once, as each number looks at it
    return F.get(F.transform(F.array(F.aggregate(sizes, start, step)), numbers), F.lit(0))


def text_chunks(docs: DataFrame, budget: int = 512) -> DataFrame:
    """(doc_id, chunk, tokens, content): lines packed up to a budget of estimated tokens (a quarter of the characters)."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(F.trim(x)) > 0)
    split = docs.select("doc_id", lines.alias("lines"))
    sized = split.withColumn("sizes", F.transform("lines", lambda x: F.floor(F.length(x) / 4).cast("int")))
    numbered = sized.select("doc_id", F.posexplode(F.arrays_zip(F.col("lines"), F.col("sizes"), packed(F.col("lines"), F.col("sizes"), budget).alias("chunk"))).alias("pos", "item"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "item.lines")))
    return numbered.groupBy("doc_id", F.col("item.chunk").alias("chunk")).agg(F.sum("item.sizes").alias("tokens"), F.array_join(F.transform(ordered, lambda x: x["lines"]), "\n").alias("content"))
