"""Mixing sources to target weights with a low-discrepancy source schedule.

1. Each source's share: weights 5, 2, 1 (repeating, sources in code point order, null last)
   share all words; a target stops at three times its source's size and what is over goes to
   the others by weight (solved in closed form over the sources in order of their saturation).
2. The mix is a row of slots of equal length. Slot i's point is the golden-ratio sequence in
   31-bit integers; the cumulative targets turn the point into a source.
3. Slots are ranked within their source. Rank b takes block b of the source's stream: its
   documents in hash order, joined end to end, up to three passes over them.

Ranks and stream offsets are two-level running sums (within buckets, then over buckets), so a
source that holds a third of all rows is never in one task. Null texts have size 0, the null
source is a source like any other, repeated rows are separate documents, empty tables give
empty results, and only id, text and source are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm.common import cut, plain_words, with_row

WEIGHTS = [5, 2, 1]
#: Passes over a source at most, and the words of a slot: total words / 2 ** SLOT_BITS, from 1 to MAX_BLOCK.
PASSES, SLOT_BITS, MAX_BLOCK = 3, 16, 1024
#: Fixed value: the golden ratio's fraction in 31-bit integers.
GOLDEN, POINTS = 1327217885, 1 << 31
#: Slots in a rank bucket; bins of the unit interval; sources up to this many are broadcast to the documents, more are joined by shuffle.
SLOT_BUCKET, BINS, BROADCAST_SOURCES = 65_536, 4096, 10_000


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", extra: list[Column] | None = None) -> DataFrame:
    """(_row, doc_id, source, size), written once: everything below reads this and not the texts."""
    kept = with_row(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.size(plain_words(F.col(text_col))).cast("long").alias("size"), *(extra or [])))
    return cut(kept)


def targets(docs: DataFrame, weights: list[int] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """One row per source: source, source_size, target (double), low and high (its part of the points), total, block."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())  # windows without partitions here are over one row per source
    sources = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = sources.withColumn("n", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("n") % len(weights) + 1).cast("int")).cast("long")
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = W.orderBy("full_at", "n").rowsBetween(W.unboundedPreceding, -1)
    onward = W.orderBy("full_at", "n").rowsBetween(0, W.unboundedFollowing)
    filled = (
        numbered.withColumns({"weight": weight, "limit": F.col("source_size") * passes, "total": F.sum("source_size").over(whole)})
        .withColumn("full_at", F.col("limit") / F.col("weight"))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(onward))
        # the level of the first source that isn't full holds for all that follow it
        .withColumn("level", F.min(F.when(F.col("full_at") > F.col("level"), F.struct("full_at", "n", "level"))).over(whole)["level"])
    )
    target = F.least(F.col("limit").cast("double"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight"))
    high = F.floor(F.sum("target").over(by_name) / F.greatest(F.col("total"), F.lit(1)) * POINTS)
    last = F.max("n").over(whole)
    return (
        filled.withColumn("target", target)
        .withColumn("high", F.when(F.col("n") == last, F.lit(POINTS)).otherwise(high).cast("long"))
        .select("source", "n", "source_size", "target", F.coalesce(F.lag("high").over(by_name), F.lit(0)).cast("long").alias("low"), "high", "total", F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCK), F.shiftright("total", SLOT_BITS))).cast("long").alias("block"))
    )


def schedule(spark, goals: DataFrame) -> DataFrame:
    """One row per slot: slot, n (its source), rank (its block of that source), words."""
    head = goals.agg(F.max("total").alias("total"), F.max("block").alias("block")).first()
    total, block = head["total"] or 0, head["block"] or 1
    point = F.pmod(F.pmod(F.col("id"), F.lit(POINTS)) * GOLDEN, F.lit(POINTS))
    slots = spark.range(-(-total // block)).select(F.col("id").alias("slot"), point.alias("point"), F.least(F.lit(block), total - F.col("id") * block).alias("words"))
    width = POINTS // BINS
    parts = goals.where("high > low").select("n", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))).alias("bin"))
    named = slots.withColumn("bin", F.floor(F.col("point") / width)).join(parts, "bin").where("point >= low and point < high").select("slot", "n", "words", F.floor(F.col("slot") / SLOT_BUCKET).alias("bucket"))
    local = named.withColumn("local", F.row_number().over(W.partitionBy("n", "bucket").orderBy("slot")) - 1)
    ahead = W.partitionBy("n").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = named.groupBy("n", "bucket").agg(F.count("*").alias("slots")).select("n", "bucket", F.coalesce(F.sum("slots").over(ahead), F.lit(0)).alias("ahead"))
    return local.join(offsets, ["n", "bucket"]).select("slot", "n", (F.col("ahead") + F.col("local")).alias("rank"), "words")


def shuffled_streams(docs: DataFrame, goals: DataFrame) -> DataFrame:
    """Each document's start in its source's stream: _row, doc_id, n, size, source_size, target, start."""
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":4")))
    own = goals.select(F.col("source").alias("_s"), "n", "source_size", "target")
    own = F.broadcast(own) if goals.count() <= BROADCAST_SOURCES else own
    # three hex digits: 4096 buckets of a source, in the order of their keys
    keyed = docs.join(own, F.col("source").eqNullSafe(F.col("_s"))).withColumn("key", key).withColumn("bucket", F.substring("key", 1, 3))
    inside = W.partitionBy("n", "bucket").orderBy("key", "doc_id", "_row").rowsBetween(W.unboundedPreceding, -1)
    ahead = W.partitionBy("n").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = keyed.groupBy("n", "bucket").agg(F.sum("size").alias("sum")).select("n", "bucket", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("ahead"))
    return (
        keyed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(buckets, ["n", "bucket"])
        .select("_row", "doc_id", "n", "size", "source_size", "target", (F.col("ahead") + F.col("inside")).alias("start"))
    )


def pieces(docs: DataFrame, passes: int = PASSES) -> tuple[DataFrame, DataFrame]:
    """(streams, pieces). pieces: slot, _row, pass, first (word of the document), words - what the mix takes, in slot order.

    docs: as sized() gives it.
    """
    spark = docs.sparkSession
    goals = cut(targets(docs))
    plan = schedule(spark, goals)
    block = (goals.agg(F.max("block").alias("b")).first()["b"]) or 1
    streams = shuffled_streams(docs, goals)
    # a pass is only laid out as far as the target (and the schedule's error) can reach
    reach = F.col("target") + 64 * block
    laid = (
        streams.where("size > 0")
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass"))
        .withColumn("at", F.col("pass") * F.col("source_size") + F.col("start"))
        .where(F.col("at") <= reach)
        .select("*", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("rank"))
    )
    low, high = F.greatest(F.col("at"), F.col("rank") * block), F.least(F.col("at") + F.col("size"), F.col("rank") * block + F.col("words"))
    taken = laid.join(plan, ["n", "rank"]).withColumn("low", low).withColumn("high", high).where("high > low")
    return streams, taken.select("slot", "_row", "pass", (F.col("low") - F.col("at")).alias("first"), (F.col("high") - F.col("low")).alias("words"))


def mix(docs: DataFrame) -> DataFrame:
    """One row per document of sized(): _row, doc_id, size, source_size, target, taken."""
    streams, parts = pieces(docs)
    rows = streams.select("_row", "doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("words"))
    took = parts.select("_row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("source_size"), F.lit(None).cast("double").alias("target"), "words")
    return rows.unionByName(took).groupBy("_row").agg(
        F.max("doc_id").alias("doc_id"), F.max("size").alias("size"), F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("words").alias("taken")
    )


def mixed(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The mix itself, with the columns of docs: a row for each pass over a document, with the words taken of it if they aren't all."""
    base = with_row(docs)
    marked = cut(base.select("_row", F.col("doc_id"), F.col("source"), F.size(plain_words(F.col(text_col))).cast("long").alias("size")))
    _, parts = pieces(marked)
    passes = parts.groupBy("_row", "pass").agg(F.min("first").alias("first"), F.sum("words").alias("taken"))
    met = base.select(F.struct(*docs.columns).alias("carried"), F.col(text_col).alias("whole"), "_row").join(passes, "_row")
    words = plain_words(F.col("whole"))
    part = F.array_join(F.slice(words, (F.col("first") + 1).cast("int"), F.col("taken").cast("int")), " ")
    met = met.withColumn("part", F.when(F.col("taken") == F.size(words), F.col("whole")).otherwise(part))
    new = {text_col: F.col("part"), length_col: F.length("part").cast("long")}
    return met.select(*[new[c].alias(c) if c in new else F.col("carried")[c].alias(c) for c in docs.columns])


def op4_source_mix(spark, sf_dir):
    return mix(sized(spark.read.parquet(f"{sf_dir}/documents.parquet"))).drop("_row")


def oracle() -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM d GROUP BY source),
w AS (SELECT *, {WEIGHTS}[(n % {len(WEIGHTS)} + 1)::INT] AS weight, {PASSES} * source_size AS lim, (sum(source_size) OVER ())::BIGINT AS total FROM s),
l AS (SELECT *, lim / weight AS full_at,
        (total - coalesce(sum(lim) OVER (ORDER BY lim / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT
          / (sum(weight) OVER (ORDER BY lim / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM w),
v AS (SELECT level FROM l WHERE full_at > level ORDER BY full_at, n LIMIT 1),
g AS (SELECT source, n, source_size, total, least(lim::DOUBLE, coalesce((SELECT level FROM v), 0.0) * weight) AS target,
        greatest(1, least({MAX_BLOCK}, total >> {SLOT_BITS})) AS block FROM l),
b AS (SELECT *, CASE WHEN n = max(n) OVER () THEN {POINTS} ELSE floor(sum(target) OVER (ORDER BY n) / greatest(total, 1) * {POINTS})::BIGINT END AS high FROM g),
p AS (SELECT *, coalesce(lag(high) OVER (ORDER BY n), 0) AS low FROM b),
slots AS (SELECT i AS slot, ((i % {POINTS}) * {GOLDEN}) % {POINTS} AS point, least(block, total - i * block) AS words
  FROM (SELECT unnest(range((total + block - 1) // block)) AS i, total, block FROM (SELECT DISTINCT total, block FROM g))),
ranked AS (SELECT n, words, row_number() OVER (PARTITION BY n ORDER BY slot) - 1 AS rank FROM slots JOIN p ON point >= low AND point < high),
st AS (SELECT r, doc_id, size, n, source_size, target, block, coalesce(sum(size) OVER (PARTITION BY n
    ORDER BY md5(coalesce(doc_id::VARCHAR, '') || ':4'), doc_id, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
laid AS (SELECT *, unnest(range(spot // block, (spot + size - 1) // block + 1)) AS rank
  FROM (SELECT *, pass * source_size + start AS spot FROM st, range({PASSES}) AS x(pass) WHERE size > 0)),
took AS (SELECT r, sum(greatest(0, least(spot + size, rank * block + words) - greatest(spot, rank * block)))::BIGINT AS taken FROM laid JOIN ranked USING (n, rank) GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM st LEFT JOIN took USING (r)"""
