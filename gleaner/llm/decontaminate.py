"""Benchmark decontamination through a positional inverted index.

The training texts' words are stored once as postings (term, row, pos), a term being its word's
64-bit hash: a segment a task, sorted by term, so a search for a few terms passes over the row groups
without them, no common term meets in one task, and building needs no shuffle. A search takes the benchmark's
windows of words.
The KEYS rarest terms of each window are looked up first; their lists, each shifted by the
term's offset in the item, are intersected on (row, item, diagonal). Only the places that are left
ask for the window's other terms at exactly their positions. Runs of neighbouring offsets found on a
diagonal are phrase matches; verified() holds them against the words themselves, so that hashes decide nothing. Proximity matches come from the same rarest terms: all of a window's
stand within SPAN words, in any order.

Null texts have no words; null ids are kept; repeated rows each give a row; an empty table gives an
empty result, an empty benchmark no matches; items with the same words all match; items without
words never do; an item id that is null or repeated stands for a row of its own in the matches,
the same for the digest; only ids and texts are read, so other columns can't clash. Very long texts
are one array of words inside a row, and a posting a word after that.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm.common import LOWER, UPPER, cut, letter_words, shared_dir, table, with_row

#: Words of a window; rarest terms that are intersected first; words within which they count as near.
WINDOW, KEYS, SPAN = 10, 3, 20
#: Rows of a table of terms, windows or places up to which it is broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Index:
    """A stored index: postings (term, row, pos) and documents (row, doc_id)."""

    postings: DataFrame
    docs: DataFrame
    folder: str


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> Index:
    """Writes the index of docs to a folder (a new one in the shared storage, if none is given)."""
    folder = folder or f"{shared_dir(docs.sparkSession)}/index-{uuid.uuid4().hex}"
    rows = numbered(docs, id_col, text_col)
    each = rows.select("row", F.posexplode(letter_words(F.col("text"))).alias("pos", "word")).select(F.xxhash64("word").alias("term"), "row", "pos")
    each.sortWithinPartitions("term").write.parquet(f"{folder}/postings")
    rows.select("row", "doc_id").write.parquet(f"{folder}/docs")
    return load(docs.sparkSession, folder)


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, text); docs is a scan or a cut, so that rows have the same numbers each time."""
    return with_row(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "row")


def load(spark: SparkSession, folder: str) -> Index:
    return Index(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/docs"), folder)


def postings_of(index: Index, terms: DataFrame) -> DataFrame:
    return index.postings.join(_small(terms.select("term").distinct()), "term", "left_semi")


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, item_id, size, span, offset, word, term) of each word of each item; span: the words of its windows."""
    words = with_row(items.select(F.col(id_col).cast("string").alias("item_id"), letter_words(F.col(text_col)).alias("words")), "item")
    return words.select("item", "item_id", F.size("words").alias("size"), F.least(F.size("words"), F.lit(window)).alias("span"), F.posexplode("words").alias("offset", "word")).withColumn("term", F.xxhash64("word"))


def windows(index: Index, terms: DataFrame) -> DataFrame:
    """(item, start, span, offset, word, term, key) of each window of the items all of whose terms the index has; key: the term's place among the rarest, from 1."""
    counts = postings_of(index, terms).groupBy("term").agg(F.count("*").alias("cf"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("offset") - F.col("span") + 1), F.least(F.col("offset"), F.col("size") - F.col("span")))
    each = terms.join(counts, "term").select("item", "item_id", "span", "offset", "word", "term", "cf", F.explode(starts).alias("start"))
    own = W.partitionBy("item", "start")
    whole = each.withColumn("present", F.count("*").over(own)).where("present = span").drop("present")
    first = whole.withColumn("again", F.row_number().over(W.partitionBy("item", "start", "term").orderBy("offset")))  # a repeated term counts once
    return first.withColumn("key", F.when(F.col("again") == 1, F.row_number().over(own.orderBy("again", "cf", "word")))).drop("again", "cf")


def _lists(index: Index, keys: DataFrame) -> DataFrame:
    """(row, term, pos) of the rarest terms."""
    return cut(postings_of(index, keys).select("row", "term", "pos"))


def phrases(index: Index, found: DataFrame, keys: DataFrame, lists: DataFrame) -> DataFrame:
    """(row, item, diagonal, low, high): stretches of words in a row that windows of an item cover; a place less its diagonal is the offset in the item."""
    keyed = _small(keys.select("item", "offset", "term").distinct())
    # dealt by row, what follows stays where it is
    shifted = lists.repartition("row").join(keyed, "term").select("row", "item", (F.col("pos") - F.col("offset")).alias("diagonal"), "offset")
    fewest = keys.groupBy("item", "start", "span").agg(F.count("*").alias("n")).groupBy("item", "span").agg(F.min("n").alias("fewest"))
    met = shifted.groupBy("row", "item", "diagonal").agg(F.count("*").alias("n"), F.min("offset").alias("first"), F.max("offset").alias("last"))
    places = cut(met.join(_small(fewest), "item").where("n >= fewest").select("row", "item", "diagonal", (F.col("first") - F.col("span") + 1).alias("first"), (F.col("last") + F.col("span") - 1).alias("last")))
    words = _small(found.select("item", "offset", "term").distinct())
    asked = places.join(words, "item").where("offset between first and last").select("row", "item", "diagonal", "offset", "term", (F.col("diagonal") + F.col("offset")).alias("pos"))
    # of the postings, only those of the items' terms in rows with a place are moved
    near = postings_of(index, found).join(_small(places.select("row").distinct()), "row", "left_semi").select("row", "term", "pos")
    matched = asked.join(near, ["row", "term", "pos"]).select("row", "item", "diagonal", "offset")
    line = W.partitionBy("row", "item", "diagonal").orderBy("offset")
    runs = matched.withColumn("run", F.col("offset") - F.row_number().over(line)).groupBy("row", "item", "diagonal", "run").agg(F.min("offset").alias("a"), F.max("offset").alias("b"))
    spans = found.select("item", "span").distinct()
    return runs.join(_small(spans), "item").where("b - a + 1 >= span").select("row", "item", "diagonal", (F.col("diagonal") + F.col("a")).alias("low"), (F.col("diagonal") + F.col("b")).alias("high"))


def proximities(keys: DataFrame, lists: DataFrame, span: int = SPAN) -> DataFrame:
    """(row, item) where the rarest terms of one of the item's windows stand within so many words, in any order."""
    sets = keys.groupBy("item", "start").agg(F.array_sort(F.collect_set("term")).alias("terms")).select("item", "terms").distinct()
    bits = sets.select("item", F.xxhash64("item", "terms").alias("set"), F.size("terms").alias("n"), F.posexplode("terms").alias("bit", "term"))
    hits = lists.repartition("row").join(_small(bits), "term").select("row", "item", "set", "n", "pos", F.expr("shiftleft(1, bit)").alias("mask"))
    # only rows with all of a set's terms anywhere are looked at place by place
    whole = hits.groupBy("row", "set", "n").agg(F.bit_or("mask").alias("seen")).where(F.bit_count("seen") == F.col("n")).select("row", "set")
    over = W.partitionBy("row", "item", "set").orderBy("pos").rangeBetween(0, span - 1)
    close = hits.join(whole, ["row", "set"], "left_semi").withColumn("seen", F.bit_or("mask").over(over))
    return close.where(F.bit_count("seen") == F.col("n")).select("row", "item").distinct()


def matches(index: Index, items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, n_keys: int = KEYS, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """Phrase matches (row, item, item_id, diagonal, low, high) and proximity matches (row, item, item_id) of the items in the indexed texts."""
    terms = cut(item_terms(items, id_col, text_col, window))
    found = cut(windows(index, terms))
    keys = found.where(F.col("key") <= n_keys)
    lists = _lists(index, keys)
    ids = _small(terms.select("item", "item_id").distinct())
    return phrases(index, found, keys, lists).join(ids, "item"), proximities(keys, lists, span).join(ids, "item")


def verified(found: DataFrame, docs: DataFrame, items: DataFrame, text_col: str = "text", item_text_col: str = "text") -> DataFrame:
    """The phrase matches (row, item, item_id, low, high) whose words stand in both texts; docs as numbered() gives them. Only texts with a match are split."""
    words = docs.join(_small(found.select("row").distinct()), "row", "left_semi").select("row", letter_words(F.col(text_col)).alias("words"))
    own = with_row(items.select(letter_words(F.col(item_text_col)).alias("own")), "item")
    met = found.join(words, "row").join(_small(own), "item")
    at = F.col("low") - F.col("diagonal")
    same = F.slice("words", F.col("low") + 1, F.col("high") - F.col("low") + 1) == F.slice("own", at + 1, F.col("high") - F.col("low") + 1)
    return met.where(same).select("row", "item", "item_id", "low", "high")


def contamination(index: Index, docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per document of an index of docs: n_words, n_hit, n_items, items_sha256, contaminated, n_near (items with a proximity match)."""
    exact, near = matches(index, items, **options)
    exact = cut(verified(cut(exact), numbered(docs), items))
    words = exact.select("row", F.explode(F.sequence("low", "high")).alias("pos")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    of_row = exact.select("row", "item", "item_id").distinct().groupBy("row").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("ids"))
    by_row = near.groupBy("row").agg(F.count("*").alias("n_near"))
    sizes = index.postings.groupBy("row").agg(F.count("*").alias("n_words"))
    out = index.docs.join(sizes, "row", "left").join(words, "row", "left").join(of_row, "row", "left").join(by_row, "row", "left")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", none("n_words"), none("n_hit"), none("n_items"), F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), none("n_near"))


def op11_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return contamination(build(docs), docs, table(spark, sf_dir, "benchmark"))


def oracle() -> str:
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
i AS (SELECT row_number() OVER () AS item, item_id, w, least(len(w), {WINDOW}) AS span FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT item, item_id, span, s, w[s:s + span - 1] AS words FROM (SELECT *, unnest(range(1, (len(w) - span + 2)::BIGINT)) AS s FROM i)),
spans AS (SELECT DISTINCT span FROM i),
grams AS (SELECT r, span, p, w[p:p + span - 1] AS words FROM (SELECT r, w, span, unnest(range(1, (len(w) - span + 2)::BIGINT)) AS p FROM d, spans)),
hit AS (SELECT r, item, item_id, span, p FROM grams JOIN win USING (span, words)),
n_hit AS (SELECT r, count(DISTINCT pos) AS n FROM (SELECT r, unnest(range(p, (p + span)::BIGINT)) AS pos FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, item, item_id FROM hit) GROUP BY r),
tok AS (SELECT r, p, w[p] AS term FROM (SELECT r, w, unnest(range(1, (len(w) + 1)::BIGINT)) AS p FROM d)),
cf AS (SELECT term, count(*) AS cf FROM tok GROUP BY term),
wt AS (SELECT DISTINCT item, s, span, unnest(words) AS term FROM win),
alive AS (SELECT item, s, term, row_number() OVER (PARTITION BY item, s ORDER BY cf, term) AS key, min(coalesce(cf, 0)) OVER (PARTITION BY item, s) AS low FROM wt LEFT JOIN cf USING (term)),
sets AS (SELECT DISTINCT item, terms FROM (SELECT item, s, list_sort(list(term)) AS terms FROM alive WHERE key <= {KEYS} AND low > 0 GROUP BY item, s)),
kp AS (SELECT r, item, terms, term, p FROM (SELECT item, terms, unnest(terms) AS term FROM sets) JOIN tok USING (term)),
near AS (SELECT DISTINCT r, item FROM (SELECT r, item, terms, count(DISTINCT b.term) AS n FROM kp a JOIN kp b USING (r, item, terms) WHERE b.p BETWEEN a.p AND a.p + {SPAN - 1} GROUP BY r, item, terms, a.p HAVING n = len(terms))),
n_near AS (SELECT r, count(*) AS n FROM near GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  n_hit.n IS NOT NULL AS contaminated, coalesce(n_near.n, 0)::BIGINT AS n_near
FROM d LEFT JOIN n_hit USING (r) LEFT JOIN items USING (r) LEFT JOIN n_near USING (r)"""
