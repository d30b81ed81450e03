"""URL filter by a cascade of Bloom filters.

The listed keys are the rules (host and path prefix). The key universe is every host suffix with
every path prefix of a rule's length that any url of the corpus has, plus the blocked host words.
Level 1 encodes the listed keys; level 2 the keys of the universe that level 1 lets through
though they aren't listed; level 3 the listed keys that level 2 lets through; and so on until a
level lets nothing wrong through. Over that universe the cascade's answer is exact, and a page is
judged by bit tests inside its own row: no join, no Python.

Level 1 is made so precise that it lets through about as many wrong keys as are listed, however
large the universe is. So all levels together take a few bytes a listed key for each power of ten
that the universe is larger: the filters' size follows the list and not the corpus.

Null urls and urls without :// have empty host and path, fit no rule, and are allowed by the
method as is any page without a listed key; repeated rows each give a row; an empty table gives
an empty result; of several rules that fit the longest wins; urls of any length are judged whole;
only the id and url columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import LOWER, UPPER, cut

#: Verdict, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: The method's own list: a host with one of these words is blocked unless a rule fits.
HOST_WORDS = ["bets", "casino", "poker", "porn", "viagra", "xxx"]
#: Hash functions of level 2 and above (1.44 bits a key each); bits that a level may take at most (128 MB: some 40 million listed keys).
HASHES, MAX_BITS = 4, 1 << 30
#: Levels after which the build gives up; each lets through about a sixteenth of the keys before it.
MAX_LEVELS = 32


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) as the rules see them."""
    there = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(there, host).otherwise(F.lit("")), F.when(there, path).otherwise(F.lit(""))


class Level:
    """One Bloom filter: words of 64 bits. Its size follows the number of its keys."""

    def __init__(self, keys: DataFrame, n: int, seed: int, hashes: int = HASHES):
        self.hashes, self.seed = hashes, seed
        self.bits = max(64, 64 * math.ceil(n * hashes / math.log(2) / 64))
        if self.bits > MAX_BITS:
            raise ValueError(f"{n} keys need {self.bits} bits; a level may have {MAX_BITS}")
        spots = keys.select(F.explode(self._spots(F.col("key"))).alias("spot"))
        rows = spots.groupBy(F.shiftright("spot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(spot % 64 as int)))").alias("bits")).collect()
        words = ["0"] * (self.bits // 64)  # bounded by MAX_BITS, however large the corpus
        for r in rows:
            words[r["word"]] = str(r["bits"])
        # one literal, which the optimizer turns into an array once
        self.words = F.split(F.lit(",".join(words)), ",").cast("array<bigint>")

    def _spots(self, key: Column) -> Column:
        return F.array(*[F.pmod(F.xxhash64(key, F.lit(self.seed * 64 + i)), F.lit(self.bits)) for i in range(self.hashes)])

    def passes(self, key: Column) -> Column:
        return F.forall(self._spots(key), lambda s: F.getbit(F.get(self.words, F.shiftright(s, 6).cast("int")), (s % 64).cast("int")) == 1)


def build(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """The cascade that separates listed keys from the other keys of the universe; both have a column key."""
    listed = listed.distinct()
    n = listed.count()
    # wrong keys of level 1: about as many as are listed
    share = max(1, universe.agg(F.approx_count_distinct("key")).first()[0]) / max(1, n)
    levels = [Level(listed, n, 0, max(HASHES, math.ceil(math.log2(share))))]
    # only false positives of level 1 go on; they are found once
    wrong, right = cut(universe.where(levels[0].passes(F.col("key"))).distinct().join(listed, "key", "left_anti")), listed
    while n := wrong.count():
        if len(levels) == MAX_LEVELS:
            raise ValueError("the cascade doesn't settle: two keys share all their hashes")
        level = Level(wrong, n, len(levels))
        levels.append(level)
        wrong, right = cut(right.where(level.passes(F.col("key")))), wrong
    return levels


def member(levels: list[Level], key: Column) -> Column:
    """Whether a key of the universe is listed: the first level that stops it tells which."""
    out = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        out = F.when(levels[i].passes(key), out).otherwise(F.lit(i % 2 == 1))
    return out


def candidate_keys(host: Column, path: Column, rules=RULES) -> Column:
    """Every key of a url that a rule could equal, longest first."""
    labels, lengths = max(len(h.split(".")) for _, h, _ in rules), sorted({len(p) for *_, p in rules})
    parts = F.split(host, r"\.")
    tails = [F.when(F.size(parts) >= k, F.array_join(F.slice(parts, -k, k), ".")) for k in range(1, labels + 1)]
    heads = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]
    keys = F.array_compact(F.array(*[F.concat(t, h) for t in tails for h in heads]))
    return F.reverse(F.array_sort(F.transform(keys, lambda k: F.struct(F.length(k).alias("length"), k.alias("key")))))


def host_words(host: Column) -> Column:
    return F.transform(F.filter(F.split(host, "[.-]"), lambda w: w != ""), lambda w: F.concat(F.lit("word:"), w))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, words=HOST_WORDS, default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    spark = pages.sparkSession
    host, path = split_url(F.col(url_col))
    split = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    keyed = split.select("*", F.transform(candidate_keys(F.col("host"), F.col("path"), rules), lambda x: x["key"]).alias("keys"), host_words(F.col("host")).alias("words"))
    universe = keyed.select(F.explode(F.array_distinct(F.concat("keys", "words"))).alias("key"))
    # two cascades: every listed key and word; of the rules the allowing ones
    keys = lambda which: spark.createDataFrame([(k,) for k in which], "key string").coalesce(1)
    every = build(keys([h + p for _, h, p in rules] + [f"word:{w}" for w in words]), universe)
    allowing = build(keys([h + p for v, h, p in rules if v == "allow"]), keys([h + p for v, h, p in rules if v != "allow"]))
    fits = F.filter("keys", lambda k: member(every, k))
    ruled = keyed.select("page_id", "host", "path", F.get(fits, F.lit(0)).alias("rule"), F.exists("words", lambda w: member(every, w)).alias("worded"))
    verdict = F.when(F.col("rule").isNotNull(), F.when(member(allowing, F.col("rule")), F.lit("allow")).otherwise(F.lit("block"))).when(F.col("worded"), F.lit("block")).otherwise(F.lit(default))
    return ruled.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op6_url_filter(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def oracle() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    words = ", ".join(f"'{w}'" for w in HOST_WORDS)
    return f"""
WITH rules(v, h, p) AS (VALUES {rules}),
u AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages),
s AS (SELECT r, page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
f AS (SELECT r, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v FROM s JOIN rules
      ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, rule,
  coalesce(v, CASE WHEN len(list_filter(regexp_split_to_array(host, '[.-]'), lambda w: w IN ({words}))) > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM s LEFT JOIN f USING (r)"""
