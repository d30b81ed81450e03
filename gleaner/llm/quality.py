"""Quality rules with a distribution-divergence verdict.

Each text is reduced to two histograms: character classes, and the most common words of each
reference language. The Jensen-Shannon distance (base 2, 0 to 1) to the nearest language
reference is the verdict's measure; texts under a minimum length are too noisy to compare, and
texts with many letters of another script than the references' have nothing to be compared
with, so for both the verdict abstains and only the base rules speak.

Everything stays inside one row: no shuffle, no Python. Null texts count as no words (and fail
the base rule of ten words); null ids are kept; repeated rows each give a row; an empty table
gives an empty result; texts of any length are judged whole; a text as near to two languages as
to one gets that distance; columns other than id and text aren't read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import LOWER, UPPER, plain_words, with_row

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Base rule: at least this many words, and at most this percentage of them in repeated windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Histograms of fewer characters or words than these aren't judged.
MIN_CHARS_JUDGED, MIN_WORDS_JUDGED = 200, 60
#: Nor are texts of which more than this percentage of the word characters are letters of a script without a reference.
MAX_FOREIGN_PERCENT = 30
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.27
CLASSES = ["lower", "space", "upper", "digit", "other", "symbol", "punctuation"]
#: Share of each character class in running prose (in the order of CLASSES).
CHAR_REFERENCES = {
    "en": [0.795, 0.165, 0.015, 0.001, 0.0, 0.0, 0.024],
    "de": [0.775, 0.150, 0.020, 0.001, 0.032, 0.0, 0.022],
    "fr": [0.735, 0.165, 0.012, 0.001, 0.063, 0.0, 0.024],
    "es": [0.745, 0.160, 0.012, 0.001, 0.059, 0.0, 0.023],
}
#: The commonest words of running prose and their shares.
WORD_REFERENCES = {
    "en": {"the": 0.055, "of": 0.029, "and": 0.024, "to": 0.019, "a": 0.016, "in": 0.014, "is": 0.010, "that": 0.009},
    "de": {"der": 0.045, "die": 0.030, "und": 0.025, "in": 0.017, "den": 0.013, "von": 0.011, "zu": 0.010, "das": 0.010},
    "fr": {"de": 0.053, "la": 0.030, "le": 0.023, "et": 0.019, "les": 0.016, "des": 0.014, "en": 0.012, "un": 0.010},
    "es": {"de": 0.055, "la": 0.030, "que": 0.025, "el": 0.021, "en": 0.018, "y": 0.016, "los": 0.012, "se": 0.010},
}
_WORDS = sorted({w for ref in WORD_REFERENCES.values() for w in ref})


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def jensen_shannon(p: Column, reference: list[float]) -> Column:
    """Distance of a histogram (array of shares) to a constant one."""
    q = F.array(*map(F.lit, reference))
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def repeated_window_words(grams: Column, sorted_grams: Column, size: int = WINDOW) -> Column:
    """Number of words inside windows whose hash occurs twice or more.

    grams: hashes of all windows by position; sorted_grams: (hash, position) in order. Marked
    positions are put in order, and each covers the words up to the next marked one, five at most.
    """
    n = F.size(sorted_grams)
    same = lambda x, i: ((i > 0) & (F.get(sorted_grams, i - 1)["h"] == x["h"])) | ((i < n - 1) & (F.get(sorted_grams, i + 1)["h"] == x["h"]))
    marked = F.sort_array(F.transform(F.filter(sorted_grams, same), lambda x: x["i"]))
    walked = F.aggregate(
        marked,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-size).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(size), i - s["last"]) * (s["last"] >= 0).cast("long")).alias("n"), i.alias("last")),
        lambda s: s["n"] + F.when(s["last"] >= 0, F.lit(size)).otherwise(F.lit(0)),
    )
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(walked)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per document: the base measures, base_failed, kept, and the two distances (null where the guard applies).

    keep: names of input columns to carry along instead of the id alone.
    """
    carried = F.struct(*([F.col(c) for c in keep] if keep is not None else [F.col(id_col).alias("doc_id")])).alias("carried")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(carried, text.alias("text"), plain_words(F.col(text_col)).alias("words"))
    variants = [v for w in _WORDS for v in dict.fromkeys((w, w.capitalize(), w.upper()))]
    n = F.size("words")
    base = base.select(
        "carried", "text", "words",
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>")).alias("grams"),
        F.transform(F.filter("words", lambda w: w.isin(variants)), F.lower).alias("common"),
        # what is left without lower-case runs and white space holds every other class
        F.regexp_replace("text", r"[a-z\x20\x09-\x0D]++", "").alias("rest"),
    )
    base = base.withColumn("sorted", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, "\t\n\x0b\x0c\r ", "")) > 0)
    measured = base.select(
        "carried", "common",
        F.size("words").cast("long").alias("n_words"),
        F.coalesce(F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + F.length(w)), F.lit(0)).alias("word_chars"),
        _count(F.col("rest"), SYMBOLS).cast("long").alias("n_symbols"),
        F.length("text").alias("n_chars"), F.length("rest").alias("n_rest"),
        _count(F.col("rest"), UPPER).alias("upper"), _count(F.col("rest"), "0123456789").alias("digit"),
        F.regexp_replace("rest", r"[\x00-\x7F]++", "").alias("beyond"),
        lines.alias("lines"),
        F.coalesce(repeated_window_words(F.col("grams"), F.col("sorted")), F.lit(0).cast("long")).alias("n_repeat_words"),
    )
    # letters that aren't Latin; most texts have few characters beyond ASCII to look at
    foreign = F.when(F.col("beyond") == "", F.lit(0)).otherwise(F.length(F.regexp_replace("beyond", r"[^\p{L}]|\p{IsLatin}", "")))
    measured = measured.select("*", F.length("beyond").alias("other"), foreign.alias("foreign")).drop("beyond")
    space = F.col("n_chars") - F.col("word_chars")
    counts = {"lower": F.col("n_chars") - F.col("n_rest") - space, "space": space, "upper": F.col("upper"), "digit": F.col("digit"), "other": F.col("other"), "symbol": F.col("n_symbols")}
    counts["punctuation"] = F.col("n_rest") - F.col("upper") - F.col("digit") - F.col("other") - F.col("n_symbols")
    measured = measured.select(
        "carried", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        ((F.col("n_chars") >= MIN_CHARS_JUDGED) & (F.col("n_words") >= MIN_WORDS_JUDGED) & (100 * F.col("foreign") <= MAX_FOREIGN_PERCENT * F.col("word_chars"))).alias("judged"),
        F.array(*[counts[c] / F.greatest(F.col("n_chars"), F.lit(1)) for c in CLASSES]).alias("classes"),
        # one expression for all words: a loop instead of as many copies of it in the compiled stage
        F.transform(F.array(*map(F.lit, _WORDS)), lambda w: F.size("common") - F.size(F.array_remove("common", w))).alias("times"),
    )
    nearest = lambda parts: F.round(reduce(F.least, parts) if len(parts) == 1 else F.least(*parts), 6)
    char_distance = nearest([jensen_shannon(F.col("classes"), ref) for ref in CHAR_REFERENCES.values()])
    words = []
    for ref in WORD_REFERENCES.values():
        own = [F.get("times", F.lit(_WORDS.index(w))) for w in ref]
        shares = F.array(*[c / F.greatest(F.col("n_words"), F.lit(1)) for c in [*own, F.col("n_words") - sum(own[1:], own[0])]])
        words.append(jensen_shannon(shares, [*ref.values(), 1 - sum(ref.values())]))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    verdict = measured.select(
        "carried.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.when(F.col("judged"), char_distance).alias("char_distance"), F.when(F.col("judged"), nearest(words)).alias("word_distance"),
    ) if keep is None else measured.select("carried", failed.alias("base_failed"), F.when(F.col("judged"), char_distance).alias("char_distance"), F.when(F.col("judged"), nearest(words)).alias("word_distance"))
    good = (F.coalesce(F.col("char_distance"), F.lit(0.0)) <= MAX_CHAR_DISTANCE) & (F.coalesce(F.col("word_distance"), F.lit(0.0)) <= MAX_WORD_DISTANCE)
    return verdict.withColumn("kept", ~F.col("base_failed") & good)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that pass, with all their columns."""
    # a row number in the filter keeps the optimizer from copying the whole verdict below the projections
    judged = with_row(judge(docs, text_col=text_col, keep=docs.columns))
    return judged.where(F.col("kept") & (F.col("_row") >= 0)).select("carried.*")


def op3_quality_rules(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    def js(shares: list[str], ref: list[float]) -> str:
        terms = [f"(CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q!r}) / 2)) ELSE 0 END + " + (f"{q!r} * log2({q!r} / (({p} + {q!r}) / 2))" if q > 0 else "0") + ")" for p, q in zip(shares, ref)]
        return f"sqrt(greatest(({' + '.join(terms)}) / 2, 0.0))"

    def count(chars: str) -> str:
        return f"(length(t) - length(translate(t, '{chars}', '')))"

    cls = ["c_lower", "c_space", "c_upper", "c_digit", "c_other", "c_symbol", "c_punct"]
    char = ", ".join(js([f"({c} / greatest(n_chars, 1)::DOUBLE)" for c in cls], ref) for ref in CHAR_REFERENCES.values())
    word = []
    for ref in WORD_REFERENCES.values():
        own = [f"len(list_filter(lw, lambda x: x = '{w}'))" for w in ref]
        shares = [f"({c} / greatest(n_words, 1)::DOUBLE)" for c in [*own, f"(n_words - {' - '.join(own)})"]]
        word.append(js(shares, [*ref.values(), 1 - sum(ref.values())]))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i+4], ' ') AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM m) GROUP BY r),
b AS (SELECT r, doc_id, t, w, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(t)::BIGINT AS n_chars,
        {count(SYMBOLS)}::BIGINT AS n_symbols,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
        {count(UPPER)} AS c_upper, {count(LOWER)} AS c_lower, {count("0123456789")} AS c_digit,
        length(regexp_replace(t, '[\\x00-\\x7F]+', '', 'g')) AS c_other,
        length(regexp_replace(t, '[^\\p{{L}}]|\\p{{Latin}}', '', 'g')) AS c_foreign
      FROM d),
c AS (SELECT *, n_chars - word_chars AS c_space, n_symbols AS c_symbol, n_chars - (n_chars - word_chars) - c_upper - c_lower - c_digit - c_other - n_symbols AS c_punct,
        list_transform(list_filter(w, lambda x: x IN ({", ".join(f"'{v}'" for w in _WORDS for v in dict.fromkeys((w, w.capitalize(), w.upper())))})), lambda x: lower(x)) AS lw,
        (n_chars >= {MIN_CHARS_JUDGED} AND n_words >= {MIN_WORDS_JUDGED} AND 100 * c_foreign <= {MAX_FOREIGN_PERCENT} * word_chars) AS judged FROM b),
v AS (SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
        CASE WHEN judged THEN round(least({char}), 6) END AS char_distance,
        CASE WHEN judged THEN round(least({", ".join(word)}), 6) END AS word_distance
      FROM c LEFT JOIN rep USING (r))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
    AND coalesce(char_distance, 0) <= {MAX_CHAR_DISTANCE} AND coalesce(word_distance, 0) <= {MAX_WORD_DISTANCE} AS kept
FROM v"""
