"""Text expressions: all built-in functions, so they stay in generated code."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: letters, digits and underscores of any script.
WORD = r"[\p{L}\p{N}_]+"
STOP_WORDS = ["the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "is", "was", "with", "as", "by", "at", "it", "that"]


def tokens(text: Column) -> Column:
    """Lower-cased words in order; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def normalized(text: Column) -> Column:
    """Lower-cased, punctuation dropped, blanks squeezed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"[^\p{{L}}\p{{N}}_]+", " "))


def preview(text: Column, size: int = 200) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def overlap(a: Column, b: Column) -> Column:
    """Share of a's distinct items that b has; 0 for an empty a."""
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_distinct(a)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    return F.when(F.size(F.array_union(a, b)) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def keywords(text: Column) -> Column:
    """Distinct words over three letters that aren't stop words, in order."""
    return F.array_distinct(F.filter(tokens(text), lambda w: (F.length(w) > 3) & ~w.isin(STOP_WORDS)))


def question_type(text: Column) -> Column:
    low = F.lower(F.trim(text))
    out = F.lit("general")
    for word in reversed(["who", "what", "where", "when", "why", "how"]):
        out = F.when(low.startswith(word), F.lit(word)).otherwise(out)
    return F.when(F.rlike(low, F.lit(r"compare|versus|\bvs\b")), F.lit("comparison")).otherwise(out)
