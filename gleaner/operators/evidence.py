"""Evidence for answers: scored sentences of a text, joined with their neighbours into spans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import tokens

#: Words that don't count, shares of the answer's and of the query's words, scores that make and that extend a span, spans tried, characters of a sentence and of a span.
STOPS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by"]
OF_ANSWER, OF_QUERY, MAKES, EXTENDS, MOST, SENTENCE, SPAN = 0.6, 0.4, 0.3, 0.4, 5, 10, (10, 200)


def _words(text: Column) -> Column:
    return F.array_except(F.array_distinct(tokens(text)), F.array(*map(F.lit, STOPS)))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def merged_spans(rows: DataFrame, *keys: str, span: tuple[int, int] = SPAN) -> DataFrame:
    """(*keys, place, low, high, score): spans of sentences of an evidence that speak for an answer to a query. rows: keys, evidence, answer, query.

    The best sentences come first, the earlier one of equals. Each takes in its neighbours that score well and belong to no
    span yet; what a span has taken no later one may begin with, and spans that are too short or too long are left out. It
    is a fold over at most MOST sentences inside the row. Nulls count as empty.
    """
    whole = F.filter(F.transform(F.split(F.coalesce("evidence", F.lit("")), r"[.!?]+"), lambda s: F.trim(s)), lambda s: F.length(s) > SENTENCE)

    def score(words: Column, a: Column, q: Column) -> Column:
        share = lambda other: F.size(F.array_intersect(words, other)) / F.size(words)
        return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(F.round(OF_ANSWER * share(a) + OF_QUERY * share(q), 6))

    nothing = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<struct<low:int,high:int,score:double>>").alias("spans"))

    def spans(s: Column, scores: Column) -> Column:
        seeds = F.slice(F.array_sort(F.filter(F.transform(scores, lambda x, i: F.struct((-x).alias("less"), i.alias("at"))), lambda x: x["less"] < -MAKES)), 1, MOST)

        def step(so_far: Column, seed: Column) -> Column:
            at = seed["at"]
            free = lambda i: (F.coalesce(F.get(scores, i), F.lit(0.0)) > EXTENDS) & ~F.array_contains(so_far["used"], i)
            low, high = F.when((at > 0) & free(at - 1), at - 1).otherwise(at), F.when(free(at + 1), at + 1).otherwise(at)
            size = F.length(F.array_join(F.slice(s, low + 1, high - low + 1), " "))
            new = F.struct(F.concat(so_far["used"], F.sequence(low, high)).alias("used"), F.concat(so_far["spans"], F.array(F.struct(low.alias("low"), high.alias("high"), (-seed["less"]).alias("score")))).alias("spans"))
            return F.when(F.array_contains(so_far["used"], at) | ~size.between(*span), so_far).otherwise(new)

        return F.aggregate(seeds, nothing, step)["spans"]

    # each name stands for a value that is worked out once
    found = _let(F.struct(whole.alias("s"), _words(F.col("answer")).alias("a"), _words(F.col("query")).alias("q")), lambda x: _let(F.transform(x["s"], lambda y: _let(_words(y), lambda w: score(w, x["a"], x["q"]))), lambda scores: spans(x["s"], scores)))
    return rows.select(*keys, F.posexplode(found).alias("place", "span")).select(*keys, "place", "span.low", "span.high", "span.score")
