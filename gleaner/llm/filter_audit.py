"""Interaction audit of document filters.

Spark reduces the documents to counts by part and by which of the five filters they fail: 32 cells a
part, each with all documents, those labelled good and those labelled toxic. A part's cells are a
2x2x2x2x2 tensor (0: passes, 1: fails) for each of the three counts. For every order of the filters
and every step, one selector an axis (pass, fail or all) contracts the tensor to a figure by einsum.

Null texts count as empty; null sources are the part of the empty string. A document repeats another
one if its id is larger than the smallest id of that text; null ids repeat nothing and are repeated
by nothing, and rows of the same smallest id all pass. A document with several label rows is good
(toxic) if one of them says so; null ids have no labels. An empty table gives an empty result.
Only doc_id, text and source are read, so other columns can't clash. Texts of any length are taken whole.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import UPPER, plain_words, table

FILTERS = "ABCDE"
#: Thresholds of the filters A (words), B (percent of distinct words), C (percent of capitals), and the characters of D.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 2, "#$%&*|"
MEASURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)


def failures(text: Column) -> Column:
    """The bits of the filters A to D that a text fails; A is bit 0."""
    words, n_chars = plain_words(text), F.length(text)
    capitals = n_chars - F.length(F.translate(text, UPPER, ""))
    # the words are bound once, as each condition would split the text again
    of_words = F.aggregate(
        F.array(words), F.lit(0), lambda _, w: (F.size(w) < LEAST_WORDS).cast("int") + 2 * (100 * F.size(F.array_distinct(w)).cast("long") < LEAST_DISTINCT * F.size(w).cast("long")).cast("int")
    )
    return of_words + 4 * (100 * capitals.cast("long") > MOST_CAPITALS * n_chars.cast("long")).cast("int") + 8 * (n_chars > F.length(F.translate(text, SYMBOLS, ""))).cast("int")


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, cell, n, good, toxic): documents by the bits of the filters that they fail; the counts add up over parts and files.

    Rows leave the scan without their texts. Copies of a text share all bits but the last, so they are counted
    by text, part and labels before the smallest id of the text is known.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.sha2(text, 256).alias("same"), failures(text).alias("bits"))
    told = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = narrow.join(told, "doc_id", "left").select("doc_id", "part", "same", "bits", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    kind = ["same", "bits", "part", "good", "toxic"]
    by_id = marked.groupBy(*kind, "doc_id").agg(F.count("*").alias("n"))
    by_kind = by_id.groupBy(*kind).agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.coalesce(F.min_by("n", "doc_id"), F.lit(0)).alias("n_least"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("n_null"))
    first = by_kind.groupBy("same").agg(F.min("least").alias("first"))
    passing = F.col("n_null") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    split = by_kind.join(first, "same").select("part", "good", "toxic", F.inline(F.array(F.struct(F.col("bits").alias("cell"), passing.alias("n")), F.struct((F.col("bits") + 16).alias("cell"), (F.col("n") - passing).alias("n")))))
    return split.where("n > 0").groupBy("part", "cell").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def selectors() -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """The rows (order, step), and for each kind of figure a selector for each row and axis."""
    rows, kinds = [], {"kept": [], "removed": [], "failed": [], "only": []}
    for order in permutations(FILTERS):
        for step, name in enumerate(order):
            rows.append(("".join(order), step + 1))
            before = set(order[:step])
            kinds["kept"].append([PASS if f in before or f == name else ALL for f in FILTERS])
            kinds["removed"].append([PASS if f in before else FAIL if f == name else ALL for f in FILTERS])
            kinds["failed"].append([FAIL if f == name else ALL for f in FILTERS])
            kinds["only"].append([FAIL if f == name else PASS for f in FILTERS])
    return rows, {k: np.array(v, np.int64) for k, v in kinds.items()}


def contract(counts: np.ndarray) -> pd.DataFrame:
    """counts: (3, 2, 2, 2, 2, 2), of all, good and toxic documents; a row for each order and step."""
    rows, kinds = selectors()
    pick = lambda kind: np.einsum("mabcde,za,zb,zc,zd,ze->zm", counts, *(kinds[kind][:, axis] for axis in range(5)))
    kept, removed, failed, only = pick("kept"), pick("removed"), pick("failed"), pick("only")
    out = pd.DataFrame(rows, columns=["filter_order", "step"])
    out["kept"], out["removed"], out["redundant"], out["unique_fails"] = kept[:, 0], removed[:, 0], failed[:, 0] - removed[:, 0], only[:, 0]
    out["good_lost"], out["toxic_lost"] = removed[:, 1], removed[:, 2]
    letter = [order[step - 1] for order, step in rows]
    out["shapley"] = out.groupby(letter)["removed"].transform("sum")
    return out


def audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """600 rows a part: part, filter_order, step and the figures of MEASURES."""

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((3, 32), np.int64)
        at = cell["cell"].to_numpy(np.int64)
        for m, name in enumerate(("n", "good", "toxic")):
            counts[m, at] = cell[name].to_numpy(np.int64)
        # bit 0 is filter A, the fastest axis of the flat cells, so the axes are turned round
        tensor = counts.reshape(3, *[2] * 5).transpose(0, 5, 4, 3, 2, 1)
        out = contract(tensor)
        out.insert(0, "part", cell["part"].iloc[0])
        return out

    return cells(docs, labels, **columns).groupBy("part").applyInPandas(run, "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES))


def op12_filter_audit(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def oracle() -> str:
    letters = "(VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16))"
    bit = lambda c: f"(1 << (ascii({c}) - 65))"
    return f"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
first AS (SELECT text, min(doc_id) AS id FROM t GROUP BY text),
lab AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
cell AS (SELECT part, (len(w) < {LEAST_WORDS})::INT + 2 * (100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w))::INT
    + 4 * (100 * (length(text) - length(translate(text, '{UPPER}', ''))) > {MOST_CAPITALS} * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(t.doc_id > first.id, false)::INT AS c,
    count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM t JOIN first USING (text) LEFT JOIN lab ON t.doc_id = lab.doc_id GROUP BY ALL),
l(f, b) AS {letters},
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM l a, l b, l c, l d, l e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND a.b | b.b | c.b | d.b | e.b = 31),
steps AS (SELECT filter_order, step::INT AS step, {bit("filter_order[step]")} AS own, list_sum(list_transform(range(1, step), lambda i: {bit("filter_order[i]")})) AS earlier FROM orders, range(1, 6) r(step)),
each AS (SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (c & (coalesce(earlier, 0)::INT | own) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (c & own > 0 AND c & coalesce(earlier, 0)::INT = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (c & own > 0 AND c & coalesce(earlier, 0)::INT > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (c = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (c & own > 0 AND c & coalesce(earlier, 0)::INT = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (c & own > 0 AND c & coalesce(earlier, 0)::INT = 0), 0)::BIGINT AS toxic_lost
  FROM cell, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM each"""
