"""Licence scan by diagonal voting.

Every two-word gram of every document is hashed and joined to the gram positions of the
licence templates. A hit at word p that matches offset o of a template votes for the
diagonal p - o. A full diagonal is a verbatim place. For longer notices each diagonal is also
merged with its neighbours, up to SLACK further on (more for long templates), so that a few
inserted or lost words don't hide a notice; what a merge can reach is at most the template's
length and that slack, so a far or repeated place never spoils a near one. Each hit is checked
on the words themselves, so hash collisions don't count.

A notice counts from a share of its telling grams. Grams that tell it from its relatives (its
version, its "nc") must all be among them. Templates of over 64 words are cut into parts that
vote on their own; their votes add up.

Null texts count as empty; null ids are kept; repeated rows each give a row; an empty table
gives an empty result; equal places of two templates each give their label; only the id and text
columns are read, so other columns can't clash. Very long texts are one array of words inside a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm.common import LOWER, UPPER, letter_words, with_row

#: Phrase and label.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
#: Longer notices, matched approximately: words, label, grams that must be there.
NOTICES = [
    ("licensed under the gnu general public license version 3", "gpl-3.0", ["license version", "version 3"]),
    ("licensed under the apache license version 2 0", "apache-2.0", ["version 2", "2 0"]),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0", ["by nc", "nc 4", "4 0"]),
    ("licensed under cc by 4 0", "cc-by-4.0", ["by 4", "4 0"]),
    ("released under the mit license", "mit-release", ["mit license"]),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-text", []),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd-text", []),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-header", []),
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl-header", []),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other "
        "liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "mit-full",
        [],
    ),
]
#: A gram of two of these words says nothing about a licence.
COMMON = ["the", "of", "and", "in", "to", "a", "is", "it", "or", "any", "this", "for", "with", "by", "that", "are", "as", "at", "not", "may", "you", "can", "under", "use"]
#: Diagonals this close are merged; so are, for templates of LONG words or more, those within LONG_SLACK. A notice counts from this share of its grams.
SLACK, LONG, LONG_SLACK, COVERAGE = 3, 16, 8, 0.75
#: Words of a template's part at most: a bit of a mask each.
PART = 64


def template_grams(phrases=PHRASES, notices=NOTICES) -> list[tuple]:
    """(notice, part, label, is_base, n_grams of the notice, need: mask of the part, long, offset, first, second) for each telling gram; a constant table."""
    rows = []
    for i, (text, label, needs) in enumerate([*((p, x, []) for p, x in phrases), *notices]):
        words, base = text.split(), i < len(phrases)
        grams = [(o, a, b) for o, (a, b) in enumerate(zip(words, words[1:])) if base or a not in COMMON or b not in COMMON]
        missing = set(needs) - {f"{a} {b}" for _, a, b in grams}
        if not grams or missing or ((base or needs) and len(words) > PART):
            raise ValueError(f"a template needs a telling gram, its needs among them, and phrases and needs {PART} words at most: {text[:80]!r}")
        size = -(-len(words) // -(-len(words) // PART))  # parts of even length
        need = sum(1 << o for o, a, b in grams if f"{a} {b}" in needs)
        rows += [(i, o // size, label, base, len(grams), need, min(len(words), size) >= LONG, o % size, a, b) for o, a, b in grams]
    return rows


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score, and n_notices (how many of the longer notices it has).

    score: the best share of a template's telling grams among what was found, 0 if nothing was.
    """
    spark = docs.sparkSession
    schema = "notice int, part int, label string, base boolean, n_grams int, need long, long boolean, offset int, t_first string, t_second string"
    grams = spark.createDataFrame(template_grams(phrases, notices), schema).withColumn("t_hash", F.xxhash64("t_first", "t_second"))
    words = with_row(docs.select(F.col(id_col).alias("doc_id"), letter_words(F.col(text_col)).alias("words")))
    pairs = words.select("_row", "doc_id", F.size("words").cast("long").alias("n_words"), F.posexplode_outer(F.arrays_zip(F.col("words").alias("a"), F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))).alias("b"))).alias("pos", "gram"))
    hashed = pairs.select("_row", "doc_id", "n_words", "pos", F.col("gram.a").alias("first"), F.col("gram.b").alias("second"))
    of_part = ["_row", "doc_id", "n_words", "notice", "part", "label", "base", "n_grams", "need", "long"]
    # the template grams are a constant of a few hundred rows, whatever the corpus
    hits = (
        hashed.join(F.broadcast(grams), (F.xxhash64("first", "second") == F.col("t_hash")) & (F.col("first") == F.col("t_first")) & (F.col("second") == F.col("t_second")), "left")
        .where("notice is not null or pos is null or pos = 0")
        .select(*of_part, "pos", "offset", (F.col("pos") - F.col("offset")).alias("diagonal"))
        .repartition("_row")
    )
    diagonals = hits.groupBy(*of_part, "diagonal").agg(F.expr("bit_or(shiftleft(1L, coalesce(offset, 0)))").alias("mask"), F.min("pos").alias("low"))
    order = W.partitionBy(*of_part).orderBy("diagonal")
    onward = lambda n: F.bit_or("mask").over(order.rangeBetween(0, n))
    merged = diagonals.withColumns({"near": onward(SLACK), "far": onward(LONG_SLACK)})
    votes = lambda m: F.when(m.bitwiseAND(F.col("need")) == F.col("need"), F.bit_count(m)).otherwise(0)
    best = F.greatest(votes(F.col("mask")), votes(F.col("near")), F.when(F.col("long"), votes(F.col("far"))).otherwise(0))
    full = F.col("base") & (F.bit_count("mask") == F.col("n_grams"))
    parts = merged.groupBy(*of_part).agg(
        F.max(best).alias("votes"), F.count_if(full).alias("n_full"), F.min(F.when(full, F.col("low"))).alias("first"), F.max(F.when(full, F.col("low"))).alias("last")
    )
    whole = parts.groupBy("_row", "doc_id", "n_words", "notice", "label", "base", "n_grams").agg(
        (F.sum("votes") / F.col("n_grams")).alias("share"), F.sum("n_full").alias("n_full"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    found = F.col("notice").isNotNull() & F.when(F.col("base"), F.col("n_full") > 0).otherwise(F.col("share") >= COVERAGE)
    places = whole.withColumn("found", found)
    is_base = F.col("found") & F.col("base")
    labels = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")  # noqa: E731  at most one label per template
    return places.groupBy("_row", "doc_id", "n_words").agg(
        F.sum(F.when(is_base, F.col("n_full")).otherwise(0)).alias("n_base"),
        F.min(F.when(is_base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("last"))).cast("long").alias("last_word"),
        labels(is_base).alias("base_labels"),
        labels(F.col("found")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("found"), F.when(F.col("base"), F.lit(1.0)).otherwise(F.col("share")))), F.lit(0.0)).alias("score"),
        F.count_if(F.col("found") & ~F.col("base")).alias("n_notices"),
    ).drop("_row")


def op1_license_scan(spark, sf_dir):
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    values = ",\n".join(f"({t}, {part}, '{label}', {str(base).lower()}, {n}, {need}, {str(long).lower()}, {o}, '{a}', '{b}')" for t, part, label, base, n, need, long, o, a, b in template_grams())
    votes = lambda m: f"CASE WHEN {m} & need = need THEN bit_count({m}) ELSE 0 END"
    return f"""
WITH grams(notice, part, label, base, n_grams, need, long, offs, a, b) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT r, unnest(range(1, len(w))) AS i, w FROM d),
hits AS (SELECT r, i - 1 AS pos, g.*, i - 1 - offs AS diag FROM p JOIN grams g ON w[i] = g.a AND w[i + 1] = g.b),
diags AS (SELECT r, notice, part, label, base, n_grams, need::BIGINT AS need, long, diag, bit_or(1::BIGINT << offs) AS mask, min(pos) AS low
          FROM hits GROUP BY ALL),
merged AS (SELECT *, bit_or(mask) OVER (x RANGE BETWEEN CURRENT ROW AND {SLACK} FOLLOWING) AS near, bit_or(mask) OVER (x RANGE BETWEEN CURRENT ROW AND {LONG_SLACK} FOLLOWING) AS far
          FROM diags WINDOW x AS (PARTITION BY r, notice, part ORDER BY diag)),
parts AS (SELECT r, notice, part, label, base, n_grams,
            max(greatest({votes("mask")}, {votes("near")}, CASE WHEN long THEN {votes("far")} ELSE 0 END)) AS votes,
            count(*) FILTER (base AND bit_count(mask) = n_grams) AS n_full,
            min(low) FILTER (base AND bit_count(mask) = n_grams) AS first, max(low) FILTER (base AND bit_count(mask) = n_grams) AS last
          FROM merged GROUP BY ALL),
found AS (SELECT r, label, base, sum(votes) / n_grams AS share, sum(n_full) AS n_full, min(first) AS first, max(last) AS last
          FROM parts GROUP BY r, notice, label, base, n_grams
          HAVING CASE WHEN base THEN sum(n_full) > 0 ELSE sum(votes) / n_grams >= {COVERAGE} END)
SELECT d.doc_id, len(any_value(d.w))::BIGINT AS n_words,
  coalesce(sum(n_full) FILTER (base), 0)::BIGINT AS n_base,
  min(first)::BIGINT AS first_word, max(last)::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (label IS NOT NULL)), ','), '') AS labels,
  coalesce(max(CASE WHEN base THEN 1.0 ELSE share END), 0.0)::DOUBLE AS score,
  count(*) FILTER (NOT base)::BIGINT AS n_notices
FROM d LEFT JOIN found USING (r) GROUP BY r, d.doc_id"""
