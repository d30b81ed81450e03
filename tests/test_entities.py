"""Entities, relations and pronouns on small texts, and the queries against DuckDB on a small table."""

import itertools
import os
import random
import re

import duckdb
import pytest

from gleaner.functions.shared import cut
from gleaner.jobs import entities as jobs
from gleaner.operators import entities
from tests.test_knowledge import DATA, _rows


@pytest.mark.parametrize("name", sorted(jobs.QUERIES))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    got, want = jobs.QUERIES[name](spark, DATA).toPandas(), con.execute(jobs.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and _rows(got) == _rows(want)


def _found(spark, texts):
    docs = cut(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    split = entities.sentences(docs)
    names = cut(entities.name_words(split))
    known = cut(entities.phrases(names, 2, 0.5))
    return docs, split, known, cut(entities.intervals(names, known))


def test_phrases_and_types(spark):
    texts = ["We met Ada Lovelace King, then Ada Lovelace King left", "Ada Lovelace wrote. Lovelace, Ada", "Bob sat; Mount Etna in 1999", None, "", "Alpha Beta Gamma Delta Eps Zeta and Alpha Beta Gamma Delta Eps Zeta"]
    docs, _, known, found = _found(spark, texts)
    assert {("Ada", "Lovelace"), ("Lovelace", "King"), ("Eps", "Zeta")} <= {(r.x, r.y) for r in known.collect()}
    assert {(r.doc_id, r.sentence, r.start, r.stop, r.entity) for r in found.where("source = 'phrase'").collect()} == {(0, 0, 2, 5, "Ada Lovelace King"), (0, 0, 7, 10, "Ada Lovelace King"), (1, 0, 0, 2, "Ada Lovelace")}
    got = {(r.doc_id, r.entity): (r.type, r.source, r.confidence, r.n) for r in entities.typed(docs, found).collect()}
    assert got[0, "ada lovelace king"] == ("COMPOUND", "phrase", 0.9, 2) and got[1, "lovelace"] == ("NAME", "name", 0.7, 1)
    assert got[2, "1999"] == ("YEAR", "pattern", 0.8, 1) and got[2, "mount etna"] == ("MOUNTAIN", "pattern", 0.8, 1)
    assert got[5, "zeta"] == ("NAME", "name", 0.7, 2)  # a run of six words is no entity


def _brute(docs, found, phrases, across):
    """Every pair of names of a sentence and every place of every phrase."""
    words = {(r.doc_id, k): re.findall(r"[^\W\d_]+|[^\w\s]+|\d+", s) for r in docs for k, s in enumerate(re.split(r"[.!?\n]+", r.text or ""))}
    out = {}
    by = {}
    for r in found:
        by.setdefault((r.doc_id, r.sentence), []).append((r.start, r.stop, r.entity.lower()))
    for key, names in by.items():
        low = [w.lower() for w in words[key]]
        pairs = set()
        for (a, a_end, x), (b, _, y) in itertools.permutations(names, 2):
            for relation, forth, phrase in phrases:
                p = phrase.split()
                at = [i for i in range(len(low)) if low[i : i + len(p)] == p]
                if x != y and any((a_end <= i and i + len(p) <= b) if across else (a_end == i and i + len(p) == b) for i in at):
                    pairs.add((x, y, relation) if forth else (y, x, relation))
        for pair in pairs:
            out.setdefault(pair, []).append(key[0])
    return {(*k, len(v), min(v)) for k, v in out.items()}


def test_relations_between_all_names(spark):
    rng = random.Random(4)
    pool = ["Ann", "Bea", "Cyd", "Dan", "Eli", "works", "for", "in", "is", "a", "the", "part", "of", "contains", "founded", "by", "father", "and", "married", ",", "was", "born"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(1, 25))) + rng.choice(["", ".", "\n"]) + " Ann is Bea" for _ in range(60)] + [None, ""]
    texts += ["Ann was born in Bea", "Cyd contains Dan", "Eli is the father of Ann", "Bea was the daughter of Cyd; Ann married Dan", "Dan conquered Eli", "Cyd was ruled by Bea", "Ann is known as Dan"]
    docs, split, _, found = _found(spark, texts)
    rows = lambda df: {(r.source, r.target, r.relation, r.n, r.first_doc) for r in df.collect()}
    across = rows(entities.related_across(found, cut(entities.triggers(split, entities.ACROSS))))
    assert across == _brute(docs.collect(), found.collect(), entities.ACROSS, True) and len(across) > 50
    direct = rows(entities.related_directly(found, entities.triggers(split, entities.DIRECT)))
    assert direct == _brute(docs.collect(), found.collect(), entities.DIRECT, False) and len(direct) > 10


def test_long_sentence_stays_small(spark):
    """20,000 places of a phrase between 20,000 places of few names: work goes by names and phrases, not by their pairs."""
    _, split, _, found = _found(spark, [" ".join(f"{'Ann' if i % 2 else 'Bob'} works for" for i in range(20_000))])
    got = {(r.source, r.target, r.relation, r.n) for r in entities.related_across(found, cut(entities.triggers(split, entities.ACROSS))).collect()}
    assert got == {("ann", "bob", "WORKS_FOR", 1), ("bob", "ann", "WORKS_FOR", 1)}


def test_pronouns_follow_conversations(spark):
    turns = [(1, 0, "Who saw Ann? She ran. Bob followed her"), (1, 1, None), (1, 2, "they met, and he left Cyd with his"), (2, 0, "he knows nobody"), (2, 1, ""), (3, 5, "The end of it")]
    got = [(r.conv_id, r.turn, r.sentence, r.pos, r.pronoun, r.entity) for r in entities.resolved(spark.createDataFrame(turns, "conv_id long, turn long, text string")).collect()]
    assert sorted(got) == [(1, 0, 0, 0, "Who", None), (1, 0, 1, 0, "She", "Ann"), (1, 0, 2, 2, "her", "Bob"), (1, 2, 0, 0, "they", "Bob"), (1, 2, 0, 4, "he", "Bob"), (1, 2, 0, 8, "his", "Cyd"), (2, 0, 0, 0, "he", None)]


def test_pronouns_in_a_long_conversation(spark):
    turns = spark.range(100_000).selectExpr("1L as conv_id", "id as turn", "case when id % 1000 = 0 then concat('Name', chr(cast(97 + id / 1000 % 26 as int)), ' spoke') else 'and he went' end as text")
    got = entities.resolved(turns)
    assert got.count() == 99_900 and got.where("turn = 1999").first().entity == "Nameb"
