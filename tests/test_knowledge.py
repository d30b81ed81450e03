"""Relations, paths, components, stored indexes, and the queries of jobs/knowledge against DuckDB on a small table."""

import os

import duckdb
import pandas as pd
import pytest

from gleaner.jobs import knowledge
from gleaner.operators import insight, relations, rerank, sparse
from gleaner.sources import index

DATA = "/root/testdata/sf0.001"


def _rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    plain = lambda v: "null" if v is None or v != v else str(round(float(v), 6) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(knowledge.QUERIES))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    got, want = knowledge.QUERIES[name](spark, DATA).toPandas(), con.execute(knowledge.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and _rows(got) == _rows(want)


def test_typed_relations(spark):
    texts = ["Alice works for Initech. Initech hires Bob", "Paris in France; Europe contains Spain", "Rivers and Lakes", "The Company founded by Carol", None, ""]
    got = {(r.source, r.target, r.relation) for r in relations.typed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {("alice", "initech", "WORKS_FOR"), ("bob", "initech", "WORKS_FOR"), ("paris", "france", "LOCATED_IN"), ("spain", "europe", "LOCATED_IN"), ("spain", "europe", "PART_OF"), ("company", "carol", "FOUNDED_BY")}


def test_paths_are_shortest_and_directed(spark):
    e = spark.createDataFrame([("a", "b", "r"), ("b", "c", "s"), ("a", "c", "t"), ("c", "a", "u"), ("c", "d", "v"), ("d", "e", "w"), ("e", "f", "x"), ("a", "c", "q")], "source string, target string, relation string")
    got = {(r.node, r.hops, r.path, r.relations) for r in relations.paths(e, spark.createDataFrame([("a",)], "node string"), 3).collect()}
    assert got == {("b", 1, "a>b", "r"), ("c", 1, "a>c", "q"), ("d", 2, "a>c>d", "q>v"), ("e", 3, "a>c>d>e", "q>v>w")}


def test_components_of_a_chain(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}", "r") for i in range(60)] + [("x", "y", "r"), ("y", "x", "r"), ("z", "z", "r")]
    e = spark.createDataFrame(chain, "source string, target string, relation string")
    got = {r.node: r.component for r in relations.components(e).collect()}
    assert got == {**{f"n{i:03}": "n000" for i in range(61)}, "x": "x", "y": "x", "z": "z"}
    assert relations.components(e.limit(0)).count() == 0


def test_patterns_and_topics(spark):
    q = spark.createDataFrame([(1, "On 1/2/2024 Python took 5  million yoga"), (2, None), (3, "Mount Etna in 1999")], "qid long, query string")
    assert {(r.qid, r.entity, r.type) for r in relations.patterned(q).collect()} == {(1, "1/2/2024", "DATE"), (1, "2024", "YEAR"), (1, "Python", "TECHNOLOGY"), (1, "5 million", "QUANTITY"), (1, "yoga", "CONCEPT"), (3, "Mount Etna", "MOUNTAIN"), (3, "1999", "YEAR")}
    texts = spark.createDataFrame([("the latest is wrong and old",), (None,), ("better",)], "text string")
    assert {r.topic: r.n for r in insight.correction_topics(texts).collect()} == {"outdated": 2, "inaccurate": 1, "unclear": 1}


def test_similar_feedback_reaches_both_ways(spark):
    done = spark.createDataFrame([("x", 0.10, 1.0), ("x", 0.10, 3.0), ("x", 0.15, 5.0), ("x", 0.16, 9.0), ("y", 0.1, 2.0)], "strategy string, complexity double, score double")
    got = {(r.strategy, r.complexity): (r.n_similar, r.mean_score) for r in insight.similar_performance(done).collect()}
    assert got == {("x", 0.1): (3, 3.0), ("x", 0.15): (4, 4.5), ("x", 0.16): (2, 7.0), ("y", 0.1): (1, 2.0)}


def test_stored_indexes(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fish blue fish"), (2, "blue"), (3, None)], "doc_id long, text string")
    path = index.write_postings(docs, f"{tmp_path}/postings")
    index.write_postings(spark.createDataFrame([(4, "green fish")], "doc_id long, text string"), path, "append")
    assert {(r.term, r.df, r.cf) for r in index.term_statistics(spark, path).collect()} == {("red", 1, 1), ("fish", 2, 3), ("blue", 2, 2), ("green", 1, 1)}
    assert {(r.doc_id, r.tf) for r in index.read_postings(spark, path, ["fish"]).collect()} == {(1, 2), (4, 1)}
    terms = sparse.query_terms(spark.createDataFrame([(0, "fish blue")], "qid long, query string"))
    stored = sparse.Index(index.read_postings(spark, path, ["fish", "blue"]), index.term_statistics(spark, path).select("term", "df"), 4, 1.75)
    every = docs.union(spark.createDataFrame([(4, "green fish")], "doc_id long, text string"))
    assert {(r.doc_id, r.score) for r in sparse.bm25(stored, terms).collect()} == {(r.doc_id, r.score) for r in sparse.bm25(sparse.index(every, terms), terms).collect()}
    nodes, edges = index.read_graph(spark, index.write_graph(docs.select("doc_id"), docs, f"{tmp_path}/graph"))
    assert nodes.count() == edges.count() == 3
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id long, v array<double>")
    assert [tuple(r) for r in index.statistics(spark, index.write_embeddings(vectors, "id", "v", f"{tmp_path}/e")).collect()] == [(1, 1, 2)]


def test_multihop_follows_names(spark):
    docs = [(1, "where apples grow near Granville"), (2, "Granville has orchards"), (3, "nothing of it"), (4, "other words here"), (5, "and some more")]
    q = spark.createDataFrame([(0, "apples"), (1, "absent")], "qid long, query string")
    got = {(r.qid, r.doc_id): r.hop for r in rerank.multihop(spark.createDataFrame(docs, "doc_id long, text string"), q, hops=2, k=3).collect()}
    assert got == {(0, 1): 1, (0, 2): 2}
