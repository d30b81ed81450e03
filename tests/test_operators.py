"""Edge cases of the retrieval and analytics operators, and their queries against DuckDB on a small table."""

import os
import random
import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.jobs import analytics, retrieval
from gleaner.operators import answers, dense, feedback, fusion, graph, profile, rerank, sessions, sparse
from gleaner.sources import files

DATA = "/root/testdata/sf0.001"


def test_text_functions(spark):
    df = spark.createDataFrame([("Größe, été! a_1",), ("",), (None,), ("!?",)], "t string")
    assert [r[0] for r in df.select(text.tokens(F.col("t"))).collect()] == [["größe", "été", "a_1"], [], [], []]
    assert [r[0] for r in df.select(text.normalized(F.col("t"))).collect()] == ["größe été a_1", "", "", ""]
    pair = spark.createDataFrame([([], ["a"]), (["a", "a", "b"], ["a"]), ([], [])], "a array<string>, b array<string>")
    assert [r[0] for r in pair.select(text.overlap(F.col("a"), F.col("b"))).collect()] == [0.0, 0.5, 0.0]
    assert [r[0] for r in pair.select(text.jaccard(F.col("a"), F.col("b"))).collect()] == [0.0, 0.5, 0.0]


def test_bm25_common_terms_rank_below_no_match(spark):
    docs = spark.createDataFrame([(1, "x x y"), (2, "x z"), (3, "x"), (4, "q"), (5, None)], "doc_id long, text string")
    terms = sparse.query_terms(spark.createDataFrame([(0, "x")], "qid long, query string"))
    got = sparse.bm25_all(docs, sparse.index(docs, terms), terms, 2).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in got] == [(4, 0.0), (5, 0.0)]  # x is in over half of the documents
    nothing = sparse.query_terms(spark.createDataFrame([(0, "none")], "qid long, query string"))
    assert sparse.bm25(sparse.index(docs, nothing), nothing).count() == 0
    assert [r.doc_id for r in sparse.bm25_all(docs, sparse.index(docs, nothing), nothing, 3).orderBy("rank").collect()] == [1, 2, 3]


def test_dense_threshold_comes_after_the_cut(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [3.0, 0.0])], "doc_id long, v array<double>")
    q = spark.createDataFrame([(9, [0.0, 0.0])], "qid long, q array<double>")
    assert [(r.doc_id, r.score) for r in dense.nearest(v, q, 2, threshold=0.5).orderBy("rank").collect()] == [(1, 1.0), (2, 0.5)]
    assert dense.nearest(v, q, 0).count() == 0 and dense.nearest(v, q, 10).count() == 3


def test_fusion_edge_cases(spark):
    rows = [(0, "bm25", 1, 2.0, 1), (0, "bm25", 2, 2.0, 2), (0, "dense", 1, 0.0, 1), (0, "dense", 3, 0.0, 2), (0, "coverage", 4, -1.0, 1)]
    c = fusion.normalize(spark.createDataFrame(rows, "qid long, retriever string, doc_id long, score double, rank int"))
    assert {(r.retriever, r.doc_id): r.norm for r in c.collect()} == {("bm25", 1): 1.0, ("bm25", 2): 1.0, ("dense", 1): 0.0, ("dense", 3): 0.0, ("coverage", 4): 1.0}
    assert {r.doc_id for r in fusion.fuse(c, "max").collect()} == {1, 2, 4}  # nothing above 0: left out
    assert {r.doc_id for r in fusion.fuse(c, "combmnz").collect()} == {1, 2, 4}
    assert {r.doc_id: r.score for r in fusion.fuse(c, "borda").collect()} == {1: 4.0, 2: 1.0, 3: 1.0, 4: 1.0}
    with pytest.raises(ValueError):
        fusion.fuse(c, "other")


def test_packing(spark):
    df = spark.createDataFrame([([300, 300, 100, 50, 500],), ([],), ([600, 1],), ([0, 600],)], "s array<int>")
    assert [r[0] for r in df.select(profile.packed(F.col("s"), F.col("s"), 512)).collect()] == [[0, 1, 1, 1, 2], [], [0, 1], [0, 1]]
    docs = spark.createDataFrame([(1, "a" * 400 + "\n\n" + "b" * 400 + "\nc"), (2, None)], "doc_id long, text string")
    got = profile.text_chunks(docs, 150).orderBy("chunk").collect()
    assert [(r.doc_id, r.chunk, r.tokens) for r in got] == [(1, 0, 100), (1, 1, 100)] and got[1].content.endswith("\nc")


def test_packing_many_lines(spark):
    """100,000 lines in seconds: the fold's work goes by lines."""
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda i: F.repeat(F.lit("x"), F.lit(40))), "\n").alias("text"))
    began = time.time()
    r = profile.text_chunks(docs, 512).agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), F.max("tokens").alias("most")).first()
    assert tuple(r) == (-(-100_000 // 51), 1_000_000, 510) and time.time() - began < 60


def test_row_chunks_cross_buckets(spark):
    rows = profile.row_chunks(spark.range(25_000).withColumnRenamed("id", "k"), "k", 7000).groupBy("chunk").agg(F.count("*").alias("n"), F.min("k").alias("k")).orderBy("chunk").collect()
    assert [(r.chunk, r.n, r.k) for r in rows] == [(0, 7000, 0), (1, 7000, 7000), (2, 7000, 14000), (3, 4000, 21000)]


def test_graph_reach_with_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "y"), ("a", "b")], "source string, target string")
    got = {r.node: r.hop for r in graph.reach(e, spark.createDataFrame([("a",)], "node string"), 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2}


def test_greedy_filter_keeps_order(spark):
    long = "one two three four five six seven"
    rows = [(0, "q", 1, long, 3.0, 1), (0, "q", 2, long, 2.0, 2), (0, "q", 3, "short", 1.5, 3), (0, "q", 4, "alpha beta gamma delta epsilon", 1.0, 4)]
    c = spark.createDataFrame(rows, "qid long, query string, doc_id long, text string, score double, rank int")
    assert [r.doc_id for r in rerank.greedy_filter(c).orderBy("rank").collect()] == [1, 4]
    assert [r.doc_id for r in rerank.diverse(c, always=1).orderBy("rank").collect()] == [1, 3, 4]


def test_session_gap_is_exclusive(spark):
    ev = spark.sql("select * from values (1, 1L, timestamp_ntz'2024-01-01 00:00:00'), (2, 1L, timestamp_ntz'2024-01-01 01:00:00'), (3, 1L, timestamp_ntz'2024-01-01 01:59:59') as t(event_id, user_id, ts)")
    assert sorted(r.n for r in sessions.windows(ev).collect()) == [1, 2]


def test_calibration_bins(spark):
    p = spark.createDataFrame([(0.0, 0.0), (0.1, 0.0), (0.11, 1.0), (1.0, 1.0)], "p double, y double")
    assert {r.bin: r.n for r in answers.calibration(p).collect()} == {0: 2, 1: 1, 9: 1}


def test_ema(spark):
    ev = spark.sql("select 'a' event_type, timestamp_ntz'2024-01-01' ts, 1 rating union all select 'a', timestamp_ntz'2024-01-02', 2 union all select 'a', timestamp_ntz'2024-01-04', 5")
    assert [r.ema for r in feedback.ema(ev).orderBy("day").collect()] == [1.0, 1.1, 1.49]


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "a.csv").write_text("x,y\n1,b\n")
    (tmp_path / "a.txt").write_text("one\n\ntwo")
    assert files.load(spark, str(tmp_path / "a.json")).count() == 2
    assert files.load(spark, str(tmp_path / "a.csv")).dtypes == [("x", "int"), ("y", "string")]
    assert files.load(spark, str(tmp_path / "a.txt")).collect()[0][0] == "one\n\ntwo"
    with pytest.raises(ValueError):
        files.load(spark, "a.xyz")
    assert files.info(spark, str(tmp_path / "a.txt")).collect()[0].bytes == 8


def _rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted(tuple("null" if v is None or v != v else str(round(v, 6) if isinstance(v, float) else v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", ["bm25_batch", "tfidf_topk", "dense_batch", "norm_z_score", "fuse_rrf", "cascade_rerank", "kg_edges", "graph_bfs", "text_structure", "plan_cost", "session_windows", "verdicts", "metric_ema", "stream_feedback_counts"])
def test_against_duckdb(spark, name):
    job = retrieval if name in retrieval.QUERIES else analytics
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    assert _rows(job.QUERIES[name](spark, DATA).toPandas()) == _rows(con.execute(job.ORACLE[name]).df())


def _shuffled(spark) -> int:
    """Rows that all stages so far have written for a shuffle."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_best_equals_all_scores_and_shuffles_no_pairs(spark, monkeypatch):
    """Repeated and null ids, ids with texts of several lengths, null and empty texts, ties, words that most documents have, blocks of few documents."""
    monkeypatch.setattr(sparse, "CELLS", 500)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(words[: rng.choice([3, 30])]) for _ in range(rng.randrange(40)))) for i in range(600)]
    rows += [(i, t) for i, t in rows[:30]] + [(5, "w1 w2 w1"), (None, "w1 w29"), (None, "w28"), (7, None), (900, None), (901, ""), (902, "other words only")]
    docs = spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(f"q{i}", " ".join(rng.sample([*words, "missing"], 9))) for i in range(40)] + [("none", "missing"), ("empty", "")], "qid string, query string")
    terms = sparse.query_terms(queries).cache()
    found = sparse.matches(docs, terms)
    plain = sparse.Index(found, found.groupBy("term").agg(F.count("*").alias("df")), *sparse.statistics(docs))
    ix = sparse.index(docs, terms)
    assert (ix.n, round(ix.average, 9)) == (plain.n, round(plain.average, 9))
    assert sorted(map(str, ix.found.collect())) == sorted(map(str, found.select(*ix.found.columns).collect())) and sorted(ix.df.collect()) == sorted(plain.df.collect())
    for by in ("bm25", "coverage"):
        want = sorted(map(tuple, sparse.best(plain, terms, 6, by).collect()), key=str)
        assert len(want) == 240 and sorted(map(tuple, sparse.best(ix, terms, 6, by).collect()), key=str) == want
    before, once = _shuffled(spark), spark.createDataFrame(rows[:600], "doc_id long, text string")
    sparse.best(sparse.index(once, terms), terms, 6).collect()
    assert _shuffled(spark) - before < 6_000  # some 20,000 pairs of a query and a document have a word in common
    assert sparse.best(sparse.index(docs.limit(0), terms), terms, 6).count() == 0
