"""Stored keyword and vector indexes: searches against those without an index, through appends, replacements, deletions and compaction."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import dense, sparse
from gleaner.sources import keyword_index, vector_index, versioned

WORDS = [f"w{i}" for i in range(60)] + ["the", "of"] * 30


def _text(rng):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 40)))


def _expected(spark, held, queries, k):
    docs = spark.createDataFrame(list(held.items()), "doc_id long, text string")
    terms = sparse.query_terms(queries)
    return {(r.qid, r.rank, r.doc_id, r.score) for r in sparse.top(sparse.bm25(sparse.index(docs, terms), terms), k).collect()}


def test_keyword_index_through_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyword_index, "BUCKET_DOCS", 8)
    rng, path = random.Random(1), f"{tmp_path}/keywords"
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    queries = spark.createDataFrame([(0, "w1 w2 w3"), (1, "the w9 w9"), (2, "absent"), (3, "the of"), (4, "w5 " * 3 + "w6 of")], "qid long, query string")
    found = lambda: {(r.qid, r.rank, r.doc_id, r.score) for r in keyword_index.search(spark, path, queries, 5).collect()}

    held = {i: _text(rng) for i in range(150)} | {150: "", 151: None}
    keyword_index.put(frame([*held.items(), (None, "w1 w2 w3")]), path)
    assert found() == _expected(spark, held, queries, 5)

    more = {i: _text(rng) for i in [*range(200, 240), *range(0, 40, 3)]}  # new ones and replacements
    keyword_index.put(frame(list(more.items())), path)
    held |= more
    assert found() == _expected(spark, held, queries, 5)

    gone = [*range(1, 60, 2), 205, 999]
    keyword_index.delete(spark, path, frame([(i, "") for i in [*gone, None, 1]]))
    held = {i: t for i, t in held.items() if i not in gone}
    assert found() == _expected(spark, held, queries, 5)

    keyword_index.put(frame([(1, "w1 w2 w3 back")]), path)  # a deleted one comes back
    held[1] = "w1 w2 w3 back"
    assert found() == _expected(spark, held, queries, 5)

    before = keyword_index.Reader(spark, path).blocks.count()
    keyword_index.compact(spark, path)
    assert found() == _expected(spark, held, queries, 5) and len(versioned.committed(spark, path)) == 1
    assert keyword_index.Reader(spark, path).blocks.count() < before
    keyword_index.put(frame([(300, "w1")]), path)
    versioned.vacuum(spark, path)
    held[300] = "w1"
    assert found() == _expected(spark, held, queries, 5)
    assert {x.name for x in (tmp_path / "keywords/docs").iterdir()} == {"version=5", "version=6"}


def test_keyword_index_reads_only_what_it_needs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyword_index, "BUCKET_DOCS", 4)
    rng, path = random.Random(2), f"{tmp_path}/keywords"
    docs = spark.createDataFrame([(i, ("rare " * 9 if i % 50 == 0 else "") + _text(rng) + " rare" * (i % 7 == 0)) for i in range(600)], "doc_id long, text string").coalesce(2)
    keyword_index.put(docs, path)
    queries = spark.createDataFrame([(0, "rare w1")], "qid long, query string")
    best, pairs, left = keyword_index.pruned_search(spark, path, queries, 3, 2)
    assert {(r.qid, r.rank, r.doc_id, r.score) for r in best.collect()} == _expected(spark, {r.doc_id: r.text for r in docs.collect()}, queries, 3)
    assert left.count() < pairs.count() / 2
    now = keyword_index.Reader(spark, path)
    some = now.of_terms(sparse.query_terms(queries))
    parts = {r[0] for r in some.select("part").distinct().collect()}
    filters = _filters(some)
    assert len(parts) <= 2 and "version#" in filters and all(f"{p}" in filters.split("part#")[1] for p in parts)
    # what is opened holds those terms' folders only
    assert {r[0].split("part=")[1].split("/")[0] for r in now.blocks.where(F.col("part").isin(list(parts))).select("_metadata.file_path").distinct().collect()} == {str(p) for p in parts}


def test_keyword_index_packs_buckets(spark, tmp_path, monkeypatch):
    """A row for each bucket and folder, whatever the words; changes beyond the broadcast and terms beyond it find the same."""
    monkeypatch.setattr(keyword_index, "BUCKET_DOCS", 50)
    rng, path = random.Random(5), f"{tmp_path}/keywords"
    held = {i: " ".join([_text(rng), *(f"own{i}x{j}" for j in range(40))]) for i in range(300)}
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    keyword_index.put(frame(list(held.items())), path)
    now = keyword_index.Reader(spark, path)
    assert now.blocks.count() <= 6 * (keyword_index.PARTS + 1) < 300
    assert sorted((r.doc_id, r.dl) for r in now.live_docs().collect()) == [(i, len(t.split())) for i, t in held.items()]
    more = {i: _text(rng) + " own7x1" for i in range(20, 60, 2)}
    keyword_index.put(frame(list(more.items())), path)
    keyword_index.delete(spark, path, frame([(i, "") for i in range(100, 300, 3)]))
    held = {i: t for i, t in (held | more).items() if i not in range(100, 300, 3)}
    queries = spark.createDataFrame([(f"q{i}", f"w{i} w{i + 1} own7x1 the own{i}x3") for i in range(30)], "qid string, query string")
    want = _expected(spark, held, queries, 4)
    found = lambda: {(r.qid, r.rank, r.doc_id, r.score) for r in keyword_index.search(spark, path, queries, 4).collect()}
    assert found() == want
    monkeypatch.setattr(keyword_index, "BROADCAST_CHANGED", 1)
    monkeypatch.setattr(sparse, "BROADCAST_TERMS", 5)
    assert found() == want
    keyword_index.compact(spark, path)
    assert found() == want and keyword_index.Reader(spark, path).blocks.count() <= 5 * keyword_index.PARTS


def _filters(df):
    """The scan's filters on folders."""
    return df._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("PushedFilters")[0]


def test_uncommitted_writes_are_passed_over(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    versioned.commit(spark, path, {"t": rows(1, 2)})
    rows(9).write.parquet(f"{path}/t/version=2")  # a writer died before its mark
    seen = lambda: {r.id for r in versioned.read(spark, path, "t", "id long, version int").collect()}
    assert seen() == {1, 2}
    assert versioned.commit(spark, path, {"t": rows(3)}) == 2 and seen() == {1, 2, 3}
    assert versioned.commit(spark, path, {"t": rows(4)}, base=True) == 3 and seen() == {4}
    assert versioned.committed(spark, f"{tmp_path}/nothing") == []


def test_empty_keyword_index(spark, tmp_path):
    path = f"{tmp_path}/k"
    queries = spark.createDataFrame([(0, "a b")], "qid long, query string")
    keyword_index.put(spark.createDataFrame([], "doc_id long, text string"), path)
    assert keyword_index.search(spark, path, queries).count() == 0
    keyword_index.put(spark.createDataFrame([(1, "a c d")], "doc_id long, text string"), path)
    assert [r.doc_id for r in keyword_index.search(spark, path, queries).collect()] == [1]
    assert keyword_index.search(spark, path, queries.limit(0)).count() == 0


def _vectors(spark, sf):
    return spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


@pytest.fixture(scope="module")
def vectors_at(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('vectors')}/v"
    vector_index.build(_vectors(spark, "sf0.1"), path)
    return path


def _nearest(spark, rows, queries, k):
    return {(r.qid, r.rank, r.doc_id, r.score) for r in dense.nearest(rows.select(F.col("id").alias("doc_id"), "v"), queries, k).collect()}


def test_recall_and_pruning(spark, vectors_at):
    rows = _vectors(spark, "sf0.1")
    queries = rows.where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    want = {x[:3:2] for x in _nearest(spark, rows, queries, 10)}
    n_cells = vector_index.Reader(spark, vectors_at).model.centres.shape[0]
    assert n_cells == 45
    got = vector_index.search(spark, vectors_at, queries, 10, probe=30, shortlist=100)
    assert len(want & {(r.qid, r.doc_id) for r in got.collect()}) / len(want) >= 0.9
    # one query opens the folders of its cells only, and codes are read without vectors
    now = vector_index.Reader(spark, vectors_at)
    few = now.masked("ids", "codes").where(F.col("cell").isin([3, 4]))
    assert "cell#" in _filters(few) and " IN (3,4)" in _filters(few)
    assert "vectors" not in few._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_vector_index_through_changes(spark, vectors_at, monkeypatch):
    held = _vectors(spark, "sf0.001").where("id < 300")
    queries = held.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    path = f"{vectors_at}-changes"
    vector_index.build(held, path, n_cells=7, slices=8, codes=32)
    found = lambda: {(r.qid, r.rank, r.doc_id, r.score) for r in vector_index.search(spark, path, queries, 5, probe=7, shortlist=10_000).collect()}
    assert found() == _nearest(spark, held, queries, 5)
    monkeypatch.setattr(vector_index, "BLOCK", 16)  # cells of several blocks

    moved = held.where("id % 3 = 0").select("id", F.transform("v", lambda x: -x).alias("v"))
    odd = spark.createDataFrame([(None, [1.0] * 64), (7001, None), (7002, [1.0, None] * 32), (7003, [1.0])], "id long, v array<float>")
    vector_index.put(moved.unionByName(odd), path)
    held = held.where("id % 3 <> 0").unionByName(moved)
    assert found() == _nearest(spark, held, queries, 5)

    vector_index.delete(spark, path, held.where("id % 5 = 0"))
    held = held.where("id % 5 <> 0")
    assert found() == _nearest(spark, held, queries, 5)

    vector_index.compact(spark, path)
    versioned.vacuum(spark, path)
    assert found() == _nearest(spark, held, queries, 5)
    vector_index.compact(spark, path, refit=True, n_cells=5, slices=4, codes=16)
    assert found() == _nearest(spark, held, queries, 5)
    assert vector_index.Reader(spark, path).vectors().count() == held.count()
    with pytest.raises(ValueError):
        vector_index.build(odd.where("id = 7001"), f"{path}-none")


def test_grid_of_queries_and_vectors(spark, monkeypatch):
    rows = _vectors(spark, "sf0.001")
    odd = spark.createDataFrame([(9001, [1.0]), (9002, None), (9003, [0.5] * 64)], "id long, v array<float>")
    rows = rows.unionByName(odd)
    queries = rows.where("id % 5 = 0 or id > 9000").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    args = rows.select(F.col("id").alias("doc_id"), "v"), queries, 4
    as_set = lambda df: {tuple(r) for r in df.select("qid", "doc_id", "score", "rank").collect()}
    whole, others = as_set(dense.nearest(*args)), as_set(dense.nearest(*args, exclude_self=True))
    monkeypatch.setattr(dense, "QUERY_BYTES", 8000)
    monkeypatch.setattr(dense, "VECTOR_BYTES", 30_000)
    assert as_set(dense.nearest(*args)) == whole and as_set(dense.nearest(*args, exclude_self=True)) == others


def test_first_unmatched(spark, monkeypatch):
    ids = spark.createDataFrame([(i,) for i in range(0, 900, 3)], "doc_id long")
    match = {1: [], 2: list(range(0, 60, 3)), 3: list(range(0, 897, 3)), 4: list(range(0, 900, 3)), 5: list(range(0, 900, 6))}
    matched = spark.createDataFrame([(q, i) for q, m in match.items() for i in m], "qid long, doc_id long")
    asked = spark.createDataFrame([(q,) for q in match], "qid long")
    want = {(q, i) for q, m in match.items() for i in sorted(set(range(0, 900, 3)) - set(m))[:4]}
    found = lambda: {tuple(r) for r in sparse.first_unmatched(ids, asked, matched, 4).collect()}
    assert found() == want
    monkeypatch.setattr(sparse, "PREFIX", 100)
    assert found() == want
    assert sparse.first_unmatched(ids.limit(0), asked, matched, 4).count() == 0
