"""Cached questions, JSON schemas, constrained plans and merged spans: small cases, and the queries against DuckDB on a small table."""

import os

import duckdb
import pandas as pd
import pytest

from gleaner.jobs import context as jobs
from gleaner.operators import cache, json_schema, planning
from tests.test_knowledge import DATA, _rows


@pytest.mark.parametrize("name", sorted(jobs.QUERIES))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    got, told = jobs.QUERIES[name](spark, DATA), con.execute(jobs.ORACLE[name])
    columns = [c[0] for c in told.description]
    frame = lambda rows: pd.DataFrame([list(r) for r in rows], columns=columns, dtype=object)
    have = frame(got.select(columns).collect())
    assert sorted(got.columns) == sorted(columns) and len(have) and _rows(have) == _rows(frame(told.fetchall()))


def test_similar_questions(spark):
    rows = [("a", t, text) for t, text in enumerate(["where do cats sleep", "dogs bark", "Where do cats sleep?", None, "cats", "where do cats sleep now"])]
    rows += [("b", 0, "where do cats sleep"), ("b", 1, "")] + [("c", t, "same words" if t in (0, 11) else f"other{t}") for t in range(12)]
    got = {(r.session, r.turn): (r.before, r.hit) for r in cache.similar_questions(spark.createDataFrame(rows, "session string, turn int, text string")).collect()}
    assert got["a", 2] == (0, True) and got["a", 1] == (None, False) and got["a", 3] == (None, False)
    assert got["a", 5] == (2, True)  # of equally similar ones the latest
    assert got["b", 0] == (None, False) and got["b", 1] == (None, False)
    assert got["c", 11] == (None, False)  # eleven questions back is too far
    assert len(got) == len(rows)


def test_json_types_merge(spark):
    texts = ['{"a": 1, "b": {"c": "x"}, "d": [1, 2.5, null]}', '{"a": 2.5, "b": {"c": null}, "d": []}', '{"a": "three", "b": {"c": "yes"}}', '{"b": null, "e": [{"f": true}, {"f": false}]}', "no json", None, "7"]
    frame = lambda rows: spark.createDataFrame([(t,) for t in rows], "j string")
    count = lambda rows: json_schema.counts(json_schema.walk(frame(rows), "j"))
    whole = {r.path: r for r in json_schema.schema(count(texts)).collect()}
    assert {p: (r.type, r.n) for p, r in whole.items()} == {
        "$": ("mixed", 5), "$.a": ("mixed", 3), "$.b": ("object", 4), "$.b.c": ("string", 3), "$.d": ("array", 2), "$.d[]": ("number", 3), "$.e": ("array", 1), "$.e[]": ("object", 2), "$.e[].f": ("boolean", 2)
    }
    assert whole["$.b.c"].null_share == round(1 / 3, 6) and whole["$.b.c"].mean_length == 2 and whole["$.d[]"].kinds == "null:1,integer:1,number:1" and (whole["$.d[]"].least, whole["$.d[]"].most) == (1.0, 2.5)
    parts = json_schema.schema(json_schema.merged(count(texts[:2]), count(texts[2:5]), count(texts[5:])))
    assert {tuple(r) for r in parts.collect()} == {tuple(r) for r in whole.values()}
    assert json_schema.schema(count([])).count() == 0


def _shrunk(plan, seconds, most):
    """The rounds as a loop."""
    k = {n: min(plan[f"{n}_k"], most) for n in planning.PROFILES}
    hops, rerank, rounds = plan["hops"], True, 0
    while True:
        took = round((sum(k[n] / 100 * (2 / p[0]) for n, p in planning.PROFILES.items()) + (sum(k.values()) / 200 if rerank else 0)) * (1 + 0.5 * hops), 6)
        if took <= seconds or max(k.values()) <= 10 or rounds == planning.ROUNDS:
            return (*k.values(), hops, rerank, took, rounds, took <= seconds)
        used = [n for n in sorted(k, key=lambda n: planning.PROFILES[n][0]) if k[n]]
        k = {n: max(10, int(v * 0.8)) if v > 10 else v for n, v in k.items()}
        if len(used) > 1:
            k[used[0]] = 0
        hops, rerank, rounds = max(hops - 1, 0), False, rounds + 1


@pytest.mark.parametrize("seconds", [0.05, 0.4, 2.0, 9.0])
def test_constrained_plans(spark, seconds):
    plans = [{"qid": i, "dense_k": a, "bm25_k": b, "graph_k": c, "hops": h} for i, (a, b, c, h) in enumerate([(200, 200, 75, 1), (50, 50, 0, 0), (10, 10, 10, 3), (500, 0, 0, 2), (0, 0, 75, 0), (11, 200, 1, 0)])]
    got = {r.qid: tuple(r)[1:] for r in planning.constrained(spark.createDataFrame(plans), seconds, 150).collect()}
    assert got == {p["qid"]: _shrunk(p, seconds, 150) for p in plans}
