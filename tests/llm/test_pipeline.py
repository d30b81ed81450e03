"""The pipeline's rows against a brute-force version of its stages."""

import random
from collections import Counter

import duckdb
import numpy as np
import pandas as pd

import corpus_pipeline
from gleaner.llm import mixing, quality, sentencepiece_fst, simhash

COMMON = ["the", "of", "and", "to", "a", "in", "is", "that"]


def prose(seed, n):
    rng = random.Random(seed)
    own = ["".join(rng.choice("abcdeghilmnoprstu") for _ in range(rng.randint(3, 9))) for _ in range(150)]
    return " ".join(rng.choices(COMMON, [11, 6, 5, 4, 3, 3, 2, 2])[0] if rng.random() < 0.2 else rng.choice(own) for _ in range(n)) + "."


def table():
    texts = [prose(i, 80 + 7 * i) for i in range(24)]
    texts.append(texts[3])  # a copy
    texts.append(texts[4].replace("the", "thy", 1))  # a near copy
    passage = prose(99, 60)
    texts += [prose(40 + i, 90) + "\n" + passage + "\n" + prose(60 + i, 50) for i in range(3)]
    texts += ["one two", None, "", "again and again and again " * 20, texts[5].upper(), texts[6].replace(" ", "### ")]
    return [(i, t, "en", None if i % 9 == 8 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)], passage


def brute_near(rows):
    shape = simhash.PIPELINE
    prints = [np.array(simhash.fingerprint(simhash.shingle_hashes(t, shape.words), shape.lanes), np.int64).view(np.uint64) for _, t, *_ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            d = np.bitwise_count(prints[i] ^ prints[j])
            if d[: shape.indexed].min() <= shape.radius and d.sum() <= shape.limit and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return [r for k, r in enumerate(rows) if group[k] == k]


def brute_suffix(rows):
    seen, out = set(), []
    for i, t, lang, source, _ in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        rest = bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore")
        if rest.split():
            out.append((i, rest, lang, source, len(rest)))
    return out


def test_pipeline_rows(spark, tmp_path):
    rows, passage = table()
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    verdict = {r.doc_id: r.kept for r in quality.judge(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    assert all(verdict[i] for i in range(29)) and not any(verdict[i] for i in range(29, 35))
    rows = brute_suffix(brute_near([r for r in rows if verdict[r[0]]]))
    assert {24, 25} & {r[0] for r in rows} == set() and sum(passage in r[1] for r in rows) == 1
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=columns))
    taken = dict(con.execute(f"SELECT doc_id, taken FROM ({mixing.oracle()})").fetchall())
    fst, want = sentencepiece_fst.Transducer.compile(sentencepiece_fst.default_model()), Counter()
    for i, t, *_ in rows:
        words = t.split()
        for _ in range(taken[i] // len(words)):
            want[i, tuple(fst.encode(t).tolist())] += 1
        if rest := taken[i] % len(words):
            want[i, tuple(fst.encode(" ".join(words[:rest])).tolist())] += 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want and all(r.n_ids == len(r.ids) for r in got)


def test_stages_take_empty_tables_and_keep_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, size long, rank string")
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, empty, "")
        assert out.columns == empty.columns and out.count() == 0
    assert corpus_pipeline.STAGES[4][1](spark, empty, "").count() == 0
