"""Session memory of a stream against sessions worked out at once, and spans of evidence."""

import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gleaner.operators import evidence
from gleaner.streaming import events, memory

AT = datetime(2024, 1, 1)


def _expected(rows, idle, ring, hours, until):
    """(user, start, end, n, types, number) of the sessions that ended before the watermark."""
    out = []
    for user in {r[0] for r in rows}:
        sessions = []
        for _, i, kind, ts in sorted((r for r in rows if r[0] == user), key=lambda r: (r[3], r[1])):
            if sessions and (ts - sessions[-1][-1][0]).total_seconds() < idle:
                sessions[-1].append((ts, kind))
            else:
                sessions.append([(ts, kind)])
        number, last = 0, None
        for s in sessions:
            number = 1 if last is None or s[0][0] - last >= timedelta(hours=hours) else number + 1
            last = s[-1][0]
            if last + timedelta(seconds=idle) <= until:
                out.append((user, s[0][0], last, len(s), min(len(s), ring), ",".join(k for _, k in s[-ring:]), number))
    return sorted(out)


def test_memory_over_several_batches(spark, tmp_path):
    """Files that come one by one, out of order within the watermark, with rings that overflow and users that are forgotten."""
    rng = random.Random(1)
    rows, now = [], AT
    for i in range(400):
        now += timedelta(seconds=rng.choice([20, 100, 400, 4000, 30_000]))
        rows.append((rng.randrange(3), i, rng.choice("abc"), now))
    rows.append((9, 400, "z", now + timedelta(days=3)))
    mixed = [r for at in range(0, len(rows), 8) for r in rng.sample(rows[at : at + 8], len(rows[at : at + 8]))]
    folder = tmp_path / "in"
    schema = "user_id long, event_id long, event_type string, ts timestamp"
    for k in range(0, len(mixed), 104):
        spark.createDataFrame(mixed[k : k + 104], schema).coalesce(1).write.parquet(f"{folder}/part={k:04}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))
    got = events.drained(memory.remembered(stream, "96 hours", idle=1800, ring=4, hours=6), "append")
    have = sorted(tuple(r) for r in got.collect())
    assert have == _expected(rows, 1800, 4, 6, rows[-1][3] - timedelta(hours=96))
    assert any(r[3] > r[4] for r in have) and any(r[6] > 1 for r in have)
    assert got.where(F.col("user_id") == 9).count() == 0  # the watermark hasn't passed it


def test_a_user_costs_no_calls_of_their_own(spark, tmp_path):
    """Many users with many sessions that all end at once: state and timers come with the rows, so seconds don't go by users and sessions."""
    rows = [(user, 1000 * user + k, None if k == 3 else "abc"[k % 3], AT + timedelta(hours=5 * k, seconds=user)) for user in range(300) for k in range(40)]
    schema = "user_id long, event_id long, event_type string, ts timestamp"
    spark.createDataFrame([*rows, (999, 10**6, "z", AT + timedelta(days=60))], schema).coalesce(1).write.parquet(f"{tmp_path}/in/part=0")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    began = time.time()
    got = events.drained(memory.remembered(stream), "append")
    assert time.time() - began < 60
    have = {(r.user_id, r.session_no): (r.session_start, r.n, r.last_types) for r in got.collect()}
    assert have == {(u, k + 1): (at, 1, kind or "") for u, i, kind, at in rows for k in [i - 1000 * u]}


def test_evidence_spans(spark):
    answer, query = "alpha beta gamma delta", "omega"
    text = "Alpha beta gamma here! Nothing of that kind. Alpha beta gamma delta. The omega alpha beta? Delta and gamma now. short. Unrelated words only"
    rows = spark.createDataFrame([(1, text, answer, query), (2, None, answer, query), (3, "", None, None), (4, text, None, query), (5, text, answer, None)], "k int, evidence string, answer string, query string")
    got = {}
    for r in evidence.merged_spans(rows, "k").collect():
        got.setdefault(r.k, []).append((r.place, r.low, r.high, r.score))
    # sentences: 0.45, 0.12?, 0.6, 0.53, 0.4, -
    assert got[1] == [(0, 2, 3, 0.6), (1, 0, 0, 0.45), (2, 4, 4, 0.4)]
    assert set(got) == {1, 5} and got[5][0][:3] == (0, 2, 2)
    long = spark.createDataFrame([(1, "alpha " * 60 + ". beta gamma " + "x" * 10, answer, query)], "k int, evidence string, answer string, query string")
    assert not evidence.merged_spans(long, "k").collect()  # the first sentence is too long, and so is the second one with it
    assert [(r.low, r.high) for r in evidence.merged_spans(long, "k", span=(10, 2000)).collect()] == [(0, 0), (1, 1)]
