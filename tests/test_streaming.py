"""Streams are drained into files and not into the driver's memory."""

import datetime

import pandas as pd

from gleaner.streaming import events


def test_drained_results_lie_in_files(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(u, at + datetime.timedelta(hours=h), "a" if h else "b", 1.0) for u in range(50) for h in (0, 0.5, 3)] + [(99, at + datetime.timedelta(days=9), "a", 1.0)]
    pd.DataFrame(rows, columns=["user_id", "ts", "event_type", "value"]).astype({"ts": "datetime64[us]"}).to_parquet(f"{tmp_path}/events.parquet")
    stream = events.stream(spark, str(tmp_path))
    closed = events.drained(events.sessions(stream), "append")
    assert sorted((r.user_id, r.session_start.hour, r.n) for r in closed.collect()) == sorted([(u, 0, 2) for u in range(50)] + [(u, 3, 1) for u in range(50)])
    by_type = events.drained(events.counts(stream), "complete")
    assert {r.event_type: (r.n, r.total) for r in by_type.collect()} == {"a": (101, 101.0), "b": (50, 50.0)}
    assert closed.inputFiles() and by_type.inputFiles()
    nothing = events.drained(events.sessions(stream.where("user_id < 0")), "append")
    assert nothing.count() == 0 and nothing.columns == ["user_id", "session_start", "n"]
