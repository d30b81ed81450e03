"""Session memory of a stream: per user the open session with a ring of its last events, closed by a timer of idle time.

Rows of a user may come in any order within the watermark: spans of events that lie within the
idle limit of one another are one session, so late rows lengthen, open or join sessions. State is bounded by the ring
for each session that the watermark hasn't passed. A user has one timer, at the earliest end of their open sessions;
it emits all that have ended and is set anew. How long a user is remembered at all is a second limit: their state is
dropped then, and what they do after it starts anew.

State comes and goes with the rows, many users in a batch, so a user costs no calls of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Seconds of idle time that end a session, events that are remembered, hours after which a user is forgotten.
IDLE, RING, HOURS = 3600, 50, 24
RESULT = "user_id long, low long, high long, n long, n_kept int, last_types string, session_no long"
#: A user: the open sessions, oldest first, and the number and end of the last closed one. times, ids and types: at most RING of the latest events of each session, in order, kept of each.
STATE = "lows array<long>, highs array<long>, counts array<long>, kept array<long>, times array<long>, ids array<long>, types array<string>, number long, last long"


def _joined(sessions: list[tuple], idle: int, ring: int) -> list[tuple]:
    """Sessions that come within the limit of one another made one, oldest first."""
    out: list[tuple] = []
    for s in sorted(sessions, key=lambda s: s[0]):
        if out and s[0] - out[-1][1] < idle:
            low, high, n, events = out[-1]
            out[-1] = (low, max(high, s[1]), n + s[2], sorted(events + s[3])[-ring:])
        else:
            out.append(s)
    return out


class Memory:
    def __init__(self, idle: int = IDLE, ring: int = RING, hours: int = HOURS):
        self.idle, self.ring, self.forget = idle * 1_000_000, ring, hours * 3600 * 1_000_000

    @staticmethod
    def _held(state: GroupState) -> tuple[list[tuple], int, int | None]:
        if not state.exists:
            return [], 0, None
        lows, highs, counts, kept, times, ids, types, number, last = state.get
        sessions, at = [], 0
        for low, high, n, size in zip(lows, highs, counts, kept):
            part = slice(at, at + size)
            sessions.append((low, high, n, list(zip(times[part], ids[part], types[part]))))
            at += size
        return sessions, number, last

    @staticmethod
    def _hold(state: GroupState, sessions: list[tuple], number: int, last: int | None) -> None:
        events = [e for s in sessions for e in s[3]]
        state.update((*([s[i] for s in sessions] for i in range(3)), [len(s[3]) for s in sessions], *([e[i] for e in events] for i in range(3)), number, last))

    def __call__(self, key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sessions, number, last = self._held(state)
        for part in rows if not state.hasTimedOut else ():  # parts of a hot user's rows are folded one by one
            new = [(at, at, 1, [(at, i, kind)]) for at, i, kind in zip(part["at"].tolist(), part["event_id"].tolist(), part["event_type"].tolist())]
            sessions = _joined(sessions + _joined(new, self.idle, self.ring), self.idle, self.ring)
        now, out = state.getCurrentWatermarkMs() * 1000, []
        while sessions and sessions[0][1] + self.idle <= now:  # later rows lie after the watermark, so nothing joins it
            low, high, n, events = sessions.pop(0)
            number, last = 1 if last is None or low - last >= self.forget else number + 1, high
            out.append((key[0], low, high, n, len(events), ",".join(e[2] for e in events if e[2] is not None), number))
        if sessions or last + self.forget > now:
            self._hold(state, sessions, number, last)
            # a timer goes off once the watermark is beyond it; the first full millisecond at or after the end is one beyond
            state.setTimeoutTimestamp(max(1, -(-(sessions[0][1] + self.idle if sessions else last + self.forget) // 1000) - 1))
        else:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["user_id", "low", "high", "n", "n_kept", "last_types", "session_no"])


def remembered(events: DataFrame, late: str = "1 hour", **limits) -> DataFrame:
    """(user_id, session_start, session_end, n, n_kept, last_types, session_no) of the sessions that the watermark has passed. events: user_id, event_id, event_type, ts; null users are left out.

    n_kept and last_types: the ring's events; session_no counts a user's sessions since they were last forgotten.
    """
    rows = events.where("user_id is not null and ts is not null").withWatermark("ts", late).select("user_id", "event_id", "event_type", "ts", F.unix_micros("ts").alias("at"))
    out = rows.groupBy("user_id").applyInPandasWithState(Memory(**limits), RESULT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("user_id", F.timestamp_micros("low").alias("session_start"), F.timestamp_micros("high").alias("session_end"), "n", "n_kept", "last_types", "session_no")
