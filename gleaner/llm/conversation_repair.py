"""Repair of the structure of conversations by rank-convergence parallel Viterbi.

Rows are dealt in the order of their turns, so that a conversation of any length lies in chunks of
bounded size in many tasks. Four states follow the roles of the repaired conversation (nothing yet,
after s, after u, after a); the cost to go before a row is a vector of four numbers, got from the
one after it by a step in min-plus arithmetic. Each chunk starts from a speculative vector, the
one of a conversation's end. Fix-up passes hand each chunk the vector that its successor came to and run it
again, along with its old run, until the two differ by a constant only; from there on the old run holds.
When no chunk's start differs any more, constants are added up and decisions are traced forward: for
each chunk from every state, and with states handed along chunks once more. Of the cheapest edits the
trace takes at each place the one whose initial comes first in ASCII: in one state each kind of edit leads to
one place, so that gives the least audit.

Null roles and texts are one space; a null turn comes first; rows of the same turn are in the order of their
roles and then of the SHA-256 of their texts, repeated rows next to each other; null conversation ids are one
conversation; conversations that lose all rows have zeros, an empty audit and the empty string's hash; an empty
table gives an empty result; only the four columns are read, so others can't clash. Long texts leave
the scan only for the repaired conversation. That is hashed in order, row by row: a hash of one string can't be split,
so one task reads the texts of a conversation, keeping none of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm.common import SPACES, cut, table, with_row

#: Costs of the edits, and what a truncated row adds that isn't deleted.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: Rows of a chunk at most (repeated rows count once).
CHUNK_ROWS = 4096
#: A row's kind is a letter: its role's initial (o: another one), upper case if truncated, or its number if it must go.
KINDS = {False: "suao", True: "SUAO"}
MUST_GO = "0123"
#: States: 0 nothing, 1 after s, 2 after u, 3 after a. Where a kept row leads, and the state that an inserted or reroled row makes.
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}
GIVEN = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
#: Costs to go at the end of a conversation: what must still be inserted.
END = (0, 2 * INSERT, INSERT, 0)


@lru_cache(maxsize=1 << 16)
def before(kind: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go before a row of a kind, from those after it; insertions come before the row."""
    c = []
    for q in range(4):
        ways = [DELETE + after[q]]
        if kind not in MUST_GO:
            late = TRUNCATED if kind.isupper() else 0
            ways.append(REROLE + late + after[GIVEN[q]])
            if q in NEXT[kind.lower()]:
                ways.append(late + after[NEXT[kind.lower()][q]])
        c.append(min(ways))
    u, a = min(c[2], INSERT + c[3]), min(c[3], INSERT + c[2])
    return (min(c[0], INSERT + u), min(c[1], INSERT + u), u, a)


@lru_cache(maxsize=1 << 16)
def step(kind: str, after: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """before(), less its smallest number, and that number: there are few such vectors."""
    costs = before(kind, after)
    return tuple(x - min(costs) for x in costs), min(costs)


@lru_cache(maxsize=1 << 16)
def least_edits(kind: str, after: tuple[int, ...], q: int) -> tuple[str, tuple[str, ...], bool, str, int]:
    """The least of the cheapest edits that take a row from state q: their initials, roles put in before it, whether it stays, its new role or nothing, the state after it."""
    costs, edits, put = before(kind, after), "", []
    while True:
        if DELETE + after[q] == costs[q]:
            return edits + "D", tuple(put), False, "", q
        if INSERT + costs[GIVEN[q]] == costs[q]:
            edits, q = edits + "I", GIVEN[q]
            put.append(ROLE[q])
            continue
        to = NEXT[kind.lower()].get(q)
        if to is not None and (TRUNCATED if kind.isupper() else 0) + after[to] == costs[q]:
            return edits + "K", tuple(put), True, "", to
        return edits + "R", tuple(put), True, ROLE[GIVEN[q]], GIVEN[q]


def costs_of(kinds: str, start: tuple, old: tuple | None = None) -> tuple[tuple, int, int]:
    """Costs to go before a chunk (less their shift), the shift, and the rows that were run; old: (start, costs, shift) of an earlier run.

    Once both runs' vectors are the same but for a constant, the earlier run's rest is taken.
    """
    now, shift = start, 0
    was, was_shift = (old[0], 0) if old else (None, 0)
    for n, kind in enumerate(reversed(kinds)):
        if was == now:
            return old[1], shift + old[2] - was_shift, n
        now, more = step(kind, now)
        shift += more
        if was is not None:
            was, more = step(kind, was)
            was_shift += more
    return now, shift, len(kinds)


def vectors_of(kinds: str, start: tuple) -> list[tuple]:
    """For each row the costs to go after it."""
    out = [start]
    for kind in reversed(kinds[1:]):
        out.append(step(kind, out[-1])[0])
    return out[::-1]


def damaged(conversations: DataFrame) -> DataFrame:
    """(rid, key, conv_id, turn, role, text, copies): rows after damage; a repeated one has two copies."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null"))
    rows = with_row(conversations.select("conv_id", "turn", "role", "text"), "rid").select("rid", key.alias("key"), "conv_id", "turn", part("role").alias("role"), part("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    return rows.select("rid", "key", "conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1).alias("copies"))


def _index(values: str, c: Column) -> Column:
    """Place of c among the characters of values, or one beyond them."""
    return F.when(c == "", len(values)).otherwise((F.instr(F.lit(values), c) + len(values)) % (len(values) + 1))


def judged(rows: DataFrame) -> DataFrame:
    """(key, turn, role, same, rid, n, blank, repeated, truncated, kinds, at): what is needed of distinct rows, in order; texts stay behind.

    at numbers them along the conversations. Repeated rows are counted before anything is brought together.
    """
    spaced = F.rtrim(F.col("text"), F.lit(SPACES))
    blank = F.translate("text", SPACES, "") == ""
    told = rows.where("copies > 0").select("key", "turn", "role", F.sha2("text", 256).alias("same"), blank.alias("blank"), (~blank & ~F.substring(spaced, -1, 1).isin(*".!?")).alias("open"), "rid", "copies")
    each = told.groupBy("key", "turn", "role", "same", "blank", "open").agg(F.min("rid").alias("rid"), F.sum("copies").alias("n"))
    first = each.groupBy("key", "role", "same").agg(F.min(F.struct("turn")).alias("first"))
    seen = each.join(first, ["key", "role", "same"]).withColumn("again", ~F.col("turn").eqNullSafe(F.col("first.turn")))
    initial = _index("sua", F.substring("role", 1, 1))
    go, late = F.col("blank") | F.col("again"), F.col("open")
    letter = lambda values: F.substring(F.lit(values), initial + 1, F.lit(1))
    kind = F.when(go, letter(MUST_GO)).when(late, letter(KINDS[True])).otherwise(letter(KINDS[False]))
    out = seen.select(
        "key", "turn", "role", "same", "rid", "n",
        F.when(F.col("blank"), F.col("n")).otherwise(0).alias("blank"), F.when(F.col("blank"), 0).otherwise(F.col("n") - F.when(F.col("again"), 0).otherwise(1)).alias("repeated"), (~go & late).cast("int").alias("truncated"),
        F.concat(kind, F.repeat(letter(MUST_GO), (F.col("n") - 1).cast("int"))).alias("kinds"),
    )
    order = ["key", F.asc_nulls_first("turn"), "role", "same"]
    return cut(out.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))


def pieces(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """(key, chunk, kinds, rids): conversations in chunks, each an array of kinds and one of row ids."""
    each = rows.select("key", F.expr(f"at div {chunk_rows}").alias("chunk"), F.struct("at", "kinds", "rid").alias("row"))
    sorted_rows = F.array_sort(F.collect_list("row"))
    return cut(each.groupBy("key", "chunk").agg(sorted_rows.alias("rows")).select("key", "chunk", F.col("rows.kinds").alias("kinds"), F.col("rows.rid").alias("rids")))


RUN = "key string, chunk long, start array<int>, costs array<int>, shift long, ran long"


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A run of each chunk: from the speculative vector, or from what its successor came to."""
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            old = (tuple(r.start), tuple(r.costs), r.shift) if r.start is not None else None
            start = tuple(r.wanted) if r.wanted is not None else END
            costs, shift, ran = costs_of("".join(r.kinds), start, old)
            out.append((r.key, r.chunk, start, costs, shift, ran))
        yield pd.DataFrame(out, columns=["key", "chunk", "start", "costs", "shift", "ran"])


def settled(parts: DataFrame) -> DataFrame:
    """(key, chunk, start, costs, shift, ran) of each chunk with the right start, but for a constant; ran: rows run in all passes."""
    nothing = lambda name: F.lit(None).cast("array<int>").alias(name)
    now = cut(parts.select("key", "chunk", "kinds", nothing("start"), nothing("costs"), F.lit(0).cast("long").alias("shift"), nothing("wanted")).mapInPandas(_runs, RUN))
    along = W.partitionBy("key").orderBy("chunk")
    while True:
        wanted = now.withColumn("wanted", F.lead("costs").over(along))
        stale = F.col("wanted").isNotNull() & (F.col("wanted") != F.col("start"))
        late = cut(wanted.where(stale))
        if late.isEmpty():
            return now
        again = late.join(parts.select("key", "chunk", "kinds"), ["key", "chunk"]).select("key", "chunk", "kinds", "start", "costs", "shift", "wanted").mapInPandas(_runs, RUN)
        new = again.join(late.select("key", "chunk", F.col("ran").alias("ran_before")), ["key", "chunk"]).select("key", "chunk", "start", "costs", "shift", (F.col("ran") + F.col("ran_before")).alias("ran"))
        now = cut(now.join(late.select("key", "chunk"), ["key", "chunk"], "left_anti").unionByName(new))


def _exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state after a chunk for each state before it."""
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            kinds = "".join(r.kinds)
            states = [0, 1, 2, 3]
            for kind, after in zip(kinds, vectors_of(kinds, tuple(r.start)), strict=True):
                states = [least_edits(kind, after, q)[4] for q in states]
            out.append((r.key, r.chunk, states))
        yield pd.DataFrame(out, columns=["key", "chunk", "exits"])


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state before each chunk; chunks come in order, a conversation's next to each other."""
    key, state = None, 0
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if r.key != key:
                key, state = r.key, 0
            out.append((r.key, r.chunk, state))
            state = r.exits[state]
        yield pd.DataFrame(out, columns=["key", "chunk", "entry"])


def _traces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each chunk's audit, its illegal neighbours, first and last initials, and the rows that make the repaired conversation: rid (below zero for one put in) and new role."""
    legal = {"01", "12", "21"}
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            kinds = "".join(r.kinds)
            heads = set()
            at = 0
            for i, row in enumerate(r.kinds):
                heads.add((at, r.rids[i]))
                at += len(row)
            rid_at = dict(heads)
            q, audit, lines = r.entry, [], []
            for i, (kind, after) in enumerate(zip(kinds, vectors_of(kinds, tuple(r.start)), strict=True)):
                edits, put, stays, role, q = least_edits(kind, after, q)
                audit.append(edits)
                lines += [(-1 - len(lines), x) for x in put]
                if stays:
                    lines.append((rid_at[i], role))
            if r.is_last:  # what the end still needs
                tail = [ROLE[x] for x in {0: (), 1: (2, 3), 2: (3,), 3: ()}[q]]
                audit.append("I" * len(tail))
                lines += [(-1 - i, x) for i, x in enumerate(tail, len(lines))]
            initials = ["suao".find(k.lower()) if k not in MUST_GO else int(k) for k in kinds]
            wrong = sum(f"{a}{b}" not in legal for a, b in zip(initials, initials[1:]))
            out.append((r.key, r.chunk, "".join(audit), wrong, str(initials[0]), str(initials[-1]), [{"rid": a, "role": b} for a, b in lines]))
        yield pd.DataFrame(out, columns=["key", "chunk", "audit", "wrong", "first", "last", "lines"])


def traced(parts: DataFrame, runs: DataFrame) -> DataFrame:
    """(key, chunk, audit, wrong, first, last, lines) of each chunk."""
    along = W.partitionBy("key").orderBy("chunk")
    marked = runs.select("key", "chunk", "start", (F.lead("chunk").over(along).isNull()).alias("is_last"), (F.lag("chunk").over(along).isNull()).alias("is_first"))
    whole = marked.join(parts, ["key", "chunk"])
    several = whole.where("not (is_first and is_last)").select("key", "chunk", "start", "kinds").mapInPandas(_exits, "key string, chunk long, exits array<int>")
    entry = several.repartition("key").sortWithinPartitions("key", "chunk").mapInPandas(_entries, "key string, chunk long, entry int")
    ready = whole.join(entry, ["key", "chunk"], "left").select("key", "chunk", "start", "kinds", "rids", "is_last", F.coalesce("entry", F.lit(0)).alias("entry"))
    return cut(ready.mapInPandas(_traces, "key string, chunk long, audit string, wrong long, first string, last string, lines array<struct<rid: long, role: string>>"))


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The hash of each conversation's lines, which come in order."""
    key = digest = None
    for batch in batches:
        out = []
        for k, line in zip(batch["key"], batch["line"]):
            if k != key:
                if key is not None:
                    out.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(line.encode())
            else:
                digest.update(b"\n" + line.encode())
        yield pd.DataFrame(out, columns=["key", "sha"])
    if key is not None:
        yield pd.DataFrame([(key, digest.hexdigest())], columns=["key", "sha"])


def repaired_lines(rows: DataFrame, traces: DataFrame) -> DataFrame:
    """(key, chunk, place, role, text): the repaired conversations' rows. Texts meet the decisions by row id."""
    lines = traces.select("key", "chunk", F.posexplode("lines").alias("place", "line")).select("key", "chunk", "place", F.col("line.rid").alias("rid"), F.col("line.role").alias("new_role"))
    kept = lines.where("rid >= 0").join(rows.select("rid", "role", "text"), "rid").select("key", "chunk", "place", F.when(F.col("new_role") != "", F.col("new_role")).otherwise(F.col("role")).alias("role"), "text")
    return kept.unionByName(lines.where("rid < 0").select("key", "chunk", "place", F.col("new_role").alias("role"), F.lit("").alias("text")))


def repair(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Of rows (rid, key, conv_id, turn, role, text, copies): one row per conversation with its faults, cost, audit and hash; and the repaired conversations' rows."""
    each = judged(rows)
    parts = pieces(each, chunk_rows)
    runs = settled(parts)
    traces = traced(parts, runs)
    lines = repaired_lines(rows, traces)
    hashes = lines.select("key", "chunk", "place", F.concat("role", F.lit(":"), "text").alias("line")).repartition("key").sortWithinPartitions("key", "chunk", "place").select("key", "line").mapInPandas(_hashes, "key string, sha string")
    total = runs.groupBy("key").agg((F.sum("shift") + F.min_by("costs", "chunk")[0]).alias("cost"))
    pair = F.concat(F.lag("last").over(W.partitionBy("key").orderBy("chunk")), "first")
    audits = traces.withColumn("pair", pair).groupBy("key").agg(
        (F.sum("wrong") + F.count_if(F.col("pair").isNotNull() & ~F.col("pair").isin("01", "12", "21"))).alias("illegal"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "audit"))), lambda x: x["audit"]), "").alias("audit"),
    )
    of_rows = each.groupBy("key").agg(F.max("turn").alias("high"), F.min("turn").alias("low"), F.count_distinct("turn").alias("turns"), *(F.sum(c).alias(c) for c in ("blank", "repeated", "truncated")))
    all_ids = rows.groupBy("key").agg(F.first("conv_id").alias("conv_id"))
    joined = all_ids.join(of_rows, "key", "left").join(total, "key", "left").join(audits, "key", "left").join(hashes, "key", "left")
    number = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    summary = joined.select(
        "conv_id", number(F.col("high") - F.col("low") + 1 - F.col("turns"), "gaps"), number(F.col("blank"), "blank"), number(F.col("repeated"), "duplicate"), number(F.col("truncated"), "truncated"),
        number(F.col("illegal"), "illegal"), number(F.col("cost"), "cost"), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
    return summary, lines


def op13_conversation_repair(spark, sf_dir):
    return repair(damaged(table(spark, sf_dir, "conversations")))[0]


def oracle() -> str:
    """Backward dynamic programming by recursion: for each row and state the cheapest (cost, audit, repaired rows)."""
    made = lambda cost, letter, line, x: f"{{'c': {x}.c + {cost}, 'a': '{letter}' || {x}.a, 't': {line} || {x}.t}}"
    user, helper = "(chr(10) || 'user:')", "(chr(10) || 'assistant:')"

    def consumed(q: str, given: str, role: str, keeps: dict[str, str]) -> str:
        late = f"(CASE WHEN truncated THEN {TRUNCATED} ELSE 0 END)"
        keep = "".join(f" WHEN '{i}' THEN [{made(late, 'K', '(chr(10) || role || chr(58) || text)', to)}]" for i, to in keeps.items())
        ways = [f"[{made(DELETE, 'D', "''", q)}]", f"CASE WHEN gone THEN [] ELSE [{made(f'({REROLE} + {late})', 'R', f'({role} || text)', given)}] END"]
        if keep:
            ways.append(f"CASE WHEN gone THEN [] ELSE CASE initial{keep} ELSE [] END END")
        return f"list_sort({' || '.join(ways)})[1]"

    put = lambda own, line, x: f"list_sort([{own}, {made(INSERT, 'I', line, x)}])[1]"
    return f"""
WITH RECURSIVE src AS (SELECT conv_id, coalesce('=' || conv_id::VARCHAR, 'null') AS key, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS spot FROM conversations),
bytes AS (SELECT DISTINCT spot FROM src),
table8(b, c) AS (SELECT b, list_reduce(list_prepend(b::BIGINT, range(8)::BIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) FROM range(256) r(b)),
lookup AS (SELECT list(c ORDER BY b) AS t FROM table8),
crcs AS (SELECT spot, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(spot, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295::BIGINT) % 20 AS code FROM bytes, lookup),
dmg AS (SELECT key, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM src JOIN crcs USING (spot), range(2) x(copy) WHERE code <> 0 AND copy < CASE WHEN code = 3 THEN 2 ELSE 1 END),
numbered AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, left(role, 1) AS initial, regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g') AS solid FROM dmg),
r AS (SELECT *, solid = '' AS blank, solid <> '' AND row_number() OVER (PARTITION BY key, role, text ORDER BY i) > 1 AS again FROM numbered),
f AS (SELECT *, blank OR again AS gone, NOT blank AND NOT again AND right(solid, 1) NOT IN ('.', '!', '?') AS truncated,
  coalesce(lag(initial) OVER (PARTITION BY key ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS wrong FROM r),
v AS (SELECT key, count(*) + 1 AS i, {{'c': 0, 'a': '', 't': ''}} AS z, {{'c': {2 * INSERT}, 'a': 'II', 't': {user} || {helper}}} AS s, {{'c': {INSERT}, 'a': 'I', 't': {helper}}} AS u, {{'c': 0, 'a': '', 't': ''}} AS a FROM f GROUP BY key
  UNION ALL
  SELECT key, i, {put("z", user, "u2")}, {put("s", user, "u2")}, u2, a2 FROM (
    SELECT key, i, z, s, {put("u", helper, "a")} AS u2, {put("a", user, "u")} AS a2 FROM (
      SELECT v.key, f.i, {consumed("z", "u", user, {"s": "s", "u": "u"})} AS z, {consumed("s", "u", user, {"u": "u"})} AS s,
        {consumed("u", "a", helper, {"a": "a"})} AS u, {consumed("a", "u", user, {"u": "u"})} AS a
      FROM v JOIN f ON f.key = v.key AND f.i = v.i - 1))),
best AS (SELECT key, z FROM v WHERE i = 1),
st AS (SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (wrong) AS illegal FROM f GROUP BY key)
SELECT any_value(conv_id) AS conv_id, coalesce(any_value(gaps), 0)::BIGINT AS gaps, coalesce(any_value(blank), 0)::BIGINT AS blank, coalesce(any_value(duplicate), 0)::BIGINT AS duplicate,
  coalesce(any_value(truncated), 0)::BIGINT AS truncated, coalesce(any_value(illegal), 0)::BIGINT AS illegal, coalesce(any_value(z).c, 0)::BIGINT AS cost, coalesce(any_value(z).a, '') AS audit,
  sha256(coalesce(substr(any_value(z).t, 2), '')) AS repaired_sha256
FROM src LEFT JOIN st USING (key) LEFT JOIN best USING (key) GROUP BY key"""
