"""Suffix-array removal of repeated 100-byte strings, over all documents.

1. Each document is cut at content-defined anchors: the least hash of every 100-byte window's
   56-byte strings. Two equal 100-byte strings have equal anchors at equal offsets, so all places
   of a string meet under one anchor hash. What can repeat around an anchor is its excerpt: the
   44 bytes on either side.
2. Equal excerpts are settled by their hash: every place but the first is covered whole. This
   happens within each task first, then once more over the corpus, so that copies by the million
   reach the shuffle as one row a task.
3. Anchors with several different excerpts are compared by suffix array. The shared 56 bytes are
   one symbol; the excerpts of an anchor make one string. Its suffixes are sorted by linear
   grouping: groups of suffixes that share a Lyndon prefix are processed in descending order, and
   each splits the groups of its members' previous-smaller pointers by how many members point
   there; then the order within groups is emitted by following the same pointers from each sorted
   suffix. No symbols are renamed and nothing recurses. Many strings are sorted side by side.
   Anchors with many excerpts are first split by longer shared cores, so strings stay short.
4. Neighbours in suffix order that share a whole window are places of one 100-byte string; all
   but the first are covered. Anchors with more excerpts than a task may hold are compared window
   by window through a shuffle instead.

"First" is by id (null first), then by row, then by position. Null texts are empty; texts under
100 bytes lose nothing; repeated rows are documents of their own; an empty table gives an empty
result; columns other than id and text aren't read. Long texts are anchored piece by piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import TEXT_BATCH, batch_rows, cut, giving_back, plain_words, table, with_row

LENGTH, CORE = 100, 56
SIDE = LENGTH - CORE
#: Anchors that a task combines; bytes of a text that are anchored at a time; symbols sorted at a time.
COMBINED, PIECE, SYMBOLS = 1_000_000, 1 << 20, 300_000
#: Excerpts in one suffix-sorted string; excerpts of an anchor that a task holds.
STRING, HELD = 16, 200_000
#: Bits of the filter that spares documents without news a shuffle; it may let others through.
FILTER = 1 << 23

_U = np.uint64
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_FIRST = -(1 << 63)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(32))


_powers = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        ones = np.full(max(n, 1 << 16), base, np.uint64)
        ones[0] = 1
        _powers[base] = np.cumprod(ones)
    return _powers[base][:n]


def _running(values: np.ndarray, width: int, op) -> np.ndarray:
    """op over each window of the given width."""
    out, step = values, 1
    while step * 2 <= width:
        out, step = op(out[:-step], out[step:]), step * 2
    n = len(values) - width + 1
    return op(out[:n], out[width - step : width - step + n])


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, hash of the core, hash of the excerpt) of a text's anchors."""
    if len(data) > PIECE + 4 * LENGTH:
        found = []
        for at in range(0, len(data), PIECE):
            low = max(0, at - 2 * LENGTH)
            pos, core, excerpt = anchors(data[low : at + PIECE + 2 * LENGTH])
            pos = pos + low
            own = (pos >= at) & (pos < at + PIECE)
            found.append((pos[own], core[own], excerpt[own]))
        return tuple(map(np.concatenate, zip(*found)))
    n = len(data)
    if n < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    up, down = _powers_of(_BASE, n), _powers_of(_INVERSE, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[np.frombuffer(data, np.uint8)] * up, out=sums[1:])
    cores = _mix((sums[CORE:] - sums[: n - CORE + 1]) * down[: n - CORE + 1])
    least = _running(cores, SIDE + 1, np.minimum)
    pad = np.zeros(SIDE, np.uint64)
    # of all windows over a position, the largest minimum: equal to its own hash if it is some window's minimum
    at = np.nonzero(_running(np.concatenate([pad, least, pad]), SIDE + 1, np.maximum) == cores)[0]
    low, high = np.maximum(at - SIDE, 0), np.minimum(at + LENGTH, n)
    excerpt = _mix((sums[high] - sums[low]) * down[low] + ((at - low) * 128 + high - at).astype(np.uint64))
    return at, cores[at], excerpt


def _table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stage 1: anchors of the texts, combined within the task. stop > 0: an anchor whose text goes on for stop bytes, 100 at most; stop < 0: bytes pos to -stop are covered."""
    held, size = [], 0

    def combined() -> pa.RecordBatch:
        held.sort(key=lambda d: d[:2])
        count = [len(d[2]) for d in held]
        order, row = np.repeat([d[0] for d in held], count).astype(np.int64), np.repeat([d[1] for d in held], count).astype(np.int64)
        n = np.repeat([d[5] for d in held], count)
        pos, core, excerpt = (np.concatenate([d[i] for d in held]) for i in (2, 3, 4))
        key = core ^ (excerpt * _U(_BASE))
        by = np.argsort(key, kind="stable")
        new = np.ones(len(by), bool)
        new[1:] = (core[by][1:] != core[by][:-1]) | (excerpt[by][1:] != excerpt[by][:-1])
        first = np.zeros(len(by), bool)
        first[by[new]] = True
        again = ~first
        low, high, of, o = np.maximum(pos[again] - SIDE, 0), np.minimum(pos[again] + LENGTH, n[again]), row[again], order[again]
        begin = np.ones(len(low), bool)
        begin[1:] = (of[1:] != of[:-1]) | (low[1:] > high[:-1])
        at = np.nonzero(begin)[0]
        ends = high[np.append(at[1:], len(low)) - 1] if len(at) else high
        return _table(
            h=np.concatenate([core[first].view(np.int64), _mix(of[at].view(np.uint64)).view(np.int64)]),
            e=np.concatenate([excerpt[first].view(np.int64), np.zeros(len(at), np.int64)]),
            ord=np.concatenate([order[first], o[at]]),
            _row=np.concatenate([row[first], of[at]]),
            pos=np.concatenate([pos[first], low[at]]),
            stop=np.concatenate([np.minimum(n[first] - pos[first], LENGTH), -ends]).astype(np.int64),
        )

    for batch in batches:
        for order, row, text in zip(batch.column("ord").to_pylist(), batch.column("_row").to_pylist(), _texts(batch)):
            at, core, excerpt = anchors(text or b"")
            if len(at):
                held.append((order, row, at, core, excerpt, len(text)))
                size += len(at)
                if size >= COMBINED:
                    yield combined()
                    held, size = [], 0
    if held:
        yield combined()


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stage 2, over anchors in order of (h, e, ord, _row, pos): later places of an excerpt are covered (kind 0); firsts of anchors with several excerpts go on (kind 1)."""
    names = ["h", "e", "ord", "_row", "pos", "stop"]
    last, waiting, shown = None, None, False

    def out(kind, h, order, row, pos, stop):
        return _table(kind=np.full(len(h), kind, np.int32), h=h, ord=order, _row=row, pos=pos, stop=stop)

    for batch in batches:
        c = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}
        done = c["stop"] < 0
        if done.any():
            yield out(0, c["h"][done], c["ord"][done], c["_row"][done], c["pos"][done], -c["stop"][done])
            c = {k: v[~done] for k, v in c.items()}
        h, e = c["h"], c["e"]
        if not len(h):
            continue
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (e[1:] != e[:-1])
        new[0] = last != (h[0], e[0])
        last = (h[-1], e[-1])
        old = ~new
        if old.any():
            yield out(0, h[old], c["ord"][old], c["_row"][old], np.maximum(c["pos"][old] - SIDE, 0), c["pos"][old] + c["stop"][old])
        firsts = {k: v[new] for k, v in c.items()}
        if not len(firsts["h"]):
            continue
        if waiting is not None:  # the last first of the batch before
            firsts = {k: np.concatenate([[waiting[k]], firsts[k]]) for k in names}
        fh = firsts["h"]
        same = fh[1:] == fh[:-1]
        needed = np.zeros(len(fh), bool)
        needed[1:] |= same
        needed[:-1] |= same
        if waiting is not None and shown:
            needed[0] = False
        final = needed.copy()
        final[-1] = needed[-1]
        if final.any():
            yield out(1, fh[final], firsts["ord"][final], firsts["_row"][final], firsts["pos"][final], firsts["stop"][final])
        shown = bool(needed[-1]) or (len(fh) == 1 and waiting is not None and shown)
        waiting = {k: firsts[k][-1] for k in names}


# ---- linear grouping -----------------------------------------------------------------------


def sort_suffixes(text: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Suffix arrays of many strings: text is (strings, symbols), each string of its length ends in a 0 that it has nowhere else."""
    rows, n = text.shape
    column, every = np.arange(n, dtype=np.int32), np.arange(rows)
    inside = column[None, :] < length[:, None]
    # a group is named by the number of suffixes in lower groups; first groups: by first symbol
    by = np.argsort(np.where(inside, text, np.iinfo(text.dtype).max), axis=1, kind="stable")
    sorted_text = np.take_along_axis(text, by, 1)
    begins = np.ones((rows, n), bool)
    begins[:, 1:] = sorted_text[:, 1:] != sorted_text[:, :-1]
    starts = np.maximum.accumulate(np.where(begins, column, 0), axis=1)
    group = np.full((rows, n), n + 1, np.int32)
    np.put_along_axis(group, by, starts, 1)
    group[~inside] = n + 1
    end_of = np.zeros((rows, n + 2), np.int32)  # by the group's start
    start_of = np.zeros((rows, n + 2), np.int32)  # by the group's end
    r, s = np.nonzero(begins & inside)
    e = np.append(s[1:], 0)
    closes = np.append(r[1:] != r[:-1], True)
    e[closes] = length[r[closes]]
    end_of[r, s], start_of[r, e] = e, s
    before = np.full((rows, n), -1, np.int32)
    # phase 1: from the highest group down
    live, upto = every, length.astype(np.int32).copy()
    while len(live):
        now = start_of[live, upto[live]]
        own = group if len(live) == rows else group[live]
        at, s = np.nonzero(own == now[:, None])
        smaller = np.maximum.accumulate(np.where(own < now[:, None], column, np.int32(-1)), axis=1)
        p, r = smaller[at, s], live[at]
        before[r, s] = p
        upto[live] = now
        r, p = r[p >= 0], p[p >= 0]
        live = live[now > 0]
        if not len(r):
            continue
        flat, times = np.unique(r.astype(np.int64) * n + p, return_counts=True)
        r, p = flat // n, flat % n
        g = group[r, p]
        by = np.lexsort((times, g, r))
        r, p, g, times = r[by], p[by], g[by], times[by]
        # blocks: one group's pointed-at members; runs in them: those with equally many pointers
        new_block = np.ones(len(r), bool)
        new_block[1:] = (r[1:] != r[:-1]) | (g[1:] != g[:-1])
        new_run = new_block.copy()
        new_run[1:] |= times[1:] != times[:-1]
        index = np.arange(len(r))
        block = np.nonzero(new_block)[0]
        sizes = np.diff(np.append(block, len(r)))
        which = np.cumsum(new_block) - 1
        run = np.nonzero(new_run)[0]
        run_of = run[np.cumsum(new_run) - 1]
        bottom = end_of[r[block], g[block]] - sizes
        name = bottom[which] + run_of - block[which]
        group[r, p] = name
        top = name[run] + np.diff(np.append(run, len(index)))
        rest = bottom > g[block]  # members that nothing points at keep the group's name
        end_of[r[block][rest], g[block][rest]], start_of[r[block][rest], bottom[rest]] = bottom[rest], g[block][rest]
        end_of[r[run], name[run]], start_of[r[run], top] = top, name[run]
    # phase 2: from the smallest suffix up
    order = np.full((rows, n), -1, np.int32)
    free = np.broadcast_to(np.arange(n + 2, dtype=np.int32), (rows, n + 2)).copy()
    placed = np.zeros((rows, n), bool)
    order[:, 0] = length - 1
    placed[every, length - 1] = True
    for i in range(n):
        r = every[length > i]
        j = order[r, i] - 1
        while len(r):
            go = j >= 0
            go[go] = ~placed[r[go], j[go]]
            r, j = r[go], j[go]
            if not len(r):
                break
            g = group[r, j]
            order[r, free[r, g]] = j
            free[r, g] += 1
            placed[r, j] = True
            j = before[r, j]
    return order


class Comparer:
    """Collects buckets of excerpts and yields covered ranges (ord, _row, low, high)."""

    def __init__(self):
        self.waiting: dict[tuple[int, int], list] = {}
        self.sizes: dict[tuple[int, int], int] = {}
        self.covered: list[tuple] = []

    def add(self, items: list[tuple]) -> None:
        """items of one anchor: (ord, _row, pos, left, right), in order."""
        todo = [(items, 0, SIDE)]
        while todo:
            items, x, y = todo.pop()
            # a window takes x to y bytes on the left, and the rest of SIDE on the right
            seen: dict = {}
            for it in items:
                left, right = it[3], it[4]
                key = (left[-y:] if y else b"", right[: SIDE - x])
                if key in seen:
                    low, high = max(x, SIDE - len(right)), min(y, len(left))
                    if low <= high:
                        self.covered.append((it[0], it[1], it[2] - high, it[2] - low + LENGTH))
                else:
                    seen[key] = it
            items = list(seen.values())
            if len(items) < 2 or x == y:
                continue
            if len(items) <= STRING:
                kind = (y - x, 2 if len(items) == 2 else 4 if len(items) <= 4 else 8 if len(items) <= 8 else STRING)
                self.waiting.setdefault(kind, []).append((items, x, y))
                self.sizes[kind] = self.sizes.get(kind, 0) + len(items) * (2 * (y - x) + 2)
                if self.sizes[kind] >= SYMBOLS:
                    self.compare(kind)
                continue
            mid = (x + y) // 2
            for low, high, part in ((mid + 1, y, lambda it: it[3][-(mid + 1) :] if len(it[3]) > mid else None), (x, mid, lambda it: it[4][: SIDE - mid] if len(it[4]) >= SIDE - mid else None)):
                groups: dict = {}
                for it in items:
                    if (key := part(it)) is not None:
                        groups.setdefault(key, []).append(it)
                todo += [(g, low, high) for g in groups.values() if len(g) > 1]

    def finish(self) -> None:
        for kind in list(self.waiting):
            self.compare(kind)

    def compare(self, kind: tuple[int, int]) -> None:
        buckets, self.sizes[kind] = self.waiting.pop(kind), 0
        span = kind[0]
        strings, row_at, spot, who, back = [], [], [], [], []
        owners = []
        for b, (items, x, y) in enumerate(buckets):
            parts, at = [], 0
            for it in items:
                left = it[3][-y:][: len(it[3][-y:]) - x] if x else it[3][-y:]
                right = it[4][SIDE - y : SIDE - x]
                # 255 is the shared core, 254 ends an excerpt; text has neither
                parts.append(left + b"\xff" + right + b"\xfe")
                for q in range(max(0, span - len(right)), len(left) + 1):
                    row_at.append(b)
                    spot.append(at + len(left) - q)
                    who.append(len(owners))
                    back.append(x + q)
                at += len(left) + len(right) + 2
                owners.append(it[:3])
            strings.append(b"".join(parts))
        if not spot:
            return
        length = np.array([len(s) + 1 for s in strings])
        text = np.zeros((len(strings), int(length.max()) + span + 1), np.int16)
        for b, s in enumerate(strings):
            text[b, : len(s)] = np.frombuffer(s, np.uint8)
            text[b, : len(s)] += 1
        order = sort_suffixes(text[:, : int(length.max())], length)
        rank = np.empty_like(order)
        held = order >= 0
        rr, slots = np.nonzero(held)
        rank[rr, order[rr, slots]] = slots
        row_at, spot, who, back = map(np.array, (row_at, spot, who, back))
        by = np.lexsort((rank[row_at, spot], row_at))
        row_at, spot, who, back = row_at[by], spot[by], who[by], back[by]
        windows = np.lib.stride_tricks.sliding_window_view(text, span + 1, axis=1)[row_at, spot]
        new = np.ones(len(by), bool)
        new[1:] = (row_at[1:] != row_at[:-1]) | (windows[1:] != windows[:-1]).any(axis=1)
        of = np.cumsum(new) - 1
        owner = np.array(owners, np.int64)[who]
        order_id, row, start = owner[:, 0], owner[:, 1], owner[:, 2] - back
        by = np.lexsort((start, row, order_id, of))
        of, order_id, row, start = of[by], order_id[by], row[by], start[by]
        new = np.ones(len(of), bool)
        new[1:] = of[1:] != of[:-1]
        first = np.nonzero(new)[0][np.cumsum(new) - 1]
        later = (row != row[first]) | (start != start[first])
        self.covered += zip(order_id[later].tolist(), row[later].tolist(), start[later].tolist(), (start[later] + LENGTH).tolist())


def _merged(covered: list[tuple]) -> tuple[np.ndarray, ...]:
    """Ranges of each row joined where they touch."""
    c = np.array(covered, np.int64).reshape(-1, 4)
    c = c[np.lexsort((c[:, 2], c[:, 1]))]
    begin = np.ones(len(c), bool)
    reach = c[:, 3].copy()
    # ranges have bounded length, so a few sweeps carry the farthest end along
    while True:
        carried = reach.copy()
        same = c[1:, 1] == c[:-1, 1]
        carried[1:] = np.where(same & (c[1:, 2] <= reach[:-1]), np.maximum(reach[1:], reach[:-1]), reach[1:])
        if (carried == reach).all() or len(c) < 2:
            break
        reach = carried
    begin[1:] = (c[1:, 1] != c[:-1, 1]) | (c[1:, 2] > reach[:-1])
    at = np.nonzero(begin)[0]
    high = np.maximum.reduceat(c[:, 3], at) if len(at) else c[:0, 3]
    return c[at, 0], c[at, 1], c[at, 2], high


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stage 4, over excerpts in order of (h, ord, _row, pos): covered ranges (kind 0); of anchors too large to hold, every window by its hash (kind 2)."""
    comparer, items, current, streaming = Comparer(), [], None, False

    def ranges():
        order, row, low, high = _merged(comparer.covered)
        comparer.covered = []
        zero = np.zeros(len(row), np.int64)
        return _table(kind=zero.astype(np.int32), w1=zero, w2=zero, ord=order, _row=row, pos=low, stop=high)

    def windows(h, its):
        rows = []
        for order, row, pos, left, right in its:
            for r in range(max(0, SIDE - len(right)), len(left) + 1):
                d = xxhash.xxh3_128_digest(int(h).to_bytes(8, "little", signed=True) + bytes([r]) + left[len(left) - r :] + right[: SIDE - r])
                rows.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), order, row, pos - r))
        w = np.array(rows, np.int64).reshape(-1, 5)
        return _table(kind=np.full(len(w), 2, np.int32), w1=w[:, 0], w2=w[:, 1], ord=w[:, 2], _row=w[:, 3], pos=w[:, 4], stop=w[:, 4] + LENGTH)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("h", "ord", "_row", "pos", "left", "right")]
        for h, *item in zip(*columns):
            if h != current:
                if streaming and items:
                    yield windows(current, items)
                elif len(items) > 1:
                    comparer.add(items)
                items, current, streaming = [], h, False
            items.append(tuple(item))
            if len(items) >= (2000 if streaming else HELD):
                yield windows(h, items)
                items, streaming = [], True
        if len(comparer.covered) > 200_000:
            yield ranges()
    if streaming and items:
        yield windows(current, items)
    elif len(items) > 1:
        comparer.add(items)
    comparer.finish()
    if comparer.covered:
        yield ranges()


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stage 3: the two sides of each anchor that goes on."""
    for batch in batches:
        rows = []
        for order, row, text, firsts in zip(batch.column("ord").to_pylist(), batch.column("_row").to_pylist(), _texts(batch), batch.column("firsts").to_pylist()):
            rows += [(f["h"], order, row, f["pos"], text[max(0, f["pos"] - SIDE) : f["pos"]], text[f["pos"] + CORE : f["pos"] + LENGTH]) for f in firsts]
            if len(rows) > 20_000:
                yield _excerpts(rows)
                rows = []
        if rows:
            yield _excerpts(rows)


def _excerpts(rows: list[tuple]) -> pa.RecordBatch:
    h, order, row, pos, left, right = zip(*rows)
    return _table(h=pa.array(h, pa.int64()), ord=pa.array(order, pa.int64()), _row=pa.array(row, pa.int64()), pos=pa.array(pos, pa.int64()), left=pa.array(left, pa.binary()), right=pa.array(right, pa.binary()))


def _likely(docs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents whose _row may be in rows, the others): a filter of fixed size, for less shuffle only; no Python, whose workers would lie beside those that the documents go to."""
    spot = F.pmod(F.xxhash64("_row"), F.lit(FILTER))
    bit = F.expr("bit_or(shiftleft(1L, cast(_spot % 64 as int)))").alias("_bits")
    words = cut(rows.select(spot.alias("_spot")).groupBy(F.shiftright("_spot", 6).alias("_word")).agg(bit))  # FILTER / 64 rows at most
    marked = docs.withColumn("_word", F.shiftright(spot, 6)).join(F.broadcast(words), "_word", "left")
    maybe = F.col("_bits").isNotNull() & (F.getbit("_bits", spot % 64) == 1)
    return tuple(marked.where(x).select(*docs.columns) for x in (maybe, ~maybe))


def covered_ranges(docs: DataFrame) -> DataFrame:
    """(_row, low, high): ranges of bytes to remove, possibly overlapping. docs: ord, _row, text."""
    places = "ord long, _row long, pos long, stop long"
    found = docs.select("ord", "_row", "text").mapInArrow(giving_back(_find), f"h long, e long, {places}")
    settled = cut(found.repartition("h").sortWithinPartitions("h", "e", "ord", "_row", "pos").mapInArrow(giving_back(_settle), f"kind int, h long, {places}"))
    firsts = settled.where("kind = 1")
    wanted = firsts.groupBy("_row").agg(F.collect_list(F.struct("h", "pos")).alias("firsts"))  # at most one a byte of the document
    excerpts = _likely(docs.select("ord", "_row", "text"), firsts)[0].join(wanted, "_row").select("ord", "_row", "text", "firsts").mapInArrow(giving_back(_cut_out), "h long, ord long, _row long, pos long, left binary, right binary")
    compared = cut(excerpts.repartition("h").sortWithinPartitions("h", "ord", "_row", "pos").mapInArrow(giving_back(_compare), f"kind int, w1 long, w2 long, {places}"))
    large = compared.where("kind = 2")
    first = large.groupBy("w1", "w2").agg(F.min(F.struct("ord", "_row", "pos")).alias("first"))
    later = large.join(first, ["w1", "w2"]).where("first._row <> _row or first.pos <> pos")
    ranges = [x.select("_row", F.col("pos").alias("low"), F.col("stop").alias("high")) for x in (settled.where("kind = 0"), compared.where("kind = 0"), later)]
    return ranges[0].union(ranges[1]).union(ranges[2])


def remaining(data: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left of a text, and the number of removed runs."""
    kept, at, runs, end = [], 0, 0, -1
    for low, high in sorted(ranges):
        if low > end:
            runs += 1
            kept.append(data[at:low])
            end = high
        end = max(end, high)
        at = end
    kept.append(data[at:])
    return b"".join(kept), runs


def prepared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more) -> DataFrame:
    batch_rows(docs.sparkSession, 4 * TEXT_BATCH)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)
    return with_row(picked).withColumn("ord", F.coalesce("doc_id", F.lit(_FIRST)))


def dedup(docs: DataFrame, decoded: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents that lose something, the others), with the columns of docs; the first also with n_removed, n_spans, kept (binary; decoded: a string, from which characters that lost some bytes are gone). docs: as prepared() gives them."""
    ranges = cut(covered_ranges(docs))
    per_row = ranges.groupBy("_row").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))

    @F.pandas_udf(f"n_removed long, n_spans long, kept {'string' if decoded else 'binary'}")
    def take_out(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        rows = []
        for text, spans in zip(texts, ranges):
            data = text.encode("utf-8", "surrogatepass")
            kept, runs = remaining(data, [(s["low"], s["high"]) for s in spans])
            rows.append((len(data) - len(kept), runs, kept.decode("utf-8", "ignore") if decoded else kept))
        return pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept"])

    # else a filter on what it gives would have it run twice, in two workers a task
    once = take_out.asNondeterministic()
    maybe, others = _likely(docs, ranges)
    met = maybe.join(per_row, "_row", "left")
    lost = met.where("ranges is not null").withColumn("out", once("text", "ranges")).select(*docs.columns, "out.*")
    return lost, others.unionByName(met.where("ranges is null").select(*docs.columns))


def rest_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with the repeated strings gone from their texts; a character that lost some of its bytes goes whole, and a document without a word left goes too."""
    lost, others = dedup(prepared(docs, id_col, text_col, F.struct(*docs.columns).alias("carried")), decoded=True)
    shorter = lost.select("carried", F.col("kept").alias("rest")).where(F.size(plain_words(F.col("rest"))) > 0)
    new = {text_col: F.col("rest"), length_col: F.length("rest").cast("long")}
    return others.select("carried.*").unionByName(shorter.select(*[new[c].alias(c) if c in new else F.col("carried")[c].alias(c) for c in docs.columns]))


def op5_suffix_dedup(spark, sf_dir):
    docs = prepared(table(spark, sf_dir, "documents"))
    lost, others = dedup(docs)
    n_bytes, zero = F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long")
    return lost.select("doc_id", n_bytes, "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")).unionByName(
        others.select("doc_id", n_bytes, zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    )
