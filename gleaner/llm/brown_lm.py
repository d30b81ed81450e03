"""Language-model scores from Brown class-based bigrams.

P(w | v) = P(class of w | class of v) * P(w | class of w). Counts of all training tokens are kept
in Spark, keyed by a 64-bit hash of the word. Every word of the training texts that is seen often
enough (LEAST_SEEN times) is assigned to a class by exchange clustering, in two steps:

1. The commonest words, whose counts travel with the tasks, take part in rounds of exchange: a
   round moves words to the class that raises the likelihood of the class bigrams most. A round
   that doesn't raise it is undone and moves fewer words at a time.
2. All other words, however many there are, stay in Spark as a table. Each is moved once, to the
   class that its predecessors' classes make likeliest, and adds its counts to the class bigrams.
   As predecessors these words count by their shape: the class of the predicted word and the
   class of the history may differ, as in predictive class bigrams (Uszkoreit and Brants 2008).

Rarer words and words that training hasn't seen share classes by their shape, so that a class is
known from the word alone.

Null texts are empty texts: one end token. The training fold is told by crc32 of the id as text
(null ids: the empty string); repeated rows are rows of their own; of equally common words the
one with the smaller hash comes first; an empty table gives an empty result; only the id and text
columns are read. A text of any length is one row's work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import NUMBER_BATCH, TEXT_BATCH, batch_rows, giving_back, table, with_row, written

_TO_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
#: Words that travel with the tasks and are clustered in rounds; times that a clustered word must be seen; classes; shape classes; rounds of exchange.
RESOLVED, LEAST_SEEN, CLASSES, SHAPES, ROUNDS = 65_536, 3, 64, 32, 8
TOTAL = CLASSES + SHAPES
#: Lists of neighbours that a task looks at together.
LISTS_BATCH = 1000
#: Entries that a task merges before it hands them on.
MERGED = 500_000
#: Weight of the class unigram in the smoothed class bigram.
BACKOFF = 8.0
END = b""


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def tokens(text: str | None) -> list[bytes]:
    """Words of the lower-cased text, then the end."""
    return [*(text or "").encode("utf-8", "surrogatepass").translate(_TO_LOWER).split(), END]


#: Bytes that are hashed at a time; words longer than this many bytes go by XXH64.
_CHUNK, _LONG = 1 << 20, 64
_SPACE, _ALPHA, _KIND = np.zeros(256, bool), np.zeros(256, bool), np.full(256, 3, np.int64)
_SPACE[list(b"\t\n\x0b\x0c\r ")] = True
_ALPHA[list(range(97, 123)) + list(range(65, 91))] = True
_KIND[_ALPHA], _KIND[list(b"0123456789")], _KIND[list(b"aeiouy")] = 1, 2, 0
_LOWER = np.frombuffer(_TO_LOWER, np.uint8)
_BYTES = np.random.default_rng(9).integers(0, 1 << 64, 256, np.uint64)
_FACTOR = 0x9E3779B97F4A7C15


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor and of its inverse, modulo 2 ** 64."""
    up, down = (np.full(_CHUNK + _LONG, x, np.uint64) for x in (_FACTOR, pow(_FACTOR, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word data[start:end]; words are apart and in order. A word's hash is a sum over its bytes, taken as a difference of running sums."""
    up, down = _powers()
    sizes = ends - starts
    out = sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    low = 0
    while low < len(starts):
        first = int(starts[low])
        high = int(np.searchsorted(starts, first + _CHUNK))
        part = data[first : first + _CHUNK + _LONG]
        run = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * up[: len(part)], dtype=np.uint64, out=run[1:])
        at = starts[low:high] - first
        out[low:high] += (run[at + np.minimum(sizes[low:high], _LONG)] - run[at]) * down[at]
        low = high
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    out ^= out >> np.uint64(29)
    for i in np.nonzero(sizes > _LONG)[0].tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), 9)
    return out.view(np.int64)


def _hash(word: bytes) -> int:
    return int(hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0]) if word else 0


@lru_cache(1 << 18)
def shape_class(word: bytes) -> int:
    """A class number from CLASSES up, told by length, ending and characters."""
    last = word[-1:]
    kind = 0 if last in b"aeiouy" else 1 if last.isalpha() else 2 if last.isdigit() else 3
    odd = 0 if word.isalpha() else 1
    return CLASSES + (min(len(word) // 3, 3) * 8 + kind * 2 + odd) % SHAPES


def token_arrays(texts: pa.Array, shapes: bool = True) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """tokens() of all texts (not null) one after the other: hashes, shape classes, and where each text begins; an end follows each text, so that it stands before the next one, too."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, bounds, content = texts.buffers()
    bounds = np.frombuffer(bounds, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(content or b"", np.uint8)[bounds[0] : bounds[-1]]
    data, bounds = _LOWER[data], bounds - bounds[0]
    # a place where a run of white space, or a text, begins or ends
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    word = ~_SPACE[data]
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= ~word[:-1]
    after[:-1] |= ~word[1:]
    starts, ends = np.nonzero(word & before)[0], np.nonzero(word & after)[0] + 1
    words_until = np.searchsorted(starts, bounds)
    begins = words_until[:-1] + np.arange(len(texts))
    of = np.arange(len(starts)) + np.repeat(np.arange(len(texts)), np.diff(words_until))
    hashed = np.zeros(len(starts) + len(texts), np.int64)
    hashed[of] = hashes(data, starts, ends)
    if not shapes:
        return hashed, None, begins
    shaped = np.full(len(hashed), shape_class(END), np.int64)
    letters = np.zeros(len(data) + 1, np.int32)
    np.cumsum(_ALPHA[data], dtype=np.int32, out=letters[1:])
    sizes = ends - starts
    odd = (letters[ends] - letters[starts]) != sizes
    shaped[of] = CLASSES + (np.minimum(sizes // 3, 3) * 8 + _KIND[data[ends - 1]] * 2 + odd) % SHAPES
    return hashed, shaped, begins


def sliced(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The columns as batches of bounded size."""
    n = len(next(iter(columns.values())))
    for i in range(0, n, NUMBER_BATCH):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + NUMBER_BATCH]) for c in columns.values()], list(columns))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(hash, n) of every training token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        seen, n = np.empty(0, np.int64), np.empty(0, np.int64)

        def merged():
            own, times = np.unique(np.concatenate(parts), return_counts=True)
            both, at = np.unique(np.concatenate([seen, own]), return_inverse=True)
            return both, np.bincount(at, np.concatenate([n, times])).astype(np.int64)

        for batch in batches:
            if len(batch):
                parts.append(token_arrays(batch.column("text"), shapes=False)[0])
                size += len(parts[-1])
            if size > 2 * MERGED:
                seen, n = merged()
                parts, size = [], 0
                if len(seen) > MERGED:
                    yield from sliced({"hash": seen, "n": n})
                    seen, n = seen[:0], n[:0]
        if parts:
            seen, n = merged()
        yield from sliced({"hash": seen, "n": n})

    counted = docs.where(~F.col("held_out")).select("text").mapInArrow(giving_back(count), "hash long, n long")
    return counted.groupBy("hash").agg(F.sum("n").alias("n"))


class Lexicon:
    """The commonest words for use inside tasks, by falling count: their hashes and counts. At most RESOLVED words."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        self.hashes, self.counts = hashes, counts
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]

    def codes(self, hashed: np.ndarray, shaped: np.ndarray) -> np.ndarray:
        """The words' ranks; for words outside, -1 - shape class."""
        outside = -1 - shaped
        if not len(self.sorted):
            return outside
        at = np.minimum(np.searchsorted(self.sorted, hashed), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashed, self.order[at], outside)

    def narrow(self, codes: np.ndarray) -> np.ndarray:
        """Codes as indices into the class table: the lexicon's words come first, then the shape classes, by which all others count as predecessors."""
        return np.where(codes >= 0, codes, len(self.hashes) - 1 - codes)

    def end(self) -> np.ndarray:
        """The end's index into the class table, in an array."""
        return self.narrow(self.codes(np.array([_hash(END)]), np.array([shape_class(END)])))


def bigrams(docs: DataFrame, lexicon) -> DataFrame:
    """(a, b, hash, n): neighbouring training tokens; a text begins after an end.

    a and b are indices into the class table. Words of the lexicon are counted within tasks and
    have no hash; others (rare) have theirs, and b is their shape class.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, parts, size = lexicon.value, [], 0
        end, width = lex.end(), len(lex.hashes) + TOTAL

        def rows() -> Iterator[pa.RecordBatch]:
            pairs, n = np.unique(np.concatenate(parts), return_counts=True)
            for i in range(0, len(pairs), NUMBER_BATCH):
                part = pairs[i : i + NUMBER_BATCH]
                columns = [pa.array((part // width).astype(np.int32)), pa.array((part % width).astype(np.int32)), pa.nulls(len(part), pa.int64()), pa.array(n[i : i + NUMBER_BATCH].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "hash", "n"])

        for batch in batches:
            if not len(batch):
                continue
            hashed, shaped, _ = token_arrays(batch.column("text"))
            codes = lex.codes(hashed, shaped)
            c = np.concatenate([end, lex.narrow(codes)])
            known = codes >= 0
            parts.append((c[:-1] * width + c[1:])[known])
            at = np.nonzero(~known)[0]
            yield from sliced({"a": c[at].astype(np.int32), "b": c[at + 1].astype(np.int32), "hash": hashed[at], "n": np.ones(len(at), np.int32)})
            size += len(c)
            if size > 4 * MERGED:
                yield from rows()
                parts, size = [], 0
        if parts:
            yield from rows()

    return docs.where(~F.col("held_out")).select("text").mapInArrow(giving_back(count), "a int, b int, hash long, n int")


def _matrix(rows: DataFrame) -> np.ndarray:
    """From (at, n), at = class before * TOTAL + class."""
    matrix = np.zeros(TOTAL * TOTAL)
    for r in rows.groupBy("at").agg(F.sum("n").alias("n")).collect():
        matrix[r["at"]] = r["n"]
    return matrix.reshape(TOTAL, TOTAL)


def likelihood(matrix: np.ndarray) -> float:
    """Of the class bigrams, without what doesn't depend on the classes: sum of n log n over pairs, less that over either class."""
    part = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    return part(matrix) - part(matrix.sum(0)) - part(matrix.sum(1))


def neighbours(pairs: DataFrame) -> DataFrame:
    """(w, others, counts): of each entry of the class table what stands next to it, written once for all rounds; others holds 2 b for b after it and 2 a + 1 for a before it.

    A list has at most two entries for each of the table's.
    """
    both = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("w"), (2 * F.col("b")).alias("other"), "n"), F.struct(F.col("b").alias("w"), (2 * F.col("a") + 1).alias("other"), "n"))))
    listed = both.groupBy("w").agg(F.collect_list(F.struct("other", "n")).alias("seen"))
    return written(listed.select("w", F.col("seen.other").alias("others"), F.col("seen.n").alias("counts")))


def _by_class(batch: pa.RecordBatch, assigned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a batch of neighbours() the words, and a row for each: counts of the classes after it, then of those before it."""
    w, others, counts = (batch.column(c) for c in ("w", "others", "counts"))
    of = np.repeat(np.arange(len(w)), np.diff(others.offsets.to_numpy()))
    other = others.flatten().to_numpy()
    at = of * 2 * TOTAL + assigned[other >> 1] + TOTAL * (other & 1)
    return w.to_numpy().astype(np.int64), np.bincount(at, counts.flatten().to_numpy(), len(w) * 2 * TOTAL).reshape(len(w), 2 * TOTAL)


def exchange(pairs: DataFrame, clustered: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """The class table - the class of each clustered word, then of each shape class (its own) -, the class bigrams, and their likelihood after each round.

    A round counts, in Spark, the classes before and after each word and moves the word to the class
    under which its occurrences are likeliest, given the class bigrams. Words move in turn (every
    second one at first), so that two neighbours don't swap for ever. If a round has lowered the
    likelihood, it is undone and half as many words move at a time. Rounds read the lists of neighbours
    and shuffle nothing but sums. The driver gets one number a clustered word and one a pair of classes.
    """
    spark = pairs.sparkSession
    lists = neighbours(pairs)
    batch_rows(spark, LISTS_BATCH)
    assigned = np.concatenate([np.arange(clustered) % CLASSES, np.arange(TOTAL)])  # the commonest words seed the classes
    best, turns = None, 2
    history: list[float] = []
    for turn in range(rounds + 1):

        def summed(batches: Iterator[pa.RecordBatch], assigned=assigned) -> Iterator[pa.RecordBatch]:
            matrix = np.zeros((TOTAL, TOTAL))
            for batch in batches:
                w, counts = _by_class(batch, assigned)
                np.add.at(matrix, assigned[w], counts[:, :TOTAL])
            at = np.nonzero(matrix.ravel())[0]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(matrix.ravel()[at].astype(np.int64))], ["at", "n"])

        matrix = _matrix(lists.mapInArrow(summed, "at long, n long"))
        if not history or likelihood(matrix) > history[-1]:
            best = assigned, matrix
            history.append(likelihood(matrix))
        else:
            assigned, matrix = best
            turns *= 2
        if turn == rounds:
            break
        log, tokens_of = np.log(matrix + 0.5), np.log(matrix.sum(0) + 1)

        def move(batches: Iterator[pa.RecordBatch], assigned=assigned, log=log, tokens_of=tokens_of) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                w, counts = _by_class(batch, assigned)
                after, before = counts[:, :TOTAL], counts[:, TOTAL:]
                gain = after @ log.T + before @ log - 2 * after.sum(1)[:, None] * tokens_of[None, :]
                yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(gain[:, :CLASSES].argmax(1))], ["w", "k"])

        now = assigned.copy()
        for r in lists.where((F.col("w") < clustered) & (F.col("w") % turns == turn % turns)).mapInArrow(move, "w long, k long").collect():
            now[r["w"]] = r["k"]
        assigned = now
    return best[0], best[1], history


def commonest(words: DataFrame, most: int) -> DataFrame:
    """The rows of the most common words, at most so many: all with a count above some number, and of those with that number the ones with the smallest hashes."""
    # counts fall into narrow bins, of which there are a few hundred; a bin that doesn't fit is looked at by count, then by hash
    fine = F.floor(F.log("n") * 16)
    room, low, kept = most, None, F.lit(False)
    for r in sorted(words.groupBy(fine.alias("bin")).agg(F.count("*").alias("v"), F.min("n").alias("low")).collect(), key=lambda r: -r["bin"]):
        if r["v"] > room:
            inside = words.where(fine == r["bin"])
            counts = sorted(inside.groupBy("n").agg(F.count("*").alias("v")).orderBy(F.desc("n")).limit(most + 1).collect(), key=lambda c: -c["n"])
            for c in counts:
                if c["v"] > room:
                    last = inside.where(F.col("n") == c["n"]).orderBy("hash").limit(room).agg(F.max("hash").alias("h")).first()["h"] if room else None
                    kept = (F.col("n") == c["n"]) & (F.col("hash") <= last) if last is not None else F.lit(False)
                    break
                room, low = room - c["v"], c["n"]
            break
        room, low = room - r["v"], r["low"]
    return words.where(kept if low is None else kept | (F.col("n") >= low))


def classified(rare: DataFrame, assigned: np.ndarray, matrix: np.ndarray, first_shape: int) -> DataFrame:
    """(hash, n, k, seen): the words outside the lexicon with their counts, classes, and counts by class of the predecessor. rare: as bigrams() gives it."""
    log, tokens_of = np.log(matrix[:, :CLASSES] + 0.5), np.log(matrix.sum(0)[:CLASSES] + 1)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_numpy() for c in "ab")
            columns = [batch.column("hash"), pa.array((b - first_shape).astype(np.int32)), pa.array(assigned[a].astype(np.int32)), batch.column("n")]
            yield pa.RecordBatch.from_arrays(columns, ["hash", "shape", "h", "n"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shape, seen = batch.column("shape").to_numpy(), batch.column("seen")
            of = np.repeat(np.arange(len(batch)), np.diff(seen.offsets.to_numpy()))
            h, n = (x.to_numpy() for x in seen.flatten().flatten())
            k = shape.astype(np.int64)
            often = batch.column("n").to_numpy() >= LEAST_SEEN
            row = np.cumsum(often) - 1
            used = often[of]
            # counts by class of the predecessor, of the words that are clustered
            counts = np.bincount(row[of[used]] * TOTAL + h[used], n[used], int(often.sum()) * TOTAL).reshape(-1, TOTAL)
            k[often] = (counts @ log - counts.sum(1)[:, None] * tokens_of).argmax(1)
            yield pa.RecordBatch.from_arrays([batch.column("hash"), batch.column("n"), pa.array(k), seen], ["hash", "n", "k", "seen"])

    moved = rare.mapInArrow(named, "hash long, shape int, h int, n int").repartition("hash")
    by_class = moved.groupBy("hash", "shape", "h").agg(F.sum("n").alias("n"))
    whole = by_class.groupBy("hash", "shape").agg(F.sum("n").alias("n"), F.collect_list(F.struct("h", "n")).alias("seen"))  # at most TOTAL entries
    return whole.mapInArrow(giving_back(best), "hash long, n long, k long, seen array<struct<h: int, n: long>>")


def learn(docs: DataFrame, resolved: int = RESOLVED) -> dict:
    """The model. docs: text, held_out. Counts and classes of all but the commonest words stay in Spark; everything else is bounded by the parameters."""
    spark = docs.sparkSession
    counted = written(vocabulary(docs))
    whole = counted.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    top = commonest(counted.where(F.col("n") >= LEAST_SEEN), resolved).toPandas().sort_values(["n", "hash"], ascending=[False, True])
    lexicon = Lexicon(top["hash"].to_numpy(np.int64), top["n"].to_numpy(np.int64))
    shared = spark.sparkContext.broadcast(lexicon)
    found = written(bigrams(docs, shared))
    batch_rows(spark, 4 * NUMBER_BATCH)
    pairs = written(found.where("hash is null").groupBy("a", "b").agg(F.sum("n").alias("n")))
    assigned, matrix, history = exchange(pairs, len(top))
    batch_rows(spark, 4 * NUMBER_BATCH)
    words = written(classified(found.where("hash is not null"), assigned, matrix, len(top)))
    matrix = matrix + _matrix(words.select("k", F.explode("seen").alias("s")).select((F.col("s.h") * TOTAL + F.col("k")).alias("at"), F.col("s.n").alias("n")))
    n_of, v_of = (np.bincount(assigned[: len(top)], x, TOTAL).astype(float) for x in (lexicon.counts, np.ones(len(top))))
    for r in words.groupBy("k").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        n_of[r["k"]] += r["n"]
        v_of[r["k"]] += r["v"]
    unigram = (n_of + 1) / (n_of.sum() + TOTAL)
    follow = np.log10((matrix + BACKOFF * unigram[None, :]) / (matrix.sum(1)[:, None] + BACKOFF))
    return {"words": words.select("hash", F.col("n"), "k"), "n": whole["n"] or 0, "v": whole["v"], "lexicon": shared, "assigned": assigned, "follow": follow, "mass": n_of + v_of + 1, "likelihood": history}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """One row per row of docs (_row, doc_id, held_out, text): counts, base_score, score (both log10)."""
    spark = docs.sparkSession
    batch_rows(spark, TEXT_BATCH)
    lexicon, assigned, follow = model["lexicon"], model["assigned"], model["follow"]
    mass, floor = np.log10(model["mass"]), math.log10(model["n"] + model["v"] + 1)
    chances = (follow - mass[None, :]).ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon.value
        end, plus_one = assigned[lex.end()], np.append(np.log10(lex.counts + 1.0), 0.0)
        for batch in batches:
            if not len(batch):
                continue
            hashed, shaped, begins = token_arrays(batch.column("text"))
            codes = lex.codes(hashed, shaped)
            cls = assigned[lex.narrow(codes)]
            at, known = np.concatenate([end, cls[:-1]]) * TOTAL + cls, codes >= 0
            counts = plus_one[np.where(known, codes, -1)]
            # what rare words add to both sums follows from their counts and classes, below
            of_text = lambda x: np.add.reduceat(x, begins)
            n, row = np.diff(np.append(begins, len(codes))), batch.column("_row").to_numpy()
            none = np.zeros(len(row), np.int32)
            base, scored = of_text(counts) - floor * n, of_text(np.where(known, chances[at], 0.0) + counts)
            yield from sliced({"kind": none, "_row": row, "hash": row, "at": none, "tf": n.astype(np.int32), "known": of_text(known.astype(np.int64)).astype(np.int32), "base": base, "score": scored})
            rare, zero = np.nonzero(~known)[0], np.zeros(int((~known).sum()))
            one = np.ones(len(rare), np.int32)
            yield from sliced({"kind": one, "_row": np.repeat(row, n)[rare], "hash": hashed[rare], "at": at[rare].astype(np.int32), "tf": one, "known": zero.astype(np.int32), "base": zero, "score": zero})

    parts = docs.select("_row", "text").mapInArrow(giving_back(run), "kind int, _row long, hash long, at int, tf int, known int, base double, score double")
    met = parts.join(model["words"].select(F.lit(1).alias("kind"), "hash", "n", "k"), ["kind", "hash"], "left")
    # follow less mass for every pair of classes: a constant table
    chance = F.split(F.lit(",".join(map(repr, chances.tolist()))), ",").cast("array<double>")
    seen = F.coalesce(F.col("n"), F.lit(0))
    gain = F.when(F.col("kind") == 1, F.col("tf") * F.log10(seen + F.lit(1.0))).otherwise(F.lit(0.0))
    move = F.when(F.col("kind") == 1, F.col("tf") * F.get(chance, (F.col("at") + F.coalesce(F.col("k") - F.col("at") % TOTAL, F.lit(0))).cast("int"))).otherwise(F.lit(0.0))
    summed = met.groupBy("_row").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("tf"))).alias("n_tokens"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(F.col("known"))).alias("n_known"),
        F.sum(F.col("base") + gain).alias("base_score"),
        F.sum(F.col("score") + gain + move).alias("score"),
    )
    return docs.select("_row", "doc_id", "held_out").join(summed, "_row").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model["n"]).cast("long").alias("train_tokens"), "base_score", "score")


def prepared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    batch_rows(docs.sparkSession, TEXT_BATCH)
    return with_row(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))).withColumn("held_out", held_out(F.col("doc_id")))


def op9_brown_lm(spark, sf_dir):
    docs = prepared(table(spark, sf_dir, "documents"))
    return score(docs, learn(docs))
