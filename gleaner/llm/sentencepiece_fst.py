"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model file is compiled once on the driver into three parts: the normaliser (replacements of
character sequences, longest first; squeezed and edge spaces; a leading space; spaces as word
marks), the piece arcs, and byte arcs for characters without a piece. User-defined pieces are
never normalised or divided: the text between them is a lattice of its own. Composing
them with a text gives a lattice whose states are (position, last piece); the encoding is its
shortest path in the tropical semiring (min, +).

Arc weights depend on the model. A unigram model's arc weighs minus the piece's log probability.
For a byte-pair model an arc weighs nothing if the merges, run on the two neighbouring pieces'
joined text, give back just these two pieces, and is infinite otherwise: a sequence of pieces is
what the merges make of its text if and only if that holds for every neighbouring pair, so one
path is left and it is the model's own encoding. (Weighing byte-pair pieces by their scores
would give other ids than the model's.) So does one path to each place inside the text, which lets
the path be followed depth first, longest piece first: a place that leads nowhere never does.

The lattice falls apart wherever no piece holds the two neighbouring characters side by side (as
at most word marks and punctuation), and the paths of its parts are kept in a cache of bounded
size, in which parts that come again outlive others. Texts are taken whole. Null texts give null ids, empty texts none; repeated rows
are rows of their own; an empty table gives an empty result; an input column is never
overwritten by name, as only the id and text columns are read (encode() keeps the others apart).
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import TEXT_BATCH, batch_rows, table

INF = float("inf")
#: Entries of the caches of parts and of neighbouring pairs; of parts where the work is nothing but coding.
PARTS, PAIRS, MANY_PARTS = 100_000, 200_000, 1_000_000
#: State before the first piece, and after a character without a piece: no merge reaches across it.
START = -1
MARK = "▁"


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


class Normaliser:
    """Rewrites a text by the longest sequence that a model's table of replacements has at each place.

    The table is a double array: a unit has its label in the low byte, a flag for an end, and how
    far its children lie off; an end's child holds the place of the replacement, which a zero byte
    ends.
    """

    def __init__(self, table: bytes, squeeze: bool, kept: list[str]):
        size = int.from_bytes(table[:4], "little") if table else 0
        self.units, self.strings = np.frombuffer(table[4 : 4 + size], "<u4").tolist(), table[4 + size :]
        self.squeeze = squeeze
        self.kept = re.compile("|".join(map(re.escape, sorted(kept, key=len, reverse=True)))) if kept else None

    def _longest(self, data: bytes, at: int) -> tuple[int, int]:
        """(length, place of the replacement) of the longest sequence at a place; length 0 if there is none."""
        units, best = self.units, (0, 0)
        offset = lambda u: (u >> 10) << ((u & 512) >> 6)
        node = offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                best = i + 1 - at, units[node] & 0x7FFFFFFF
        return best

    def _rewritten(self, text: str) -> str:
        if not self.units:
            return text
        data, out, at = text.encode("utf-8", "replace"), [], 0
        while at < len(data):
            length, place = self._longest(data, at)
            if length:
                out.append(self.strings[place : self.strings.index(b"\0", place)])
            else:
                length = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                out.append(data[at : at + length])
            at += length
        return b"".join(out).decode("utf-8", "replace")

    def __call__(self, text: str) -> str:
        if self.kept:
            parts, at = [], 0
            for m in self.kept.finditer(text):
                parts += [self._rewritten(text[at : m.start()]), m.group()]
                at = m.end()
            text = "".join([*parts, self._rewritten(text[at:])])
        else:
            text = self._rewritten(text)
        return re.sub(" +", " ", text).strip(" ") if self.squeeze else text


class Transducer:
    def __init__(self, pieces: dict[str, int], scores: list[float], byte_ids: list[int], texts: list[bytes | None], merging: bool, prefix: bool, unknown: int, normaliser: Normaliser | None = None, own: dict[str, int] | None = None, kept: int | None = None):
        self.normaliser, self.own, self.kept = normaliser, own or {}, kept or PARTS
        self.own_cuts = re.compile("(" + "|".join(map(re.escape, sorted(self.own, key=len, reverse=True))) + ")") if self.own else None
        self.pieces, self.scores, self.byte_ids, self.texts = pieces, scores, byte_ids, texts
        self.merging, self.prefix, self.unknown = merging, prefix, unknown
        self.prefixes = {p[:i]: -1 for p in pieces for i in range(1, len(p))} | pieces  # beginnings of pieces, -1 if they are none themselves
        self.neighbours = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}  # characters that some piece holds side by side
        self.loose = any(" " in p.lstrip(" ") for p in pieces)  # a piece with a mark inside: texts aren't cut at marks
        self._forget()

    def _forget(self) -> None:
        self._parts: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._pairs: dict[int, float] = {}
        self._steps: dict[int, tuple] = {}

    def __getstate__(self):
        return self.__dict__ | {"_parts": {}, "_older": {}, "_pairs": {}, "_steps": {}}

    @classmethod
    def compile(cls, path: str, kept: int | None = None) -> Transducer:
        """From a SentencePiece model file; kept: parts in the cache."""
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds, spec = model.SentencePiece, model.normalizer_spec
        if not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("spaces must be word marks at the beginning of words")
        pieces, byte_ids, texts, unknown, own = {}, [0] * 256, [], 0, {}
        for i, p in enumerate(model.pieces):
            text = None
            if p.type == kinds.NORMAL:
                pieces[p.piece.replace(MARK, " ")] = i
                text = p.piece.replace(MARK, " ").encode()
            elif p.type == kinds.BYTE:
                byte_ids[int(p.piece[3:5], 16)] = i
                text = bytes([int(p.piece[3:5], 16)])
            elif p.type == kinds.USER_DEFINED:
                own[p.piece.replace(MARK, " ")] = i
                text = p.piece.replace(MARK, " ").encode()
            elif p.type == kinds.UNKNOWN:
                unknown = i
            texts.append(text)
        merging = model.trainer_spec.model_type == model.trainer_spec.BPE
        normaliser = Normaliser(spec.precompiled_charsmap, spec.remove_extra_whitespaces, list(own)) if spec.precompiled_charsmap or spec.remove_extra_whitespaces else None
        return cls(pieces, [p.score for p in model.pieces], byte_ids if model.trainer_spec.byte_fallback else [], texts, merging, spec.add_dummy_prefix, unknown, normaliser, own, kept)

    # ---- weights

    def steps(self, piece: int) -> tuple[list[str], list[str], list[float], bool]:
        """What the merges do to a piece's own text: its first and its last part after each merge, the merges' scores, and whether one part is left."""
        got = self._steps.get(piece)
        if got is None:
            parts, scores = list(self.texts[piece].decode()), []
            first, last = [parts[0]], [parts[-1]]
            while True:
                best, at = -INF, -1
                for i in range(len(parts) - 1):  # the best-scored neighbours join first, the leftmost of equals
                    joined = self.pieces.get(parts[i] + parts[i + 1])
                    if joined is not None and self.scores[joined] > best:
                        best, at = self.scores[joined], i
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                scores.append(best)
                first.append(parts[0])
                last.append(parts[-1])
            got = self._steps[piece] = first, last, scores, len(parts) == 1
        return got

    def separate(self, before: int, piece: int) -> bool:
        """Whether the merges, run on two pieces side by side, never join them: their own merges go on in order of score until one across the border would come first."""
        _, last, left, whole = self.steps(before)
        first, _, right, also = self.steps(piece)
        i = j = 0
        while whole and also:
            across = self.pieces.get(last[i] + first[j])
            mine, theirs = left[i] if i < len(left) else -INF, right[j] if j < len(right) else -INF
            if across is not None and self.scores[across] > mine and self.scores[across] >= theirs:
                return False
            if mine == theirs == -INF:
                return True
            if mine >= theirs:
                i += 1
            else:
                j += 1
        return False

    def weight(self, before: int, piece: int) -> float:
        """Of the arc that reads a piece in the state left by the one before."""
        if not self.merging:
            return -self.scores[piece]
        key = before * len(self.texts) + piece
        got = self._pairs.get(key)
        if got is None:
            got = 0.0 if (self.steps(piece)[3] if before == START else self.separate(before, piece)) else INF
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            self._pairs[key] = got
        return got

    # ---- shortest path

    def path(self, text: str) -> list[int]:
        """Ids of the shortest path through the lattice of a part."""
        return self._only_path(text) if self.merging else self._least_path(text)

    def _only_path(self, text: str) -> list[int]:
        """The path without infinite arcs."""
        n, get, single, known, size = len(text), self.prefixes.get, self.pieces, self._pairs.get, len(self.texts)
        nowhere, at, state, path, options, others, strange = set(), 0, START, [], None, [], False
        while at < n:
            if options is None:
                options = []
                if text[at] not in single:  # byte arcs
                    options.append((at + 1, START))
                    strange = True
                else:
                    for j in range(at + 1, n + 1):
                        piece = get(text[at:j])
                        if piece is None:
                            break
                        if piece >= 0:
                            options.append((j, piece))
            while options:
                j, piece = options.pop()
                if j in nowhere:
                    continue
                if piece == START:
                    break
                arc = known(state * size + piece)
                if (self.weight(state, piece) if arc is None else arc) == 0:
                    break
            else:
                nowhere.add(at)
                at, state, options = others.pop()
                path.pop()
                continue
            others.append((at, state, options))
            path.append(piece if piece != START else text[at])
            at, state, options = j, piece, None
        return path if not strange else [i for p in path for i in ([p] if isinstance(p, int) else self._bytes(p))]

    def _least_path(self, text: str) -> list[int]:
        n, get, single, known, size = len(text), self.prefixes.get, self.pieces, self._pairs.get, len(self.texts)
        cost, last, back = [0.0] + [INF] * n, [START] * (n + 1), [0] * (n + 1)
        for i in range(n):
            so_far, state = cost[i], last[i] * size
            if text[i] not in single:  # byte arcs; their weight can't matter, as nothing else reads the character
                cost[i + 1], last[i + 1], back[i + 1] = so_far, START, i
                continue
            for j in range(i + 1, n + 1):
                piece = get(text[i:j])
                if piece is None:
                    break
                if piece >= 0 and so_far < cost[j]:
                    arc = known(state + piece)
                    c = so_far + (self.weight(last[i], piece) if arc is None else arc)
                    if c < cost[j]:
                        cost[j], last[j], back[j] = c, piece, i
        out, j = [], n
        while j:
            if last[j] == START:
                out += reversed(self._bytes(text[j - 1]))
            else:
                out.append(last[j])
            j = back[j]
        return out[::-1]

    def _bytes(self, character: str) -> list[int]:
        return [self.byte_ids[b] for b in character.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]

    def part(self, text: str) -> bytes:
        got = self._older.get(text)
        if got is None:
            # short words have no place to cut, or so seldom that looking for it takes longer than it saves
            joint = self.neighbours if len(text) > 64 or not text[1:].isalpha() else None
            cuts = joint and [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in joint]
            if cuts:  # nothing reads across such a place, so the ends are parts of their own
                ends = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
                got = b"".join([self._parts.get(e) or self.part(e) for e in ends])
            else:
                got = struct.pack(f"<{len(ids := self.path(text))}i", *ids)
        if len(text) <= 64:
            if len(self._parts) >= self.kept // 2:  # what isn't asked for until it is half full again goes
                self._older, self._parts = self._parts, {}
            self._parts[text] = got
        return got

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        text = self.normaliser(text) if self.normaliser else text
        text = text.replace(MARK, " ")
        text = text.rstrip(" ") if self.normaliser and self.normaliser.squeeze else text
        if not text:
            return np.empty(0, np.dtype("<i4"))
        text = " " + text if self.prefix else text
        if self.own_cuts:
            parts = [np.array([self.own[x]], np.dtype("<i4")) if i % 2 else self._lattice(x) for i, x in enumerate(self.own_cuts.split(text)) if x]
            return np.concatenate(parts)
        return self._lattice(text)

    def _lattice(self, text: str) -> np.ndarray:
        """Ids of a text without user-defined pieces."""
        cuts = _WHOLE if self.loose else _CUTS
        units = cuts.findall(text)
        got = list(map(self._parts.get, units))
        if None in got:
            got = [self.part(u) if g is None else g for u, g in zip(units, got)]
        return np.frombuffer(b"".join(got), np.dtype("<i4"))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; control pieces have none."""
        texts = self.texts
        out = b"".join([texts[i] or b"" for i in ids.tolist()]).decode("utf-8", "replace")
        return out[1:] if self.prefix and out[:1] == " " else out


#: A part: word marks and what follows them, or a line end, which no piece holds next to anything.
_CUTS, _WHOLE = re.compile(r" +[^ \n]*|\n|[^ \n]+"), re.compile(r"(?s).+")


def _compiled(spark, path: str | None, kept: int | None = None):
    return spark.sparkContext.broadcast(Transducer.compile(path or default_model(), kept))


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """(row: struct of all input columns, ids: array of int)."""
    spark = docs.sparkSession
    batch_rows(spark, TEXT_BATCH)
    shared = _compiled(spark, path)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else shared.value.encode(t) for t in texts], dtype=object)

    return docs.select(F.struct(*docs.columns).alias("row"), ids(F.col(text_col)).alias("ids"))


def decode(encoded: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(row: struct of all input columns, text)."""
    shared = _compiled(encoded.sparkSession, path)

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else shared.value.decode(np.asarray(x, np.int32)) for x in ids], dtype=object)

    return encoded.select(F.struct(*encoded.columns).alias("row"), text(F.col(ids_col)).alias("text"))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_ids, n_byte_ids, ids_sha256 (of the ids as little-endian 32-bit integers), text_sha256 (of the decoded text), exact.

    Encodes and decodes in one pass, so that ids needn't leave the task.
    """
    spark = docs.sparkSession
    batch_rows(spark, TEXT_BATCH)
    shared = _compiled(spark, path, MANY_PARTS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fst = shared.value
        is_byte = np.zeros(len(fst.texts), bool)
        is_byte[fst.byte_ids] = True
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                text = text or ""
                ids = fst.encode(text)
                back = fst.decode(ids)
                rows.append((doc_id, len(ids), int(is_byte[ids].sum()), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back.encode("utf-8", "replace")).hexdigest(), back == text))
            yield pd.DataFrame(rows, columns=["doc_id", "n_ids", "n_byte_ids", "ids_sha256", "text_sha256", "exact"])

    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fields = [T.StructField("doc_id", kept.schema["doc_id"].dataType), T.StructField("n_ids", T.LongType()), T.StructField("n_byte_ids", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("text_sha256", T.StringType()), T.StructField("exact", T.BooleanType())]
    return kept.mapInPandas(run, T.StructType(fields))


def op10_sentencepiece(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"))
