"""SimHash near-duplicates through vantage-point trees.

Distinct fingerprints are cut into equal blocks of bits. Two fingerprints that differ in at most
r of their bits differ in at most r // blocks bits of some block, so each block is searched for
that small radius. A tree of vantage points (chosen on a bounded sample) deals a block's values
to shards by Hamming distance: at a node with vantage v and radius m, d(x, v) <= m goes inside
and the rest outside, and by the triangle inequality only what lies outside by no more than the
search radius is copied inside too. So every pair within reach meets in a shard. There the same
rule goes on until a branch is small enough to compare all its members exactly.

A shard gives each member's link to its group's first member and not all pairs, so that a
large group of copies stays linear; groups of different shards are joined by connected
components. Copies collapse to one fingerprint first.

Null and empty texts have fingerprint zero and are linked like any other; rows with a null id
take part, and a component's id is its smallest id that isn't null; repeated rows are rows of
their own; an empty table gives an empty result; only the id and text columns are read.

The pipeline's keep_one goes by resemblance (the share of common shingles among all distinct
ones). Its fingerprints are wider, with more and smaller blocks, each searched by its own tree
in the same way. Sets as alike as asked have sizes within a fixed ratio, so there are trees for
each class of sizes, and what lies just above a class's boundary is copied below it, too. Inside a
shard only rows that agree in a block and have such sizes are met; those that are near over all
compared bits form candidate groups, and a pair is linked only if its sets of shingle hashes,
joined by a shuffle, are as alike as asked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, combinations, pairwise

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import NUMBER_BATCH, TEXT_BATCH, batch_rows, connected_components, cut, giving_back, sampled, table, with_row

_TO_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
SEED = 42
#: Fingerprints that the vantage points are chosen on, about; sample members in a shard; tries for a vantage point.
SAMPLE, SHARD_SAMPLE, TRIES = 16_384, 384, 6
#: Branches up to this size are compared exactly; comparisons go in blocks of this many rows.
SMALL, BLOCK = 384, 1024
#: Shingles whose bits are counted at a time.
_CHUNK = 1 << 15
#: Columns of the 0/1 matrices of shingle sets at a time.
_COLUMNS = 4096


@dataclass(frozen=True)
class Shape:
    """words: of a shingle; lanes: words of 64 bits; indexed: lanes of which one must differ in at most radius bits; blocks: of such a lane; limit: differing bits over all lanes."""

    words: int = 3
    radius: int = 3
    blocks: int = 2
    lanes: int = 1
    limit: int = 3
    indexed: int = 1


#: The contract's fingerprints, and those of the pipeline: five words; 256 bits, of which about 39 differ at a resemblance of 0.8
#: (cosine 0.89, angle 27 degrees of 180) and 48 in small sets; the limit only drops candidates that are far from it, and no lane is asked for alone.
CONTRACT, PIPELINE = Shape(), Shape(words=5, radius=64, blocks=1, lanes=4, limit=80, indexed=4)
#: Of 5 shingles, 4 must be common.
ALIKE = (4, 5)
#: Lanes of the pipeline's search, bits of a block (five in a lane) and its radius. At a resemblance of 0.8 a bit differs in 0.1875 of
#: cases at most (sets of 5 and 4), so a pair is near in none of the 30 blocks in one of 75,000: (1 - 0.312) ** 30.
SEARCHED, WIDTH, REACH = 6, 12, 1
#: Rows of a shard, about, that its tree is grown for, before boundary copies; pairs of a shard that are compared over all lanes at a time.
SHARD_ROWS, PAIRS = 131_072, 65_536
#: Members of a group that a task compares all with all; rounds of differently dealt chunks before what is left is compared with whole bands.
CHUNK, ROUNDS = 256, 2


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of each k-word shingle, in order and with repeats; of the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_TO_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < k:
        return np.array([digest(joined, SEED)], np.uint64)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    return np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[k:])), np.uint64, len(words) - k + 1)


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """A further hash of each hash (an odd multiplier and xor shifts); lane 0 is the hash itself."""
    if lane:
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * lane)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(32))
    return h


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> list[int]:
    """For each lane 64 bits: a bit is set if it is in over half of the hashes."""
    out = []
    for lane in range(lanes):
        ones = np.zeros(64, np.int64)
        for i in range(0, len(hashes), _CHUNK):
            part = np.ascontiguousarray(_mixed(hashes[i : i + _CHUNK], lane)).view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0]))
    return out


def fingerprints(docs: DataFrame, shape: Shape, carried: list[str], text_col: str) -> DataFrame:
    """The carried columns and l0, l1, ... - a row for each row of docs."""
    lanes = [f"l{i}" for i in range(shape.lanes)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [fingerprint(shingle_hashes(t, shape.words), shape.lanes) for t in batch.pop("_text")]
            lanes_of = np.array(rows, np.int64).reshape(len(rows), shape.lanes)
            yield batch.assign(**{c: lanes_of[:, i] for i, c in enumerate(lanes)})

    from pyspark.sql import types as T

    kept = docs.select(*carried, F.col(text_col).alias("_text"))
    schema = T.StructType([*(f for f in kept.schema if f.name != "_text"), *(T.StructField(c, T.LongType()) for c in lanes)])
    return kept.mapInPandas(run, schema)


# ---- vantage-point trees -------------------------------------------------------------------


def _distance(values: np.ndarray, vantage) -> np.ndarray:
    return np.bitwise_count(values ^ vantage)


def _best_split(values: np.ndarray, radius: int, rng: np.random.Generator):
    """(vantage, m) that leaves the least to compare, or None if no split helps."""
    n, best = len(values), (0.85 * len(values) ** 2, None)
    look = values if n <= 4096 else values[rng.integers(0, n, 4096)]
    for v in values[rng.integers(0, n, TRIES)]:
        upto = np.bincount(_distance(look, v), minlength=65).cumsum() * (n / len(look))
        inside, outside = upto[np.minimum(np.arange(64) + radius, 64)], n - upto[:64]
        cost = np.where((0 < outside) & (outside < n), inside**2 + outside**2, np.inf)
        m = int(cost.argmin())
        if cost[m] < best[0]:
            best = (cost[m], (v, m))
    return best[1]


def grow(sample: np.ndarray, radius: int, smallest: int = SHARD_SAMPLE):
    """Nested tuples (vantage, m, inside, outside); a leaf is a number."""
    rng, leaves = np.random.default_rng(5), [0]

    def node(values):
        split = _best_split(values, radius, rng) if len(values) > smallest else None
        if split is None:
            leaves[0] += 1
            return leaves[0] - 1
        d = _distance(values, split[0])
        return (*split, node(values[d <= split[1] + radius]), node(values[d > split[1]]))

    return node(sample)


def route(tree, values: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, indices of values) - every value in its own shard, and in those whose boundary it overlaps."""
    todo = [(tree, np.arange(len(values)))]
    while todo:
        node, at = todo.pop()
        if isinstance(node, int):
            yield node, at
        elif len(at):
            d = _distance(values[at], node[0])
            todo += [(node[2], at[d <= node[1] + radius]), (node[3], at[d > node[1]])]


class Groups:
    """Union-find over the rows of a shard."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.root[a], self.root[b]
        apart = a != b
        for x, y in set(zip(a[apart].tolist(), b[apart].tolist())):
            x, y = self.find(x), self.find(y)
            self.root[max(x, y)] = min(x, y)
        while ((up := self.root[self.root]) != self.root).any():
            self.root = up

    def find(self, x: int) -> int:
        while self.root[x] != x:
            x = self.root[x]
        return x


def branches(values: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, copied) of the rows of a shard's small branches: it is split further by vantage points. Two rows whose copied have a common bit meet outside that boundary, too."""
    rng, todo = np.random.default_rng(7), [(np.arange(len(values)), np.zeros(len(values), np.uint64), 0)]
    while todo:
        at, copied, depth = todo.pop()
        split = _best_split(values[at], radius, rng) if len(at) > SMALL else None
        if split is None:
            yield at, copied
        else:
            d = _distance(values[at], split[0])
            inside, outside = d <= split[1] + radius, d > split[1]
            # deeper than a bit each, both places count
            over = (inside & outside).astype(np.uint64) << np.uint64(depth) if depth < 64 else np.zeros(len(at), np.uint64)
            todo += [(at[inside], (copied | over)[inside], depth + 1), (at[outside], copied[outside], depth + 1)]


def link_shard(lanes: np.ndarray, values: np.ndarray, radius: int, shape: Shape, lane: int = 0) -> np.ndarray:
    """The root of each row: lanes is (rows, lanes) of uint64, values the bits of a block of one lane, which are split further by vantage points."""
    groups = Groups(len(lanes))
    for at, _ in branches(values, radius):
        for i in range(0, len(at), BLOCK):
            for j in range(i, len(at), BLOCK):
                p, q = at[i : i + BLOCK], at[j : j + BLOCK]
                a, b = np.nonzero(np.bitwise_count(lanes[p, lane][:, None] ^ lanes[q, lane][None, :]) <= shape.radius)
                a, b = p[a], q[b]
                if shape.lanes > 1 and len(a):
                    near = np.bitwise_count(lanes[a] ^ lanes[b]).sum(axis=1) <= shape.limit
                    a, b = a[near], b[near]
                if len(a):
                    groups.link(a, b)
    return groups.root


def links(distinct: DataFrame, shape: Shape) -> DataFrame:
    """Edges (a, b) between row numbers `node` of distinct fingerprints (node, l0, ...): the shards' spanning links."""
    spark = distinct.sparkSession
    width, reach = 64 // shape.blocks, shape.radius // shape.blocks
    names = [f"l{i}" for i in range(shape.lanes)]
    # a bounded sample that only chooses vantage points
    sample = np.array(sorted(tuple(r) for r in sampled(distinct.select(*names), "l0", SAMPLE).collect()), np.int64).reshape(-1, shape.lanes).view(np.uint64)
    cut_out = lambda x, i: (x >> np.uint64(i * width)) & np.uint64((1 << width) - 1)
    parts = [(lane, i) for lane in range(shape.indexed) for i in range(shape.blocks)]
    trees = [grow(cut_out(sample[:, lane], i), reach) if len(sample) else 0 for lane, i in parts]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.ascontiguousarray(batch[names].to_numpy(np.int64)).view(np.uint64)
            for k, ((lane, i), tree) in enumerate(zip(parts, trees)):
                dealt = [(shard * len(parts) + k, at) for shard, at in route(tree, cut_out(x[:, lane], i), reach) if len(at)]
                if dealt:
                    rows = np.concatenate([at for _, at in dealt])
                    yield batch.iloc[rows].assign(shard=np.repeat([s for s, _ in dealt], [len(at) for _, at in dealt]))

    def compare(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        lanes = np.ascontiguousarray(shard[names].to_numpy(np.int64)).view(np.uint64)
        nodes, (lane, i) = shard["node"].to_numpy(), parts[key[0] % len(parts)]
        root = link_shard(lanes, cut_out(lanes[:, lane], i), reach, shape, lane)
        apart = root != np.arange(len(root))
        return pd.DataFrame({"a": nodes[apart], "b": nodes[root[apart]]})

    fields = "node long, " + ", ".join(f"{c} long" for c in names)
    return distinct.select("node", *names).mapInPandas(deal, f"{fields}, shard int").groupBy("shard").applyInPandas(compare, "a long, b long")


def components(prints: DataFrame, shape: Shape, id_col: str) -> DataFrame:
    """prints with component_id: the smallest id among all rows reachable by links."""
    lanes = [f"l{i}" for i in range(shape.lanes)]
    # with one lane the fingerprint numbers itself; with more its hash does
    node = F.col("l0") if shape.lanes == 1 else F.xxhash64(*lanes)
    prints = prints.withColumn("node", node)
    distinct = cut(prints.groupBy("node", *lanes).agg(F.min(id_col).alias("least_id")))
    roots = connected_components(links(distinct, shape))
    rooted = distinct.join(roots, "node", "left").select("node", "least_id", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(least, "root").select("node", "component_id")
    return prints.join(named, "node").drop("node")


def near_duplicates(docs: DataFrame, shape: Shape = CONTRACT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the lanes l0, ..., component_id."""
    batch_rows(docs.sparkSession, TEXT_BATCH)
    prints = cut(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), shape, ["doc_id"], "text"))
    batch_rows(docs.sparkSession, NUMBER_BATCH)
    return components(prints, shape, "doc_id")


# ---- resemblance ---------------------------------------------------------------------------

def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The distinct shingle hashes, in order."""
    return np.unique(shingle_hashes(text, k))


def blocks_of(lanes: np.ndarray) -> np.ndarray:
    """(rows, blocks) of the bits of lanes, (rows, lanes) of uint64."""
    shifts = np.arange(64 // WIDTH, dtype=np.uint64) * np.uint64(WIDTH)
    return ((lanes[:, :, None] >> shifts) & np.uint64((1 << WIDTH) - 1)).astype(np.uint16).reshape(len(lanes), -1)


def sketches(docs: DataFrame, shape: Shape) -> DataFrame:
    """_row, name, node (a hash of the shingle set), size, the lanes of the set, and the blocks that are searched, for docs (_row, name, text)."""
    lanes = [f"l{i}" for i in range(shape.lanes)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t, shape.words) for t in batch.pop("text")]
            lanes_of = np.array([fingerprint(s, SEARCHED) for s in sets], np.int64).reshape(len(sets), SEARCHED)
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            blocks = blocks_of(lanes_of.view(np.uint64)).view(np.int16)
            yield batch.assign(node=node, size=[len(s) for s in sets], **{c: lanes_of[:, i] for i, c in enumerate(lanes)}, blocks=list(blocks))

    kept = docs.select("_row", "name", "text")
    name = kept.schema["name"].dataType.simpleString()
    return kept.mapInPandas(giving_back(run), f"_row long, name {name}, node long, size long, {', '.join(f'{c} long' for c in lanes)}, blocks array<short>")


def size_classes(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each size, by powers of two, and whether a set of the class below can be alike, too."""
    num, den = ALIKE
    own = np.frexp(np.maximum(sizes, 1).astype(float))[1] - 1
    return own, (own > 0) & (sizes * num <= ((1 << own.astype(np.int64)) - 1) * den)


def near_groups(lanes: np.ndarray, values: np.ndarray, sizes: np.ndarray, limit: int, copied: np.ndarray) -> np.ndarray:
    """The root of each row of a shard: rows are linked whose blocks (values) differ in at most REACH bits, whose sizes can be alike and whose lanes differ in at most limit.

    Rows lie by value and size, so those that a row meets are a range for each value near its own, and no others are looked at. Two copied rows meet in another shard.
    """
    num, den = ALIKE
    order = np.lexsort((sizes, values))
    value, size, copied = values[order].astype(np.int64), sizes[order].astype(np.int64), copied[order]
    columns, groups, span = np.ascontiguousarray(lanes[order].T), Groups(len(order)), 2 * int(size.max(initial=0)) + 2
    key, low, high = value * span + size, -(-size * num // den), size * den // num
    for mask in [sum(1 << bit for bit in bits) for r in range(REACH + 1) for bits in combinations(range(WIDTH), r)]:
        rows = np.nonzero(value < value ^ mask)[0] if mask else np.arange(len(order))
        other = (value[rows] ^ mask) * span
        first, end = np.searchsorted(key, other + low[rows]), np.searchsorted(key, other + high[rows], "right")
        first = first if mask else np.maximum(first, rows + 1)
        n = np.maximum(end - first, 0)
        rows, first, n = rows[n > 0], first[n > 0], n[n > 0]
        total = np.cumsum(n)
        for i, j in pairwise([*np.searchsorted(total, np.arange(0, total[-1], PAIRS)).tolist(), len(n)] if len(n) else []):
            part = n[i:j]
            x = np.repeat(rows[i:j], part)
            y = np.arange(len(x)) + np.repeat(first[i:j] - (np.cumsum(part) - part), part)
            apart = (groups.root[x] != groups.root[y]) & ~(copied[x] & copied[y])
            if not apart.all():
                x, y = x[apart], y[apart]
            differing = np.zeros(len(x), np.uint16)
            for c in columns:
                differing += np.bitwise_count(c[x] ^ c[y])
            near = differing <= limit
            if near.any():
                groups.link(x[near], y[near])
    root = np.empty(len(order), np.int64)
    root[order] = order[groups.root]
    return root


def candidates(distinct: DataFrame, shape: Shape) -> DataFrame:
    """(band, node), the members of candidate groups, for distinct (node, size, l0, ..., blocks; without size all are taken as equally large): found by trees for each block and class of sizes, which deal to overlapping shards, and by comparing inside shards.

    Shards give spanning links; their components are the groups, so a row is in one at most, in however many blocks it is found. Trees have more shards the more rows there are.
    """
    names, total = [f"l{i}" for i in range(shape.lanes)], distinct.count()
    distinct = distinct if "size" in distinct.columns else distinct.withColumn("size", F.lit(1).cast("long"))
    # a bounded sample that only chooses vantage points
    chosen = sorted((tuple(r.blocks), r.size_) for r in sampled(distinct.select("l0", "blocks", F.col("size").alias("size_")), "l0", SAMPLE).select("blocks", "size_").collect())
    sample, n_blocks, n_classes = np.array([b for b, _ in chosen], np.uint16), SEARCHED * (64 // WIDTH), 64
    smallest = max(SHARD_SAMPLE, len(sample) * SHARD_ROWS // max(total, 1))

    def by_class(sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        own, below = size_classes(sizes)
        for c in np.unique(np.concatenate([own, own[below] - 1])).tolist():
            yield c, np.nonzero((own == c) | (own == c + 1) & below)[0]

    trees = {(k, c): grow(sample[at, k], REACH, smallest) for c, at in by_class(np.array([x for _, x in chosen], np.int64)) for k in range(n_blocks)}

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                blocks, classes = np.array(batch.pop("blocks").tolist(), np.int16).view(np.uint16), list(by_class(batch["size"].to_numpy()))
                for k in range(n_blocks):
                    dealt = [((shard * n_classes + c) * n_blocks + k, own[at]) for c, own in classes for shard, at in route(trees.get((k, c), 0), blocks[own, k], REACH) if len(at)]
                    rows = np.concatenate([at for _, at in dealt])
                    yield batch.iloc[rows].assign(value=blocks[rows, k].view(np.int16), shard=np.repeat([s for s, _ in dealt], [len(at) for _, at in dealt]))

    def compare(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        lanes = np.ascontiguousarray(shard[names].to_numpy(np.int64)).view(np.uint64)
        nodes, sizes = shard["node"].to_numpy(), shard["size"].to_numpy(np.int64)
        copied = size_classes(sizes)[0] != key[0] // n_blocks % n_classes
        root = near_groups(lanes, shard["value"].to_numpy(np.int16).view(np.uint16), sizes, shape.limit, copied)
        apart = root != np.arange(len(root))
        return pd.DataFrame({"a": nodes[apart], "b": nodes[root[apart]]})

    fields = "node long, size long, " + ", ".join(f"{c} long" for c in names)
    dealt = distinct.select("node", "size", *names, "blocks").mapInPandas(giving_back(deal), f"{fields}, value short, shard int")
    return connected_components(dealt.groupBy("shard").applyInPandas(compare, "a long, b long")).select(F.col("root").alias("band"), "node")


def shingle_sets(docs: DataFrame, shape: Shape) -> DataFrame:
    """node and shingles (the array of distinct hashes) for docs (node, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "shingles": [shingle_set(t, shape.words).view(np.int64) for t in batch["text"]]})

    return docs.select("node", "text").mapInPandas(giving_back(run), "node long, shingles array<long>")


def common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of x has in common with each of y: a product of 0/1 matrices, so many columns at a time."""
    out = np.zeros((len(x), len(y)))
    hashes, column = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    row = np.repeat(np.arange(len(x) + len(y)), list(map(len, [*x, *y])))
    both = np.zeros(len(hashes), np.int8)  # 3: on both sides
    for bit, side in ((1, row < len(x)), (2, row >= len(x))):
        both[np.unique(column[side])] |= bit
    used = both[column] == 3
    column, row = (np.cumsum(both == 3) - 1)[column[used]], row[used]
    by = np.argsort(column, kind="stable")
    column, row = column[by], row[by]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        part = slice(*np.searchsorted(column, [low, low + _COLUMNS]))
        has = np.zeros((len(x) + len(y), _COLUMNS), np.float32)
        has[row[part], column[part] - low] = 1
        out += has[: len(x)] @ has[len(x) :].T
    return out


def joined(x: list[np.ndarray], y: list[np.ndarray], x_roots: np.ndarray, y_roots: np.ndarray) -> pd.DataFrame:
    """Links (a, b) that join the groups of x's and y's members: enough of them, and none within a group."""
    num, den = ALIKE
    both, sizes = common(x, y), np.array(list(map(len, x)))[:, None] + np.array(list(map(len, y)))[None, :]
    i, j = np.nonzero((both * den >= (sizes - both) * num) & (x_roots[:, None] != y_roots[None, :]))
    roots, at = np.unique(np.concatenate([x_roots, y_roots]), return_inverse=True)
    groups = Groups(len(roots))
    if len(i):
        groups.link(at[i], at[len(x) + j])
    apart = groups.root != np.arange(len(roots))
    return pd.DataFrame({"a": roots[apart], "b": roots[groups.root[apart]]})


def _within(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    sets, roots = rows["shingles"].tolist(), rows["root"].to_numpy(np.int64)
    return joined(sets, sets, roots, roots)


def _across(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    x, y = rows[rows["outside"]], rows[~rows["outside"]]
    if not len(x) or not len(y):
        return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
    return joined(x["shingles"].tolist(), y["shingles"].tolist(), x["root"].to_numpy(np.int64), y["root"].to_numpy(np.int64))


def alike(docs: DataFrame, shape: Shape) -> DataFrame:
    """prints of docs (_row, name, text) with component_id: the smallest name among all rows reachable by pairs of the asked resemblance.

    Each member of a candidate group (band) is compared with the band's smallest node. Bands whose members this
    didn't bring together go on: their members are compared all with all inside tasks, which
    settles a band of up to CHUNK members; larger ones are dealt into chunks, differently in each
    round, until most members are in one group. What is left of a large band, the members outside
    its largest group, is then compared with the whole band, block by block. Tasks give spanning
    links only, so no pairs of a group are ever written out.
    """
    spark = docs.sparkSession
    lanes, (num, den) = [f"l{i}" for i in range(shape.lanes)], ALIKE
    batch_rows(spark, TEXT_BATCH)
    prints = cut(sketches(docs, shape))
    batch_rows(spark, NUMBER_BATCH)
    distinct = cut(prints.groupBy("node").agg(F.min("name").alias("least_id"), F.min("_row").alias("_row"), *(F.first(c).alias(c) for c in ["size", *lanes, "blocks"])))
    member = cut(candidates(distinct, shape))
    shared = member.groupBy("band").agg(F.min("node").alias("first"), F.count("*").alias("n"))
    members = cut(member.join(shared, "band").select("band", "node", "first", "n"))
    batch_rows(spark, TEXT_BATCH)
    wanted = members.select("node").distinct().join(distinct.select("node", "_row"), "node")
    sets = cut(shingle_sets(docs.select("_row", "text").join(wanted, "_row"), shape).join(distinct.select("node", "size", *lanes), "node"))
    light = sets.drop("shingles")

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda rows, x: rows.select(*(F.col(c).alias(x if c == "node" else f"{x}_{c}") for c in rows.columns))
        differing = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in lanes), F.lit(0))
        # sizes alone bound the resemblance, too
        fits = (F.least("a_size", "b_size") * den >= F.greatest("a_size", "b_size") * num) & (differing <= shape.limit)
        near = pairs.distinct().join(side(light, "a"), "a").join(side(light, "b"), "b").where(fits).select("a", "b", "a_size", "b_size")
        sets_of = sets.select("node", "shingles")
        both = F.size(F.array_intersect("a_shingles", "b_shingles"))
        whole = near.join(side(sets_of, "a"), "a").join(side(sets_of, "b"), "b").withColumn("both", both)
        return whole.where(F.col("both") * den >= (F.col("a_size") + F.col("b_size") - F.col("both")) * num).select("a", "b")

    def open_bands(rooted: DataFrame) -> DataFrame:
        """(band, node, n, root) of the bands with several groups."""
        split = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band")
        return cut(rooted.join(split, "band"))

    with_sets = lambda rows: rows.join(sets.select("node", "shingles"), "node")
    edges = cut(verified(members.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))))
    # a member's group so far: the band's smallest node, if it is near it
    near_first = members.join(edges.select(F.col("a").alias("first"), F.col("b").alias("node"), F.lit(True).alias("near")), ["first", "node"], "left")
    rest, turn = open_bands(near_first.select("band", "node", "n", F.when(F.col("near"), F.col("first")).otherwise(F.col("node")).alias("root"))), 0
    while turn < ROUNDS and not rest.isEmpty():
        chunk = F.pmod(F.xxhash64("node", "band", F.lit(turn)), F.ceil(F.col("n") / CHUNK))
        found = with_sets(rest).withColumn("chunk", chunk).groupBy("band", "chunk").applyInPandas(_within, "a long, b long")
        edges, rest, turn = cut(edges.union(found)), rest.where(F.col("n") > CHUNK), turn + 1
        if not rest.isEmpty():
            rooted = rest.drop("root").join(connected_components(edges), "node", "left")
            rest = open_bands(rooted.select("band", "node", "n", F.coalesce("root", "node").alias("root")))
    if not rest.isEmpty():
        sizes = rest.groupBy("band", "root").agg(F.count("*").alias("m")).groupBy("band").agg(F.max_by("root", F.struct("m", "root")).alias("largest"), (F.sum("m") - F.max("m")).alias("n_outside"))
        blocked = rest.join(sizes, "band").withColumns({"xs": F.ceil(F.col("n_outside") / CHUNK), "ys": F.ceil(F.col("n") / CHUNK)})
        own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        outside = blocked.where("root <> largest").select("band", "node", "root", own("xs").alias("x"), every("ys").alias("y"), F.lit(True).alias("outside"))
        whole = blocked.select("band", "node", "root", every("xs").alias("x"), own("ys").alias("y"), F.lit(False).alias("outside"))
        edges = edges.union(with_sets(outside.union(whole)).groupBy("band", "x", "y").applyInPandas(_across, "a long, b long"))
    roots = connected_components(edges)
    rooted = distinct.join(roots, "node", "left").select("node", "least_id", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return prints.select("_row", "name", "node").join(rooted.join(least, "root").select("node", "component_id"), "node")


def keep_one(docs: DataFrame, shape: Shape = PIPELINE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one document of each group: the one with the smallest id (null last), of repeated ids the first row."""
    rows = with_row(docs.select(F.struct(*docs.columns).alias("carried"), F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    named = rows.select("_row", F.struct(F.col("id").isNull().alias("last"), "id", "_row").alias("name"), "text")
    extra = alike(named, shape).where("name <> component_id").select("_row")
    return rows.join(extra, "_row", "left_anti").select("carried.*")


def op2_simhash_near_dedup(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("l0")), 16, "0").alias("fingerprint"), "component_id")
