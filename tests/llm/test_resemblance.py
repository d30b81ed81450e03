"""The pipeline's near duplicates against all pairs by exact resemblance."""

import random
from itertools import combinations

import numpy as np
import pytest

from gleaner.llm import simhash

COLUMNS = "doc_id long, text string"


def edited(words, resemblance, rng):
    """words with new ones far apart until at most this share of five-word shingles is common."""
    out, spots = list(words), list(range(4, len(words) - 4, 6))
    rng.shuffle(spots)
    while spots and share(words, out) > resemblance:
        out[spots.pop()] = f"new{rng.random()}"
    return out


def share(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(a & b) / len(a | b)


def kept_by_all_pairs(rows):
    group = {i: i for i, _ in rows}
    for (i, a), (j, b) in combinations(rows, 2):
        if share(a, b) >= 0.8 and group[i] != group[j]:
            low, high = sorted((group[i], group[j]))
            group = {k: low if g == high else g for k, g in group.items()}
    return {i for i, g in group.items() if i == g}


def many(rng):
    rows = []
    for n in (60, 200, 600):
        for aim in (0.6, 0.7, 0.75, 0.79, 0.82, 0.85, 0.9):
            for _ in range(4):
                base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
                rows += [base, edited(base, aim, rng)]
    # near copies of one text that are not all near one another, and a chain
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    rows += [edited(base, 0.88, rng) for _ in range(12)] + [base]
    chain = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    for k in range(8):
        rows.append(chain)
        chain = chain[25:] + [f"w{rng.randrange(10**6)}" for _ in range(25)]
    return rows


def large_group(rng):
    """Many copies, few of which are near the first, and some near no other."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(90)]
    return [edited(base, aim, rng) for aim in [0.91] * 60 + [0.86] * 25 + [0.75] * 15]


@pytest.mark.parametrize("texts, chunk, rounds", [(many, 256, 3), (large_group, 256, 3), (large_group, 8, 2), (large_group, 8, 0)])
def test_pairs_by_exact_resemblance(spark, monkeypatch, texts, chunk, rounds):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "ROUNDS", rounds)
    rng = random.Random(3)
    rows = list(enumerate(texts(rng)))
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], COLUMNS)
    want = kept_by_all_pairs(rows)
    assert len(rows) - len(want) > 20
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == want


def test_common_counts(monkeypatch):
    monkeypatch.setattr(simhash, "_COLUMNS", 7)
    rng = np.random.default_rng(2)
    x, y = ([np.unique(rng.integers(0, 60, n)) for n in sizes] for sizes in ((0, 5, 40, 20), (30, 1, 0, 50, 9)))
    assert simhash.common(x, y).tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in y] for a in x]


def test_trees_find_what_is_near_in_a_block(spark, monkeypatch):
    """Every pair that is near in some block and over the compared lanes is in one candidate group, with shards, branches and blocks of comparison that are small."""
    monkeypatch.setattr(simhash, "SHARD_SAMPLE", 40)
    monkeypatch.setattr(simhash, "SHARD_ROWS", 1)
    monkeypatch.setattr(simhash, "SMALL", 12)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    monkeypatch.setattr(simhash, "PAIRS", 5)
    rng = np.random.default_rng(4)
    far = rng.integers(0, 1 << 64, (150, 6), np.uint64)
    flips = np.zeros((150, 6), np.uint64)
    for bit in range(64):
        flips |= (rng.random((150, 6)) < 0.15).astype(np.uint64) << np.uint64(bit)
    lanes = np.concatenate([far, far ^ flips])
    blocks = simhash.blocks_of(lanes)
    assert blocks.shape == (300, 30) and int(blocks[7, 6]) == int(lanes[7, 1]) >> 12 & 4095
    rows = [(k, *lanes[k, :4].view(np.int64).tolist(), blocks[k].view(np.int16).tolist()) for k in range(300)]
    df = spark.createDataFrame(rows, "node long, l0 long, l1 long, l2 long, l3 long, blocks array<short>")
    got = {}
    for r in simhash.candidates(df, simhash.PIPELINE).collect():
        got.setdefault(r.band, set()).add(r.node)
    near = (np.bitwise_count(blocks[:, None] ^ blocks[None]).min(axis=2) <= 1) & (np.bitwise_count(lanes[:, None, :4] ^ lanes[None, :, :4]).sum(axis=2) <= 80)
    want = {(a, b) for a, b in np.argwhere(near).tolist() if a < b}
    assert len(want) > 140 and want <= {p for g in got.values() for p in combinations(sorted(g), 2)}
    assert sum(map(len, got.values())) == len(set().union(*got.values())) <= 2 * len(want)
    assert simhash.candidates(df.limit(0), simhash.PIPELINE).count() == 0


def test_sizes_that_cannot_be_alike_do_not_meet(spark, monkeypatch):
    """Equal lanes, sizes of every ratio, over the classes' boundaries: only sizes within 4 to 5 are in one group, however the shards are."""
    sizes = [10, 31, 35, 39, 60, 63, 64, 78, 79, 98, 100, 127, 128, 159, 160, 300, 1000, 1250, 1251, 4000, 10**6]
    alike = lambda a, b: min(a, b) * 5 >= max(a, b) * 4
    rng = np.random.default_rng(6)
    lanes = np.repeat(rng.integers(0, 1 << 64, (2, 6), np.uint64), len(sizes), axis=0)
    blocks = simhash.blocks_of(lanes)
    rows = [(k, sizes[k % len(sizes)], *lanes[k, :4].view(np.int64).tolist(), blocks[k].view(np.int16).tolist()) for k in range(len(lanes))]
    df = spark.createDataFrame(rows, "node long, size long, l0 long, l1 long, l2 long, l3 long, blocks array<short>")
    group = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        if rows[a][2] == rows[b][2] and alike(rows[a][1], rows[b][1]):
            group = [group[a] if g == group[b] else g for g in group]
    want = {frozenset(k for k, g in enumerate(group) if g == x) for x in group}
    for shard_rows in (1, 10**6):
        monkeypatch.setattr(simhash, "SHARD_ROWS", shard_rows)
        got = {}
        for r in simhash.candidates(df, simhash.PIPELINE).collect():
            got.setdefault(r.band, set()).add(r.node)
        assert set(map(frozenset, got.values())) == {g for g in want if len(g) > 1}
    assert 8 < len(want) < len(rows) - 10


def test_near_groups_against_all_pairs(monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS", 7)
    rng = np.random.default_rng(8)
    lanes = rng.integers(0, 1 << 64, (400, 4), np.uint64)
    values, sizes, copied = rng.integers(0, 60, 400).astype(np.uint16), rng.integers(20, 60, 400), rng.random(400) < 0.3
    near = (np.bitwise_count(values[:, None] ^ values[None]) <= 1) & (5 * np.minimum(sizes[:, None], sizes[None]) >= 4 * np.maximum(sizes[:, None], sizes[None]))
    near &= (np.bitwise_count(lanes[:, None] ^ lanes[None]).sum(axis=2) <= 108) & ~(copied[:, None] & copied[None])
    a, b = np.nonzero(near)
    groups = simhash.Groups(400)
    groups.link(a, b)
    root = simhash.near_groups(lanes, values, sizes, 108, copied)
    pairs = lambda r: {(i, j) for i in range(400) for j in range(400) if r[i] == r[j]}
    assert pairs(root) == pairs(groups.root) and 420 < len(pairs(root)) < 100_000
