"""Decontamination, filter audit and conversation repair against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from itertools import permutations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import common, conversation_repair, decontaminate, filter_audit

WORDS = ["the", "of", "and", "alpha", "beta", "gamma", "été", "日本", "MIT", "x1"]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", ",", "."]) for _ in range(n))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- 11

ITEMS = [("7", prose(1, 30)), ("10", "Alpha beta"), ("9", None), ("8", ""), ("11", prose(2, 10)), ("11", prose(2, 10)), (None, prose(3, 12)), ("12", "the " * 12), ("13", "absent " + prose(4, 20)), ("14", prose(5, 9))]
DOCS = [
    (1, "before " + prose(1, 30) + " after"), (2, prose(1, 30)[:60]), (3, None), (4, ""), (5, "alpha, BETA alpha beta"), (None, prose(2, 10) + " " + prose(3, 12)), (6, "the " * 3000), (7, prose(4, 20)),
    (8, " ".join(reversed(prose(2, 10).split()))), (9, prose(9, 3000) + " " + prose(5, 9)), (1, "before " + prose(1, 30) + " after"), (10, "été"), (11, "unrelated words only"),
]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_contamination(docs, items, window=10, n_keys=3, span=20):
    held = [(i, words_of(t)) for i, t in items if words_of(t)]
    texts = [words_of(t) for _, t in docs]
    count = {}
    for w in texts:
        for x in w:
            count[x] = count.get(x, 0) + 1
    out = []
    for (doc, _), w in zip(docs, texts):
        hit, ids, n_items, n_near = set(), [], 0, 0
        for item, own in held:
            size, found, near = min(window, len(own)), False, False
            for s in range(len(own) - size + 1):
                part = own[s : s + size]
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == part:
                        hit |= set(range(p, p + size))
                        found = True
                if all(x in count for x in part):
                    keys = set(sorted(set(part), key=lambda x: (count[x], x))[:n_keys])
                    near = near or any(w[p] in keys and keys <= set(w[p : p + span]) for p in range(len(w)))
            n_items, n_near = n_items + found, n_near + near
            ids += [item] if found and item is not None else []
        out.append((doc, len(w), len(hit), n_items, sha(",".join(sorted(ids))), bool(hit), n_near))
    return out


def plain(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_decontaminate(spark, monkeypatch):
    docs = common.cut(spark.createDataFrame([(*d, "clash", 0) for d in DOCS], "doc_id long, text string, term string, pos int").coalesce(2))
    items = common.cut(spark.createDataFrame([(*i, "clash") for i in ITEMS], "item_id string, text string, row string").coalesce(1))
    want = plain(brute_contamination(DOCS, ITEMS))
    index = decontaminate.build(docs)
    assert plain(decontaminate.contamination(index, docs, items).collect()) == want
    assert sum(r[5] for r in want) == 8 and any(r[6] > r[3] for r in want)
    # the stored index serves another benchmark, and joins that aren't broadcast give the same
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", -1)
    again = decontaminate.load(spark, index.folder)
    assert plain(decontaminate.contamination(again, docs, items).collect()) == want
    some = [(str(k), t) for k, (_, t) in enumerate(ITEMS[:2])]
    got = decontaminate.contamination(again, docs, spark.createDataFrame(some, "item_id string, text string"), window=5, n_keys=2, span=7)
    assert plain(got.collect()) == plain(brute_contamination(DOCS, some, 5, 2, 7))


def test_matches_are_held_against_the_words(spark):
    """A stretch that only hashes would find is dropped."""
    docs = common.cut(spark.createDataFrame([(1, "a b c d"), (2, "a b x d")], "doc_id long, text string").coalesce(1))
    items = common.cut(spark.createDataFrame([("7", "q a b c")], "item_id string, text string").coalesce(1))
    rows = decontaminate.numbered(docs)
    row = {r.doc_id: r.row for r in rows.collect()}
    found = spark.createDataFrame([(row[1], 0, "7", -1, 0, 2), (row[2], 0, "7", -1, 0, 2), (row[2], 0, "7", -1, 0, 1)], "row long, item long, item_id string, diagonal int, low int, high int")
    assert {tuple(r) for r in decontaminate.verified(found, rows, items).collect()} == {(row[1], 0, "7", 0, 2), (row[2], 0, "7", 0, 1)}


def test_decontaminate_empty(spark):
    docs = common.cut(spark.createDataFrame(DOCS, "doc_id long, text string"))
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert all(r.n_hit == 0 and not r.contaminated and r.items_sha256 == sha("") for r in decontaminate.contamination(decontaminate.build(docs), docs, items.limit(0)).collect())
    assert decontaminate.contamination(decontaminate.build(docs.limit(0)), docs.limit(0), items).count() == 0


def test_index_lists_lie_together(spark):
    index = decontaminate.build(common.cut(spark.createDataFrame([(i, prose(i, 200)) for i in range(20)], "doc_id long, text string").coalesce(2)))
    seen = index.postings.select(F.spark_partition_id().alias("p"), "term").collect()
    for p in {r.p for r in seen}:
        terms = [r.term for r in seen if r.p == p]
        assert terms == sorted(terms)


# ---- 12


def brute_audit(docs, labels):
    texts = [(d, t or "", s or "") for d, t, s in docs]
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, x in labels if x == 1}
    fails = []
    for d, t, s in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        first = min((e for e, u, _ in texts if u == t and e is not None), default=None)
        fails.append((s, d in good and d is not None, d in toxic and d is not None, {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > first}))
    out = []
    for part in {s for s, *_ in fails}:
        own = [x[1:] for x in fails if x[0] == part]
        rows, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order):
                gone = [x for x in left if x[2][f]]
                left = [x for x in left if not x[2][f]]
                earlier = [x for x in own if x[2][f] and any(x[2][e] for e in order[:step])]
                only = [x for x in own if x[2][f] and sum(x[2].values()) == 1]
                shapley[f] += len(gone)
                rows.append((part, order, step + 1, len(left), len(gone), len(earlier), len(only), sum(x[0] for x in gone), sum(x[1] for x in gone), f))
        out += [(*r[:-1], shapley[r[-1]]) for r in rows]
    return out


def test_filter_audit(spark):
    rng = random.Random(5)
    long = " ".join(f"w{i}" for i in range(300))
    texts = [None, "", "a b c", long, long + " #1", "ABC " + long, "x y " * 300, "THE " * 250, " \t\n", prose(1, 5000)]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "", "a", "b"])) for _ in range(150)]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d in [None, *range(0, 40, 2), 2, 2, 4]]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, source string, part string, quality int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(df, marks)
    assert plain(got.collect()) == plain(brute_audit(docs, labels))
    assert filter_audit.audit(df.limit(0), marks).count() == 0
    assert filter_audit.audit(df, marks.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_contractions_of_random_cells():
    counts = np.random.default_rng(1).integers(0, 1 << 40, (3, 2, 2, 2, 2, 2))
    out = filter_audit.contract(counts)
    row = out[(out.filter_order == "DBACE") & (out.step == 3)].iloc[0]
    assert row.kept == counts[0, 0, 0, :, 0].sum() and row.removed == counts[0, 1, 0, :, 0].sum() and row.unique_fails == counts[0, 1, 0, 0, 0, 0]
    assert row.redundant == counts[0, 1].sum() - counts[0, 1, 0, :, 0].sum() and row.good_lost == counts[1, 1, 0, :, 0].sum() and row.toxic_lost == counts[2, 1, 0, :, 0].sum()


# ---- 13


def brute_repair(rows):
    """rows: (role, text) of a conversation in order. All edits by memoised search over whole suffixes."""
    faults, seen = [], set()
    for role, text in rows:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        again = not blank and (role, text) in seen
        cut_off = not blank and not again and re.sub(r"[\x20\x09-\x0D]", "", text)[-1] not in ".!?"
        seen.add((role, text))
        faults.append((blank, again, cut_off))

    def legal(path):
        return re.fullmatch("(s?(ua)+)?", path) is not None

    # plain Bellman iteration: suffix tables are improved until nothing changes
    inf = (10**9, "~", ())
    table = {(i, q): inf for i in range(len(rows) + 1) for q in ("", "s", "u", "a")}
    changed = True
    while changed:
        changed = False
        for i in range(len(rows), -1, -1):
            for q in ("", "s", "u", "a"):
                ways = [(0, "", ())] if i == len(rows) and q in ("", "a") else []
                put = "a" if q == "u" else "u"
                name = {"u": "user", "a": "assistant"}
                c, a, t = table[i, put]
                ways.append((c + 3, "I" + a, ((name[put], ""), *t)))
                if i < len(rows):
                    role, text = rows[i]
                    blank, again, cut_off = faults[i]
                    c, a, t = table[i + 1, q]
                    ways.append((c + 4, "D" + a, t))
                    if not blank and not again:
                        c, a, t = table[i + 1, put]
                        ways.append((c + 3 + 3 * cut_off, "R" + a, ((name[put], text), *t)))
                        if role[:1] in {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}[q]:
                            c, a, t = table[i + 1, role[:1]]
                            ways.append((c + 3 * cut_off, "K" + a, ((role, text), *t)))
                least = min(ways)
                if least < table[i, q]:
                    table[i, q], changed = least, True
    cost, audit, lines = table[0, ""]
    assert legal("".join(r[:1] for r, _ in lines))
    wrong = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (*(sum(f[k] for f in faults) for k in range(3)), wrong, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in lines)))


def brute_conversations(rows):
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        own += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    result = []
    for conv, own in out.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), sha(r[2])))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        result.append((conv, gaps, *brute_repair([(r, t) for _, r, t in own])))
    return result


def conversations(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        roles = rng.choice([["user", "assistant"], ["user", "user", "assistant", "system", "tool", "", None]])
        for turn in range(rng.randrange(longest)):
            text = rng.choice(["Fine.", "Yes!", "No end", "", None, " \n", f"text {rng.randrange(9)}?", "große Frage?\n"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(roles), text))
    return rows


@pytest.mark.parametrize("chunk_rows", [1, 3, 4096])
def test_conversation_repair(spark, chunk_rows):
    rows = conversations(3, 60, 14)
    df = common.cut(spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, key string, copies int").coalesce(3))
    got = conversation_repair.repair(conversation_repair.damaged(df), chunk_rows)[0]
    assert plain(got.collect()) == plain(brute_conversations(rows))


def test_long_conversation_converges(spark):
    rows = [(1, t, ["user", "assistant", "user"][t % 3], f"turn {t}{'.' if t % 5 else ''}") for t in range(3000)] + [(2, 0, "user", "Hello?")]
    df = common.cut(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    damaged = conversation_repair.damaged(df)
    one, lines = conversation_repair.repair(damaged, 64)
    assert plain(one.collect()) == plain(conversation_repair.repair(damaged, 10_000)[0].collect())
    assert lines.where("key = '=1'").count() > 1000
    # fix-up passes run little more than each row once
    parts = conversation_repair.pieces(conversation_repair.judged(damaged), 64)
    ran = conversation_repair.settled(parts).agg(F.sum("ran")).first()[0]
    assert 3000 * 0.9 < ran < 3000 * 1.5


def test_conversation_repair_odd_tables(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.repair(conversation_repair.damaged(df))[0].count() == 0
    lost = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = common.cut(spark.createDataFrame([(lost, 0, "user", "Hello.")], "conv_id long, turn long, role string, text string"))
    assert [tuple(r) for r in conversation_repair.repair(conversation_repair.damaged(df))[0].collect()] == [(lost, 0, 0, 0, 0, 0, 0, "", sha(""))]


def test_chunks_from_any_start_agree():
    kinds = "usaUoA1su0aauUSs"
    for first, second in product([(0, 0, 0, 0), (9, 0, 4, 2), conversation_repair.END], repeat=2):
        old = conversation_repair.costs_of(kinds, first)
        new = conversation_repair.costs_of(kinds, second, (first, *old[:2]))
        assert new[:2] == conversation_repair.costs_of(kinds, second)[:2]
