"""Small fixtures with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against brute force."""

import base64
import binascii
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from gleaner.llm import ann, brown_lm, common, license_scan, mixing, quality, sentencepiece_fst, simhash, suffix_dedup, url_filter, warc

SCHEMA = "doc_id long, text string, source string, lang string, n_words string, score string, _text string"
WORDS = ["the", "of", "and", "alpha", "beta", "gamma", "delta", "été", "größe", "señor", "日本"]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (rng.choice(["", "", ".", ","])) for _ in range(n))


TEXTS = [
    (1, "Released under the MIT License. GNU General Public License, version 3 mit license"),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, prose(1, 120)),
    (6, prose(1, 120)),
    (7, prose(1, 119) + " changed"),
    (8, prose(2, 4000)),
    (None, prose(3, 60)),
    (9, "one"),
    (10, "same line here\nsame line here\n\nother"),
    (11, "x" * 30_000),
    (12, "0123456789" * 40),
    (13, prose(4, 50) + prose(1, 60)),
    (5, prose(1, 120)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{(i or 0) % 3}" if i != 9 else None, "en", "clash", "clash", "clash") for i, t in TEXTS]
    return common.cut(spark.createDataFrame(rows, SCHEMA).coalesce(2))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    """Rows by id, in any order within an id."""
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


# ---- 1


def test_license_scan(docs, none):
    got = by_id(license_scan.scan(docs))
    assert sum(map(len, got.values())) == len(TEXTS)
    r = got[1][0]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (13, 3, 3, 11, "gpl,mit")
    assert r.labels == "gpl,mit,mit-release" and r.score == 1.0
    assert (got[2][0].n_words, got[2][0].first_word, got[2][0].labels, got[2][0].score) == (0, None, "", 0.0)
    assert license_scan.scan(none).count() == 0


def test_license_notice_with_gaps(spark):
    notice = license_scan.NOTICES[5][0].split()
    notice.insert(8, "truly")
    df = spark.createDataFrame([(1, "Foo " + " ".join(notice)), (2, " ".join(notice[:6]))], "doc_id long, text string")
    got = by_id(license_scan.scan(df))
    assert got[1][0].labels == "mit-text" and 0.8 < got[1][0].score <= 1 and got[2][0].labels == ""


def test_license_near_misses(spark):
    full = license_scan.NOTICES[-1][0].split()
    texts = {
        "licensed under CC BY-NC 4.0": "cc-by,cc-by-nc-4.0",
        "Licensed under CC BY 4.0.": "cc-by,cc-by-4.0",
        "licensed under CC BY-SA 4.0": "cc-by",
        "licensed under cc by 3 0": "cc-by",
        "Licensed under the GNU General Public License version 2": "gpl",
        "Licensed under the GNU General Public License, version 3": "gpl,gpl-3.0",
        "licensed under the Apache License, version 1.1": "apache",
        # two places within the slack of one another
        "Released under the MIT License. The MIT License follows": "mit,mit-release",
        "the mit license released under the mit license the mit license the mit license": "mit,mit-release",
        # a template of several parts, with words lost and put in
        " ".join(full): "mit-full,mit-text",
        " ".join([*full[:30], "hereby", *full[31:90], *full[93:]]): "mit-full,mit-text",
        " ".join(full[:60]): "mit-text",
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(license_scan.scan(df))
    assert [got[i][0].labels for i in range(len(texts))] == list(texts.values())
    with pytest.raises(ValueError):
        license_scan.template_grams([], [("the of", "x", [])])
    with pytest.raises(ValueError):
        license_scan.template_grams([], [("some licence text", "x", ["other text"])])


# ---- 2


def brute_components(rows, k=3, radius=3):
    prints = [simhash.fingerprint(simhash.shingle_hashes(t, k))[0] & (2**64 - 1) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, p, least.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints)))


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs)
    assert Counter((r.doc_id, r.l0 & (2**64 - 1), r.component_id) for r in got.collect()) == brute_components(TEXTS)
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.shingle_hashes("A b", 3).tolist() == [xxhash.xxh64_intdigest(b"a b", 42)]


def test_simhash_trees_lose_no_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    near = base[:400].copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)
    x = np.unique(np.concatenate([base, near, np.array([0, 1, 3, 7, 15], np.uint64)]))
    for shape in (simhash.CONTRACT, simhash.Shape(radius=7, blocks=4)):
        width, reach = 64 // shape.blocks, shape.radius // shape.blocks
        groups = simhash.Groups(len(x))
        for b in range(shape.blocks):
            values = (x >> np.uint64(b * width)) & np.uint64((1 << width) - 1)
            tree = simhash.grow(values[:700], reach, 40)
            for _, at in simhash.route(tree, values, reach):
                root = simhash.link_shard(x[at][:, None], values[at], reach, shape)
                groups.link(at, at[root])
        want = simhash.Groups(len(x))
        for i in range(len(x)):
            j = np.nonzero(np.bitwise_count(x ^ x[i]) <= shape.radius)[0]
            want.link(np.full(len(j), i), j)
        assert (groups.root == want.root).all()


def test_connected_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 2000 + i) for i in range(50)]
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in root if any(i != j and find(j) == find(i) for j in root)}


# ---- 3


def brute_quality(text):
    w = [x for x in __import__("re").findall("[^\x20\x09-\x0d]+", text or "")]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside), n < 10 or 100 * len(inside) > 20 * n


def test_quality(docs, none):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(docs).collect())
    assert got == Counter((i, *brute_quality(t)) for i, t in TEXTS)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {5, 6, None} and quality.judge(none).count() == 0
    assert quality.keep_good(none).count() == 0


def test_quality_verdict(spark):
    clean = " ".join(random.Random(1).choices(["the", "of", "and", "to"] + [f"word{chr(97 + i)}ing" for i in range(26)], [5, 3, 2, 2] + [3] * 26, k=300))
    df = spark.createDataFrame([(1, clean), (2, clean.upper()), (3, clean.replace(" ", "$$$ ")), (4, clean[:150])], "doc_id long, text string")
    assert {r.doc_id: (r.kept, r.char_distance is None) for r in quality.judge(df).collect()} == {1: (True, False), 2: (False, False), 3: (False, False), 4: (True, True)}


def test_quality_other_scripts(spark):
    rng = random.Random(4)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    scripts = ["абвгдежзийклмнопрстуфхцчшщыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "的一是不了人我在有他这中大来上国", "אבגדהוזחטיכלמנסעפצקרשת"]
    rows = [(k, " ".join(word(s) for _ in range(n)) + ".") for k, (s, n) in enumerate((s, n) for s in scripts for n in (50, 300, 3000))]
    rows.append((99, " ".join("§¶±×÷" * 3 for _ in range(300))))  # signs are no letters
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k].kept and got[k].char_distance is None for k in range(15)) and not got[99].kept


def test_quality_counts_words_in_one_expression(docs):
    plan = quality.judge(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("array_remove(common") <= 2  # one for each word would be 29 loops in a compiled stage


# ---- 4


def test_mix(docs, none):
    rows = mixing.mix(mixing.sized(docs)).collect()
    # a source that is full after three passes can lose a slot or two
    assert len(rows) == len(TEXTS) and 0 <= sum(r["size"] for r in rows) - sum(r.taken for r in rows) <= 8
    taken, target = Counter(), {}
    source = {r.doc_id: r.source for r in docs.collect()}
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) <= 8 for s in target)
    assert mixing.mix(mixing.sized(none)).count() == 0
    again = mixing.mix(mixing.sized(docs)).collect()
    assert Counter(map(tuple, ((r.doc_id, r.taken) for r in again))) == Counter((r.doc_id, r.taken) for r in rows)


def test_mixed_documents_have_the_taken_words(docs):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    words = sum(len((r.text or "").split()) for r in out.collect())
    assert words == sum(r.taken for r in mixing.mix(mixing.sized(docs)).collect())


# ---- 5


def brute_suffix(rows):
    seen, out = set(), []
    for i, t in sorted(((i, t) for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def removed(df):
    lost, others = suffix_dedup.dedup(suffix_dedup.prepared(df))
    rows = [(r.doc_id, len(r.text.encode()), r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in lost.collect()]
    return Counter(rows + [(r.doc_id, len(r.text.encode()), 0, 0, hashlib.sha256(r.text.encode()).hexdigest()) for r in others.collect()])


def test_what_is_left_takes_one_python_function_a_task(docs):
    plan = suffix_dedup.rest_of(docs, length_col=None)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_suffix_dedup(docs, none):
    assert removed(docs) == brute_suffix(TEXTS)
    assert removed(none) == Counter()
    assert suffix_dedup.rest_of(docs, length_col=None).columns == docs.columns


def test_suffix_dedup_common_passage(spark):
    passage, rng = prose(9, 40), random.Random(2)
    rows = [(i, prose(100 + i, 30) + " " + passage[: rng.randrange(90, len(passage))] + prose(500 + i, 10)) for i in range(60)]
    assert removed(spark.createDataFrame(rows, "doc_id long, text string")) == brute_suffix(rows)


def test_suffix_order_and_windows(monkeypatch):
    rng = random.Random(3)
    strings = [[rng.randint(1, rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(0, 60))] + [0] for _ in range(40)]
    text = np.zeros((len(strings), max(map(len, strings))), np.int16)
    for i, s in enumerate(strings):
        text[i, : len(s)] = s
    order = suffix_dedup.sort_suffixes(text, np.array(list(map(len, strings))))
    for i, s in enumerate(strings):
        assert order[i, : len(s)].tolist() == sorted(range(len(s)), key=lambda k: s[k:])
    # large anchors: split by longer cores, or handed on window by window, with the same ranges
    items = [(i, i, 44, bytes(rng.choice(b"ab") for _ in range(44)), bytes(rng.choice(b"ab") for _ in range(44))) for i in range(60)]
    items += [(i, i, 44, b"b" * rng.randrange(45), b"a" * 44) for i in range(60, 90)]
    want, first = set(), {}
    for o, _, pos, left, right in items:
        for r in range(max(0, 44 - len(right)), len(left) + 1):
            w = (r, left[len(left) - r :], right[: 44 - r])
            if first.setdefault(w, o) != o:
                want |= {(o, x) for x in range(pos - r, pos - r + 100)}
    for held in (2, 16, 1000):
        monkeypatch.setattr(suffix_dedup, "STRING", held)
        comparer = suffix_dedup.Comparer()
        comparer.add(items)
        comparer.finish()
        assert {(o, x) for o, _, low, high in comparer.covered for x in range(low, high)} == want
    monkeypatch.setattr(suffix_dedup, "HELD", 5)
    batch = suffix_dedup._excerpts([(7, *it) for it in items])
    rows = [r for b in suffix_dedup._compare(iter([batch])) for r in b.to_pylist()]
    by = {}
    for r in rows:
        by.setdefault((r["w1"], r["w2"]), []).append(r)
    got = {(r["ord"], x) for g in by.values() for r in g if r["kind"] == 2 and r["ord"] != min(q["ord"] for q in g) for x in range(r["pos"], r["stop"])}
    assert got == want


# ---- 6


def test_url_filter(spark):
    urls = ["http://www.Example.com/en/x?q", "https://example.com/en/", "http://a.example.com/de#t", "http://x.net/fr/1", "http://x.net/en/", "ftp://net/es/", "no scheme", None, "", "http://com", "http://casino.org/", "http://COM/", "a://b://c/d", "http://x.net/fr"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(3, urls[3], "clash")], "page_id long, url string, host string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).orderBy("page_id").collect()]
    assert got == [
        (0, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (1, "example.com", "/en/", "example.com/en/", "block"), (2, "a.example.com", "/de", "com/", "allow"),
        (3, "x.net", "/fr/1", "net/fr/", "block"), (3, "x.net", "/fr/1", "net/fr/", "block"), (4, "x.net", "/en/", None, "allow"), (5, "net", "/es/", "net/es/", "block"), (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "", "", None, "allow"),
        (9, "com", "", None, "allow"), (10, "casino.org", "/", None, "block"), (11, "com", "/", "com/", "allow"), (12, "b:", "//c/d", None, "allow"), (13, "x.net", "/fr", None, "allow"),
    ]
    assert url_filter.judge(df.limit(0)).count() == 0


@pytest.mark.parametrize("size, every", [(20_000, 7), (20_000, 20_000), (300_000, 2)])
def test_cascade_is_exact(spark, size, every):
    universe = spark.range(size).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where(F.col("key") == "k7" if every == size else F.crc32("key") % every == 0)
    levels = url_filter.build(listed, universe)
    got = universe.withColumn("found", url_filter.member(levels, F.col("key"))).join(listed.withColumn("there", F.lit(True)), "key", "left")
    assert got.where("found <> coalesce(there, false)").count() == 0 and got.where("found").count() == listed.count() > 0
    assert every == size or len(levels) > 1 and sum(level.bits for level in levels) < 20 * listed.count()


# ---- 7


def test_ann(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    rows = [(i, [float(x) for x in centres[i % 20] + 0.3 * rng.normal(size=16)], "clash") for i in range(3000)]
    for i in range(0, 600, 3):
        rows[i] = (i, rows[0][1], "clash")  # one common vector
    rows += [(5004, [1.0], ""), (5100, [1.0, 2.0], ""), (5000, None, ""), (5001, [0.0] * 16, ""), (5002, [float("nan")] + [1.0] * 15, ""), (5003, [None] + [1.0] * 15, ""), (3, rows[3][1], ""), (None, rows[1][1], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = {}
    for r in ann.search(df, F.col("id") % 100 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    x = np.array([r[1] for r in rows[:3000]])
    assert set(got) == set(range(0, 3000, 100))
    hits = 0
    for q, found in got.items():
        d = ann.distances(x, x[q])
        want = [i for i in np.lexsort((np.arange(3000), d)) if i != q][:10]
        assert sorted(found) == list(range(1, 11)) and all(found[k][1] == d[found[k][0]] for k in found)
        hits += len(set(want) & {v for v, _ in found.values()})
    assert hits >= 0.9 * 10 * len(got)
    monkeypatch.setattr(ann, "LEAF_BLOCK", 50)
    monkeypatch.setattr(ann, "ASK_BLOCK", 3)
    split = ann.search(df, F.col("id") % 100 == 0)
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in split.collect()} == {(q, k): v for q, found in got.items() for k, v in found.items()}
    assert ann.search(df.where("vec_id < 3"), F.col("id") == 0).count() == 2 and ann.search(df.limit(0), F.col("id") == 0).count() == 0


# ---- 8


def test_warc(spark, tmp_path):
    tricky = "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"
    html = ["<p>a</p>", None, "", "<p>a</p>", tricky, "größe", "<p>a</p>", "y" * 200_000]
    rows = [(i if i != 6 else None, f"http://b{i % 2}.example.com/{i}" if i != 5 else None, h, "clash") for i, h in enumerate(html)] + [(4, "http://b0.example.com/4", tricky, "clash")]
    df = common.cut(spark.createDataFrame(rows, "page_id long, url string, html string, offset string").coalesce(2))
    index = warc.read(spark, warc.write(df, str(tmp_path / "warc")))
    got = warc.merged(index).collect()
    assert all(r.intact for r in got) and [(r.surt, r.captured) for r in got] == sorted((r.surt, r.captured) for r in got)
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    seen, want = {}, []
    for i, _, h, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first = seen.setdefault(h or "", i) if (h or "") not in seen else None
        revisit = first is None
        want.append((i, len((h or "").encode()), sha(h), "revisit" if revisit else "response", seen[h or ""] if revisit else None))
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == Counter(want)
    # any record can be taken out by its place alone, and a revisit names its response's record
    taken = {(r.archive, r.offset): r for r in warc.fetch(spark, str(tmp_path / "warc"), index.where("payload_bytes > 3")).collect()}
    assert set(taken) == {(r.archive, r.offset) for r in got if r.payload_bytes > 3}
    ids = {r.headers["X-Page-Id"]: r.headers["WARC-Record-ID"] for r in taken.values() if r.headers["WARC-Type"] == "response" and "X-Page-Id" in r.headers}
    for r in taken.values():
        if r.headers["WARC-Type"] == "revisit":
            assert r.headers["WARC-Refers-To"] == ids[r.headers["X-Refers-To-Page-Id"]]
        elif "X-Page-Id" in r.headers:
            assert bytes(r.block).partition(b"\r\n\r\n")[2].decode() == html[int(r.headers["X-Page-Id"])]
    assert warc.merged(warc.read(spark, warc.write(df.limit(0), str(tmp_path / "none")))).count() == 0


def test_warc_members_end_in_zero():
    records = [b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (n, b"x" * n) for n in (0, 10, 1 << 24, 5, (1 << 25) + 7)]
    data = b"".join(map(warc.member, records))
    assert all(warc.member(r)[-1] == 0 for r in records)
    found = list(warc.walk(data))
    assert [len(block) for *_, block in found] == [0, 10, 1 << 24, 5, (1 << 25) + 7] and [at for at, *_ in found][1:] == [at + n for at, n, *_ in found][:-1]
    with pytest.raises(ValueError):
        warc.parsed(records[1][:-1])


def test_loser_tree():
    rng = random.Random(6)
    for k in (1, 2, 3, 7, 16):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
        assert [runs[i][j] for i, j in warc.LoserTree(runs)] == sorted(x for r in runs for x in r)


# ---- 9


def folds(rows):
    return [t for i, t in rows if binascii.crc32(("" if i is None else str(i)).encode()) % 7 != 2]


def brute_brown(rows, model):
    """Scores recounted word by word; only the choice of classes is taken from the model."""
    lex, classes = model["lexicon"].value, {}
    for rank, h in enumerate(lex.hashes.tolist()):
        classes[h] = int(model["assigned"][rank]), True
    for r in model["words"].collect():
        classes[r["hash"]] = r.k, False
    k_of = lambda w: classes[brown_lm._hash(w)][0] if brown_lm._hash(w) in classes else brown_lm.shape_class(w)
    h_of = lambda w: k_of(w) if classes.get(brown_lm._hash(w), (0, False))[1] else brown_lm.shape_class(w)
    train = [brown_lm.tokens(t) for t in folds(rows)]
    c, moves, mass = Counter(w for t in train for w in t), Counter(), Counter(range(brown_lm.TOTAL))
    mass = {k: 1 for k in range(brown_lm.TOTAL)}
    for w, n in c.items():
        mass[k_of(w)] += n + 1
    tokens_of = Counter(k_of(w) for t in train for w in t)
    for t in train:
        moves.update((h_of(v), k_of(w)) for v, w in zip([brown_lm.END, *t], t))
    ahead = Counter()
    for (h, _), n in moves.items():
        ahead[h] += n
    total = sum(c.values()) + brown_lm.TOTAL
    out = []
    for _, text in rows:
        t, s = brown_lm.tokens(text), 0.0
        for v, w in zip([brown_lm.END, *t], t):
            h, k = h_of(v), k_of(w)
            follow = (moves[h, k] + brown_lm.BACKOFF * (tokens_of[k] + 1) / total) / (ahead[h] + brown_lm.BACKOFF)
            s += math.log10(follow * (c[w] + 1) / mass[k])
        out.append(s)
    return out


@pytest.mark.parametrize("resolved", [0, 3, 12, 1000])
def test_brown(docs, none, resolved):
    got = brown_lm.prepared(docs)
    model = brown_lm.learn(got, resolved=resolved)
    rows = brown_lm.score(got, model).collect()
    c = Counter(w for t in folds(TEXTS) for w in brown_lm.tokens(t))
    n, v = sum(c.values()), len(c)
    want = []
    for (i, t), s in zip(TEXTS, brute_brown(TEXTS, model)):
        w = brown_lm.tokens(t)
        want.append((i, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 5), round(s, 5)))
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in rows) == Counter(want)
    held = min(resolved, sum(x >= brown_lm.LEAST_SEEN for x in c.values()))
    assert len(model["lexicon"].value.hashes) == held and model["words"].count() == v - held
    assert np.allclose((10 ** model["follow"]).sum(1), 1)
    empty = brown_lm.prepared(none)
    assert brown_lm.score(empty, brown_lm.learn(empty)).count() == 0


def test_brown_words_as_arrays():
    rng = random.Random(1)
    texts = ["", " ", "a", "A b", "x" * 70, "y" * 3_000_000, "w1 W2 w3 " * 300_000] + ["".join(rng.choice("ab Z7\t\n\x0b\x0c\r .é\x00\x85\u3000ß") for _ in range(rng.randrange(60))) for _ in range(300)]
    for array in (pa.array(texts), pa.array(["skipped", *texts, "z"]).slice(1, len(texts)), pa.array(texts, pa.large_string())):
        hashed, shaped, begins = brown_lm.token_arrays(array)
        want = [brown_lm.tokens(t) for t in texts]
        flat = [w for t in want for w in t]
        hash_of = {w: brown_lm._hash(w) for w in set(flat)}
        assert len(set(hash_of.values())) == len(hash_of)
        assert hashed.tolist() == [hash_of[w] for w in flat] and shaped.tolist() == [brown_lm.shape_class(w) for w in flat]
        assert begins.tolist() == np.cumsum([0, *map(len, want)])[:-1].tolist()


def test_brown_commonest_words_with_ties(spark):
    words = spark.createDataFrame([(h, 5 if h < 3 else 2 if h < 40 else 1) for h in range(60)], "hash long, n long")
    for most in (0, 2, 3, 10, 40, 45, 60, 99):
        assert sorted(r["hash"] for r in brown_lm.commonest(words, most).collect()) == list(range(min(most, 60)))


def test_brown_exchange_raises_the_likelihood(spark):
    # two kinds of words that take turns, and a third kind after every fourth word
    rng, text = random.Random(9), []
    kinds = [[f"{k}{i}" for i in range(40)] for k in "abc"]
    for i in range(20_000):
        text.append(rng.choice(kinds[2] if i % 4 == 3 else kinds[i % 2]))
    rows = [(i, " ".join(text[i * 100 : i * 100 + 100])) for i in range(200)]
    got = brown_lm.prepared(common.cut(spark.createDataFrame(rows, "doc_id long, text string")))
    for resolved in (1000, 100):
        model = brown_lm.learn(got, resolved=resolved)
        history = model["likelihood"]
        assert len(history) > 1 and all(a < b for a, b in zip(history, history[1:]))
        scored = brown_lm.score(got, model).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
        assert scored[0] > scored[1] + 0.1 * scored[2]  # each token of unseen texts is likelier than without the classes


# ---- 10


def test_sentencepiece(docs, none):
    import sentencepiece

    model = sentencepiece_fst.default_model()
    lib, fst = sentencepiece.SentencePieceProcessor(model_file=model), sentencepiece_fst.Transducer.compile(model)
    for t in [*(t for _, t in TEXTS if t), "  a  b ", "▁x", "日本語 🙂\x00", "aaaaaaaaaaaaaaaaaaaaaaa", "the " * 200, "\n\n\t"]:
        assert fst.encode(t).tolist() == lib.encode(t)
        assert fst.decode(fst.encode(t)) == t.replace("▁", " ")
    rows = sentencepiece_fst.round_trip(docs).collect()
    assert len(rows) == len(TEXTS) and all(r.exact for r in rows) and sentencepiece_fst.round_trip(none).count() == 0
    encoded = sentencepiece_fst.encode(docs)
    back = sentencepiece_fst.decode(encoded).select("row.row.text", F.col("text").alias("back")).collect()
    assert all(r.text == r.back for r in back)


def test_sentencepiece_normaliser_and_own_pieces(tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    texts = ["  a  b ", "", "   ", "ﬁne ①② Ｆｕｌｌ　ｗｉｄｔｈ", "e\u0301te\u0301 A\u030a", "a\tb\nc\u200bd", "가각 한글", "x [SEP]  [SEP]y [SEP", "<a><ab>ﬁ", "▁ ▁x▁", "x ▁ ", "日本語 🙂", "½ ℃ ™ …", *(t for _, t in TEXTS if t and len(t) < 2000)]
    for rule in ("identity", "nfkc", "nmt_nfkc", "nmt_nfkc_cf"):
        for squeeze in (True, False):
            for own in ([], ["[SEP]", "<a>", "<ab>"]):
                model = pb.ModelProto()
                with open(sentencepiece_fst.default_model(), "rb") as f:
                    model.ParseFromString(f.read())
                got = pb.ModelProto()
                got.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
                model.normalizer_spec.precompiled_charsmap = got.normalizer_spec.precompiled_charsmap
                model.normalizer_spec.remove_extra_whitespaces = squeeze
                for k, piece in enumerate(own):
                    model.pieces[500 + k].piece, model.pieces[500 + k].type = piece, model.SentencePiece.USER_DEFINED
                path = f"{tmp_path}/{rule}{squeeze}{len(own)}.model"
                with open(path, "wb") as f:
                    f.write(model.SerializeToString())
                lib, fst = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_fst.Transducer.compile(path)
                for t in texts:
                    assert fst.encode(t).tolist() == lib.encode(t), (rule, squeeze, own, t[:60])


def test_unigram_path_is_the_best():
    pieces = {" ": 0, "a": 1, "b": 2, " a": 3, "ab": 4, "b ": 5, " ab": 6}
    scores = [-3.0, -3.0, -3.0, -4.0, -2.5, -4.0, -9.0]
    fst = sentencepiece_fst.Transducer(pieces, scores, [], [p.encode() for p in pieces], False, True, 0)
    rng = random.Random(8)

    def best(text):
        if not text:
            return 0.0
        return max((scores[i] + best(text[len(p) :]) for p, i in pieces.items() if text.startswith(p)), default=-1e9)

    for _ in range(50):
        t = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 9)))
        ids = fst.encode(t)
        assert fst.decode(ids) == t and math.isclose(sum(scores[i] for i in ids), best(" " + t))


def test_common_parts_stay_in_a_small_cache_and_paths_are_followed_depth_first(monkeypatch):
    import sentencepiece

    monkeypatch.setattr(sentencepiece_fst, "PARTS", 40)
    rng, asked = np.random.default_rng(6), Counter()
    fst = sentencepiece_fst.Transducer.compile(sentencepiece_fst.default_model())
    whole, lib = fst.path, sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.default_model())
    fst.path = lambda part: (asked.update([part]), whole(part))[1]
    words = ["".join(rng.choice(list("abdeghinorstuéß!&\u4e2d\U0001f600"), rng.integers(1, 14))) for _ in range(600)]
    for w in words:
        assert fst.encode(f"{w} the other").tolist() == lib.encode(f"{w} the other")
    assert asked[" other"] == 1 and asked[" the"] == 1 and len(fst._parts) <= 40


def test_workers_give_memory_back():
    resident = lambda: int(next(x for x in open("/proc/self/status") if x.startswith("VmRSS")).split()[1])

    def run(batches):
        for n in batches:
            last = [np.ones(500) for _ in range(n)]
            pins.append(np.ones(500))  # at the heap's end: what lies before it stays with the process
            yield resident()
            del last

    pins, before = [], resident()
    held = list(common.giving_back(run)([50_000]))[0]
    assert held - before > 150_000 and resident() - before < (held - before) // 4
