"""Merkle manifest, hard negatives and document fingerprints against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from corvane.llm import merkle, negatives, simhash

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long, leaf string, `_part` int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def lowered(text):
    return None if text is None else text.translate({i: i + 32 for i in range(65, 91)})


def plain_manifest(rows):
    """Sorted (doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, source, lang, n_chars, text)."""
    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i:i + 16])) for i in range(0, len(levels[-1]), 16)])
        return levels

    def path(levels, i):
        out = []
        for nodes in levels[:-1]:
            run = i // 16 * 16
            out.append(("".join(nodes[run:i]), "".join(nodes[i + 1:run + 16])))
            i //= 16
        return out

    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        own = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees.append((own, climb([leaf_of(r) for r in own])))
    top = climb([levels[-1][0] for _, levels in trees])
    out = []
    for at, (own, levels) in enumerate(trees):
        for i, r in enumerate(own):
            steps = path(levels, i) + path(top, at)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = leaf_of((*r[:4], lowered(r[4]))) if tampered else leaf_of(r)
            for before, after in steps:
                node = sha(before + node + after)
            out.append((r[0], leaf_of(r), levels[-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), node, node == top[-1][0]))
    return sorted(out, key=str)


def manifest_of(spark, rows):
    data = [(r[0], r[4], r[2], r[1], r[3], "clash", 1) for r in rows]
    df = spark.createDataFrame(data, DOCUMENT)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    text = F.when(tampered, merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))
    out = merkle.manifest(df, FIELDS, "doc_id", "source", {"text": text})
    return sorted([tuple(r) for r in out.collect()], key=str)


def test_manifest(spark):
    rnd = random.Random(4)
    rows = [(i, f"s{i % 3}" if i % 9 else None, rnd.choice(["en", None]), rnd.choice([None, i]), rnd.choice([None, "", f"Text {i} É", "x" * 300])) for i in range(700)]
    rows += [(None, "s1", None, None, "A"), (None, "s1", None, None, "B"), (5, "s1", "en", 1, "same key"), (1, "alone", "en", 1, "Q"), (2, "", "en", 1, "Q"), (3, "é", "en", 1, "Q")]
    rows += [(77, "copies", "en", 4, "Copy")] * 50
    assert manifest_of(spark, rows) == plain_manifest(rows)


def test_manifest_copies_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "COPIES", 7)
    rows = [(77, "s", "en", 4, "Copy")] * 60 + [(i, "s", "en", 4, "x") for i in range(70, 90)]
    assert manifest_of(spark, rows) == plain_manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 16, 17, 257])
def test_manifest_sizes(spark, n):
    rows = [(i, "one", "en", i, f"T{i}") for i in range(n)]
    assert manifest_of(spark, rows) == plain_manifest(rows)


def plain_negatives(rows):
    ok = [(k, l, tuple(math.floor(256 * float(x)) for x in v)) for k, v, l in rows
          if k is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    ok = list(dict.fromkeys(ok))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in ok:
        if a[0] % 5:
            continue
        others = [(-dot(a[2], b[2]), b[0], b[1]) for b in ok if b[0] != a[0] and len(b[2]) == len(a[2])]
        for score, pid, _ in sorted(o for o in others if o[2] == a[1])[:5]:
            fit = sorted(o for o in others if o[2] != a[1] and 50 * -score <= 100 * -o[0] <= 95 * -score)[:3]
            out += [(a[0], pid, r + 1, nid, -score, -s) for r, (s, nid, _) in enumerate(fit)]
    return sorted(out)


def vectors(n, seed, labels=3, width=8):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(labels, width))
    return [(i, [float(x) for x in centres[i % labels] * rnd.uniform(0, 1) + rnd.normal(size=width) * 0.4], i % labels) for i in range(n)]


def mined(spark, rows, **sizes):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("key", F.lit("x")).withColumn("mark", F.lit(1))
    return sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 5 == 0, **sizes).collect())


def test_hard_negatives(spark):
    rows = vectors(400, 1)
    rows = [(k, [float(np.float32(x)) for x in v], l) for k, v, l in rows]
    rows += [(1000, rows[3][1], 0), (1001, rows[3][1], 1), (1002, rows[3][1], 1), (1003, None, 1), (1004, rows[0][1], None), (1005, [1.0, None] + [0.0] * 6, 0),
             (None, rows[0][1], 0), (1010, [float("nan")] * 8, 1), (1015, [float("inf")] + [1.0] * 7, 1), (1020, [0.0] * 8, 0), (1025, [], 0), (1030, [1.0, 2.0], 1), (1031, [1.0, 1.5], 1),
             (1032, [0.5, 1.0], 2), rows[7], rows[10], rows[10]]
    want = plain_negatives(rows)
    assert len(want) > 300
    assert mined(spark, rows) == want
    # blocks of other sizes, and several chunks of anchors
    assert mined(spark, rows, block_rows=50, chunk_anchors=20) == want


def test_hard_negatives_cases(spark):
    assert mined(spark, []) == []
    same = [(i, [1.0, 0.5, 0.25], 0) for i in range(12)] + [(20 + i, [0.9, 0.45, 0.2], 1) for i in range(6)]
    assert mined(spark, same) == plain_negatives([(k, [float(np.float32(x)) for x in v], l) for k, v, l in same])
    large = [(0, [200.0, -3.0], 0), (1, [1000.0, 5.0], 0), (2, [800.0, 9.0], 1), (3, [2.0 ** 18, 1.0], 0), (4, [2.0 ** 17 + 5, 1.0], 1)]
    assert mined(spark, large) == plain_negatives(large)


def test_segment_bounds_rule_pairs_out(spark):
    rnd = np.random.default_rng(2)
    a = np.floor(rnd.normal(size=(40, 32)) * 20 + 100 * rnd.integers(-1, 2, size=(40, 1)))
    x = np.floor(rnd.normal(size=(300, 32)) * 20 + 100 * rnd.integers(-1, 2, size=(300, 1)))
    true = a @ x.T
    least, most = np.quantile(true, 0.97, axis=1), np.quantile(true, 0.99, axis=1)
    counts = []
    i, j = negatives.reaching(negatives.summaries(a), negatives.summaries(x), least, most, counts)
    wanted = set(zip(*np.nonzero((true >= least[:, None]) & (true <= most[:, None]))))
    assert wanted <= set(zip(i, j))
    assert counts[0] > counts[1] > counts[2] and counts[2] < 0.5 * true.size


def plain_fingerprint(text):
    """Vote by vote."""
    import xxhash

    words = (text or "").encode().lower().split()
    runs = [words[i:i + 5] for i in range(max(1, len(words) - 4))] if words else []
    mask = 2 ** 64 - 1

    def mix(h):
        h = (h ^ h >> 33) * 0xFF51AFD7ED558CCD & mask
        h = (h ^ h >> 33) * 0xC4CEB9FE1A85EC53 & mask
        return h ^ h >> 33

    votes = [0] * 128
    for run in runs:
        h = len(run)
        for w in run:
            h = mix(h * 0x9E3779B97F4A7C15 + xxhash.xxh3_64_intdigest(w) & mask)
        for half, word in enumerate((h, mix(h ^ 0x9E3779B97F4A7C15))):
            for b in range(64):
                votes[64 * half + b] += 1 if word >> b & 1 else -1
    return "".join(f"{sum((votes[64 * half + b] > 0) << b for b in range(64)):016x}" for half in (0, 1))


def alike(a, b):
    return 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 128


def documents(rnd, n):
    words = [f"w{i}" for i in range(300)] + ["É", "ß", "日本"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.choice([1, 3, 5, 6, 40, 300, 700]))) for _ in range(n)]
    return texts


def test_fingerprints(spark):
    rnd = random.Random(3)
    texts = [None, "", " \n", "One", "a b c d e", "A b C d e"] + documents(rnd, 60)
    texts += [texts[20].upper(), texts[20], "loop of the same words " * 4000]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fingerprint string, `_part` int")
    got = {r["doc_id"]: r for r in simhash.compare_with_next(df).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        t, after = t or "", (texts[i - 1] or "")  # the next document in descending order; after the last one the first
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), sha(edited)), i
        assert r["fingerprint"] == plain_fingerprint(t) and r["edited_fingerprint"] == plain_fingerprint(edited)
        assert r["near_edited"] == alike(r["fingerprint"], r["edited_fingerprint"]) and r["near_next"] == alike(r["fingerprint"], plain_fingerprint(after))
    long = [r for r in got.values() if r["n_chars"] > 800]
    assert np.mean([r["near_edited"] for r in long]) > 0.6 > np.mean([r["near_next"] for r in long])


def test_fingerprint_cases(spark):
    schema = "doc_id long, text string"
    assert simhash.compare_with_next(spark.createDataFrame([], schema)).count() == 0
    only = simhash.compare_with_next(spark.createDataFrame([(1, "a b c d")], schema)).first()
    assert (only["n_chars"], only["near_next"], only["edited_sha256"]) == (7, 1.0, sha("a b " + "a b"))
    rows = [(None, "x y z")] * 40 + [(7, "same words here")] * 40 + [(7, None), (3, "b")]
    out = simhash.compare_with_next(spark.createDataFrame(rows, schema)).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(k) for k, _ in rows)
    assert len({r["fingerprint"] for r in out}) == 4


def test_search_within_radius(spark, monkeypatch):
    rnd = random.Random(5)
    base = [rnd.getrandbits(128) for _ in range(30)] + [0]
    values = []
    for b in base:
        for _ in range(20):
            for bit in rnd.sample(range(128), rnd.choice([0, 1, 4, 6, 7, 8, 9, 30])):
                b ^= 1 << bit
            values.append(b)
    values += [base[0]] * 50
    rows = [(i, f"{v:032x}") for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint string")
    want = {i: sum(bin(v ^ w).count("1") <= 7 for w in values) - 1 if i % 3 == 0 else None for i, v in enumerate(values)}
    assert {r["doc_id"]: r["n_near"] for r in simhash.count_within(df, F.col("doc_id") % 3 == 0).collect()} == want
    # leading values cut into parts
    monkeypatch.setattr(simhash, "PART_ROWS", 6)
    assert {r["doc_id"]: r["n_near"] for r in simhash.count_within(df, F.col("doc_id") % 3 == 0).collect()} == want
    assert simhash.count_within(df.where("false"), F.col("doc_id") % 3 == 0).count() == 0
