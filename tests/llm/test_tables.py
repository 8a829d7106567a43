"""URL filters, Jaccard join, language model, neighbour search and the pipeline."""

import math
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from corvane.llm import jaccard_join, language_model, neighbours, url_filters
from corvane.llm.components import components
from tests.llm import brute


def plain_verdict(url, rules, default="allow"):
    rest = url.partition("://")[2] if url else ""
    cut = min([len(rest), *(rest.find(c) for c in "/?#" if c in rest)])
    host, tail = rest[:cut].translate({i: i + 32 for i in range(65, 91)}), rest[cut:]
    path = tail[:min([len(tail), *(tail.find(c) for c in "?#" if c in tail)])]
    fit = [(len(h), len(p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best[2] if best else None, best[3] if best else default


def test_url_filters(spark):
    rules = [*url_filters.RULES, ("allow", "blog.example.com", "/de/x/"), ("block", "b.a.example.net", "/"), ("allow", "example.com", "/de/x")]
    urls = [None, "", "no scheme", "://", "http://", "http://EXAMPLE.net/en/1", "http://a.example.net/en/1", "http://a.example.net/de/", "http://example.network/en/",
            "http://xexample.com/de/", "http://b.example.com/de/x/y?q#f", "http://blog.example.com/de/x/1", "https://z.blog.example.com/de/x/1#a", "http://x.org/fr/", "http://x.org/fr",
            "http://net", "http://net/", "http://b.a.example.net/en/", "http://c.b.a.example.net/en/", "x://h?://y/z", "http://com.example/de/", "http://a..net/", "http://é.net/ü", "a://b://c.net/"]
    rows = [(i, u, "x", "y") for i, u in enumerate(urls * 30)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    frame = url_filters.rules_frame(spark, rules)
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.filter_urls(df, frame, range_rows=20).collect()}
    assert out == {i: plain_verdict(u, rules) for i, u, *_ in rows}
    none = frame.where("false")
    assert {r["verdict"] for r in url_filters.filter_urls(df, none, default="block").collect()} == {"block"}
    assert url_filters.filter_urls(df.where("false"), frame).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 10), (10, 8), (7, 7), (20, 30), (30, 20)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 6)}, 8: 8, 9: 8, 10: 8, 20: 20, 30: 20, **{100 + i: 100 for i in range(41)}}


def test_components_after_more_edges(spark):
    from corvane.llm.components import relabelled

    rnd = random.Random(8)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(150)]
    more = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(120)]
    frame = lambda e: spark.createDataFrame(e, "a long, b long").repartition(5)
    whole = {tuple(r) for r in components(frame(edges + more)).collect()}
    labels = components(frame(edges))
    assert {tuple(r) for r in relabelled(labels, frame(more)).collect()} == whole
    assert relabelled(labels, frame(edges)) is labels
    assert components(frame(edges).where("false")).count() == 0
    assert {tuple(r) for r in relabelled(components(frame(edges).where("false")), frame(edges)).collect()} == {tuple(r) for r in labels.collect()}


def jaccard_rows():
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    base = [[rnd.choice(words) for _ in range(n)] for n in (1, 2, 3, 4, 5, 6, 7, 8, 20, 40, 60, 90, 150, 300)]
    boiler = [rnd.choice(words) for _ in range(30)]
    texts = [None, "", " \n", "A b C", "a B c", "a b c d"]
    for b in base:
        for _ in range(7):
            t = list(b)
            for _ in range(rnd.randint(0, max(1, len(t) // 25))):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            if rnd.random() < 0.3:
                t = t[:-1] or t
            texts.append(" ".join(t).upper() if rnd.random() < 0.3 else "  ".join(t))
    # mostly boilerplate, so that prefixes hold common tokens
    texts += [" ".join(boiler + [rnd.choice(words) for _ in range(rnd.randint(0, 4))]) for _ in range(60)]
    texts += texts[20:30]
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("size,percent,rare,block", [(4, 85, 32, 1024), (4, 85, 1, 8), (5, 80, 2, 4), (2, 60, 1, 16)])
def test_jaccard_components(spark, monkeypatch, size, percent, rare, block):
    monkeypatch.setattr(jaccard_join, "RARE", rare)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = jaccard_rows()
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, n string, comp string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df, size=size, percent=percent).collect()}
    assert got == brute.linked_components(rows, size, percent)


def test_jaccard_edge_rows(spark):
    df = spark.createDataFrame([(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (3, "A B C D E")], "doc_id long, text string")
    got = sorted(((r[0] or 0), r[1], r[2]) for r in jaccard_join.jaccard_components(df).collect())
    assert got == [(0, 2, 3), (3, 2, 3), (5, 2, 3), (5, 2, 3)]
    assert jaccard_join.jaccard_components(df.where("false")).count() == 0


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(4)
    for _ in range(60):
        common = rng.integers(0, 1 << 63, rng.integers(1, 300), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, rng.integers(0, 200), dtype=np.uint64)])) for _ in range(2))
        assert jaccard_join.far_apart(jaccard_join.bitmap(a), jaccard_join.bitmap(b)) <= len(np.setxor1d(a, b))


def test_language_model(spark):
    rnd = random.Random(1)
    left, right = [f"l{i}en" for i in range(60)], [f"r{i}os" for i in range(60)]
    texts = [None, "", "x", "The the THE"] + [" ".join(rnd.choice(w) if rnd.random() < .7 else ("und", "y")[w is right] for _ in range(60)) for w in [left, right] * 60] + ["y " * 500]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, "x"), (None, "x y")]
    out = language_model.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), chunk_docs=30, steps=25).collect()
    tokens = lambda t: [w.lower() for w in brute.words(t)] + [b""]
    is_out = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    counts = {}
    for d, t in rows:
        if not is_out(d):
            for w in tokens(t):
                counts[w] = counts.get(w, 0) + 1
    n = sum(counts.values())
    want = sorted((-1 if d is None else d, is_out(d), len(tokens(t)), sum(w in counts for w in tokens(t)), n,
                   round(sum(math.log10((counts.get(w, 0) + 1) / (n + len(counts) + 1)) for w in tokens(t)), 6)) for d, t in rows)
    assert sorted((-1 if r[0] is None else r[0], r[1], r[2], r[3], r[4], round(r[5], 6)) for r in out) == want
    held = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in out)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert language_model.score_documents(empty).count() == 0


def test_model_is_a_distribution():
    rng = np.random.default_rng(0)
    weights = rng.normal(size=(language_model.N_ROWS, language_model.CLASSES))
    p = np.exp(language_model.class_log_probabilities(weights, np.arange(0, language_model.CONTEXTS, 97)))
    assert np.allclose(p.sum(axis=1), 1)


def test_neighbours(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 24))
    x = centres[rng.integers(0, 30, 1500)] + 0.6 * rng.normal(size=(1500, 24))
    x[5] = x[25]  # a tie
    x *= rng.uniform(0.5, 2.0, (1500, 1))
    rows = [(i, [float(v) for v in r], "x") for i, r in enumerate(x)]
    odd = [(2000, None, "x"), (2020, [0.0] * 24, "x"), (2040, [float("nan")] * 24, "x"), (2060, [1.0, None], "x"), (2080, [float("inf")] + [0.0] * 23, "x"), (2100, [], "x")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, rank string")
    out = neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=20).collect()
    hit = total = 0
    for q in range(0, 1500, 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        best = np.lexsort((np.arange(1500), -scores))[:20]
        mine = sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert all(abs(r["score"] - scores[r["vec_id"]]) < 1e-9 for r in mine)
        assert [(r["score"], r["vec_id"]) for r in mine] == sorted(((r["score"], r["vec_id"]) for r in mine), key=lambda p: (-p[0], p[1]))
        hit += len({r["vec_id"] for r in mine} & set(best.tolist()))
        total += 20
    assert len(out) == total and hit >= 0.9 * total
    few = neighbours.nearest(df.where("vec_id < 5 or vec_id >= 2000"), F.col("vec_id") % 20 == 0, k=20).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3, 4]
    assert neighbours.nearest(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_pipeline(spark, tmp_path):
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("abcdefghiklmnoprstu") for _ in range(rnd.randint(2, 8))) for _ in range(900)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    clean = [prose(rnd.randint(60, 200)) for _ in range(40)]
    near = clean[3].rsplit(" ", 1)[0] + " changed"
    texts = [*clean, clean[2], near, "too short", None, "", prose(80) + " password = hunter22 " + prose(30), "loop loop " * 300]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    seen, docs = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == corpus_pipeline.COLUMNS
    ids = lambda name: sorted(r["doc_id"] for r in seen[name])
    assert ids("quality") == [*range(42), 45]
    assert ids("near duplicates") == [*range(40), 45]
    masked = next(r for r in seen["secrets"] if r["doc_id"] == 45)
    assert "[SECRET]" in masked["text"] and "hunter22" not in masked["text"] and masked["n_chars"] == len(masked["text"])
    assert set(ids("mixing")) <= set(ids("secrets")) and len(seen["mixing"]) >= 40
    assert sum(r["length"] for r in seen["packing"]) >= sum(len(brute.words(r["text"])) for r in seen["mixing"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["packing"])


def test_near_duplicate_stage_with_repeated_ids(spark):
    rnd = random.Random(2)
    text = lambda: " ".join(f"w{rnd.randrange(500)}" for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(1, a), (1, b), (2, a), (2, c), (3, c), (3, c), (4, None), (4, None), (None, a), (None, a), (5, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _key string")
    out = corpus_pipeline.near_duplicate_stage(spark, df, "")
    assert out.columns == corpus_pipeline.COLUMNS
    got = sorted([(r["doc_id"], r["text"]) for r in out.collect()], key=str)
    # one row of each text, every row without a text or an id
    assert sorted(t for i, t in got if i is not None and t) == sorted([a, b, c])
    assert {i for i, t in got if t in (a, b) and i is not None} == {1} and (2, c) in got
    assert sum(t is None for _, t in got) == 2 and (5, "") in got and sum(i is None for i, _ in got) == 2
    assert corpus_pipeline.near_duplicate_stage(spark, df.where("false"), "").count() == 0
