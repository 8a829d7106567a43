import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import fingerprints as FP, vectors as V
from corvane.operators import context as C, retrieval as R

# broadcast library, broadcast queries, tiles: all three ways must give the same exact answer
WAYS = {"library": dict(limit_bytes=1 << 26), "queries": dict(limit_bytes=64 * 40), "tiles": dict(limit_bytes=64, tile_rows=9)}


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(1)
    q, l = rng.normal(size=(13, 4)).round(2), rng.normal(size=(90, 4)).round(2)
    l[7] = l[3]  # tied neighbours
    l[11] = 0.0
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id bigint, vec array<double>")
    library = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(l)], "lib_id bigint, vec array<double>").repartition(5)
    return queries, library, q, l


def brute(scores, k):
    out = []
    for i, s in enumerate(scores):
        order = sorted(range(len(s)), key=lambda j: (-s[j], j))[:k]
        out += [(i, r + 1, j) for r, j in enumerate(order)]
    return out


def unit(x):
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)


@pytest.mark.parametrize("way", WAYS)
def test_cosine_is_exact_on_every_way(sides, way):
    queries, library, q, l = sides
    hits = R.topk_cosine(queries, library, 6, **WAYS[way]).orderBy("query_id", "rank").collect()
    want = brute(np.round(unit(q) @ unit(l).T, 12), 6)
    assert [(r["query_id"], r["rank"], r["lib_id"]) for r in hits] == want


@pytest.mark.parametrize("way", WAYS)
def test_tanimoto_and_hybrid_on_every_way(sides, way):
    queries, library, q, l = sides
    bits = lambda x: (x > 0).astype(int)
    fp = lambda d: d.withColumn("fp", V.pack_bits(F.filter(F.transform("vec", lambda x, i: F.when(x > 0, i.cast("bigint"))), lambda b: b.isNotNull()), 64))
    both = bits(q) @ bits(l).T
    tan = both / np.maximum(bits(q).sum(1)[:, None] + bits(l).sum(1)[None] - both, 1)
    hits = R.topk_tanimoto(fp(queries), fp(library), 5, **WAYS[way]).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["lib_id"]) for r in hits] == brute(tan, 5)
    cos = unit(q) @ unit(l).T
    z = lambda x: (x - x.mean(1, keepdims=True)) / (x.std(1, ddof=1, keepdims=True) + 1e-9)
    hy = R.topk_hybrid(fp(queries), fp(library), 5, **WAYS[way]).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["lib_id"]) for r in hy] == brute(np.round(z(cos) + z(tan), 10), 5)


def test_fewer_library_rows_than_k_and_self_exclusion(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "id bigint, vec array<double>")
    q, l = v.withColumnRenamed("id", "query_id"), v.withColumnRenamed("id", "lib_id")
    hits = R.topk_cosine(q, l, 10, exclude_self=True)
    assert hits.count() == 6 and hits.where("query_id = lib_id").count() == 0


def test_random_draws_are_distinct_and_repeatable(sides):
    queries, library, _, _ = sides
    a = R.topk_random(queries, library, 20, seed=5)
    got = sorted(tuple(r) for r in a.collect())
    assert got == sorted(tuple(r) for r in R.topk_random(queries, library, 20, seed=5).collect())
    per = a.groupBy("query_id").agg(F.count_distinct("lib_id").alias("n"), F.min("rank"), F.max("rank")).collect()
    assert len(per) == 13 and all(tuple(r)[1:] == (20, 1, 20) for r in per)
    assert got != sorted(tuple(r) for r in R.topk_random(queries, library, 20, seed=6).collect())


def test_profile_clips_negative_weights(spark):
    nb = spark.createDataFrame([(1, 1, 0.5, 10.0), (1, 2, -0.5, 20.0)], "query_id bigint, rank int, sim double, p double")
    r = C.profile_and_density(nb, ["p"], [1, 2]).first()
    assert r["p_mean_k2"] == 15.0 and r["p_std_k2"] == 5.0 and abs(r["p_wmean_k2"] - 10.0) < 1e-6
    assert r["nearest_sim"] == 0.5 and r["k2_sim_mean"] == 0.0 and r["p_mean_k1"] == 10.0


def test_structure_keeps_both_denominators_and_blank_groups(spark):
    nb = spark.createDataFrame(
        [(1, 1, None, "a", "a"), (1, 2, 0.4, "a", "b"), (1, 3, 0.2, "a", "a"), (2, 1, None, "", ""), (2, 2, None, "", "x")],
        "query_id bigint, rank int, fp_sim double, query_group string, lib_group string")
    a, b = C.structure(nb).orderBy("query_id").collect()
    assert (a["fp_sim_k1"], round(a["fp_sim_k5_mean"], 9), round(a["same_group_frac_k10"], 9)) == (0.4, 0.3, round(2 / 3, 9))
    assert (b["fp_sim_k1"], b["fp_sim_k5_mean"], b["same_group_frac_k10"]) == (0.0, 0.0, 0.0)


def test_centroid_stats(spark):
    q = spark.createDataFrame([(1, [2.0, 0.0])], "query_id bigint, vec array<double>")
    nb = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0])], "query_id bigint, rank int, vec array<double>")
    r = C.centroid_stats(q, nb).first()
    assert r["centroid"] == [0.5, 0.5]
    assert abs(r["sim_to_centroid"] - np.sqrt(0.5)) < 1e-6 and abs(r["centroid_spread"] - np.sqrt(0.5)) < 1e-9


def test_vector_text_edge_cases(spark):
    cases = {"[1.0, 2.5]": [1.0, 2.5], "[1., 2.5]": [1.0, 2.5], "1,2,3": [1.0, 2.0, 3.0], "[1.0, ...]": None, "[]": None, "abc": None,
             "[NaN, 1]": [0.0, 1.0], "[Infinity, -Infinity, 1]": [1e6, -1e6, 1.0]}
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "t string")
    got = {r["t"]: r["v"] for r in df.select("t", V.parse_vector(F.col("t")).alias("v")).collect()}
    assert got == {**cases, None: None}


@pytest.mark.parametrize("n_bits", [64, 256, 2048])
def test_bits_round_trip(spark, n_bits):
    spots = sorted({0, 1, 63, n_bits // 2, n_bits - 1})
    df = spark.createDataFrame([(spots,), ([],)], "b array<bigint>")
    out = df.select(V.pack_bits(F.col("b"), n_bits).alias("w")).select(F.size("w").alias("n"), V.unpack_bits(F.col("w")).alias("b"), V.popcount(F.col("w")).alias("c")).collect()
    assert [tuple(r) for r in out] == [(n_bits // 64, spots, len(spots)), (n_bits // 64, [], 0)]


def test_short_text_has_an_empty_fingerprint(spark):
    df = spark.createDataFrame([("two words",), ("",)], "t string")
    assert [r[0] for r in df.select(V.popcount(FP.hashed_fingerprint(F.col("t")))).collect()] == [0, 0]


def test_unusable_vectors_are_left_out(spark):
    lib = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [0.0, 1.0]), (5, [None, 1.0])], "lib_id bigint, vec array<double>")
    q = spark.createDataFrame([(7, [1.0, 1.0]), (8, None), (9, [float("inf"), 0.0])], "query_id bigint, vec array<double>")
    for way in WAYS.values():
        got = [(r["query_id"], r["rank"], r["lib_id"]) for r in R.topk_cosine(q, lib, 3, **way).orderBy("rank").collect()]
        assert got == [(7, 1, 1), (7, 2, 4)]


def test_runs_that_cannot_win_are_not_scored():
    import numpy as np
    from corvane.operators import retrieval as R

    rnd = np.random.default_rng(6)
    # bit sets of very different sizes, each near a few others
    sets = rnd.random((40, 512)) < rnd.choice([0.02, 0.1, 0.3, 0.6], 40)[:, None]
    bits = np.packbits(sets[rnd.integers(0, 40, 6000)] & (rnd.random((6000, 512)) < 0.95), axis=1).view(np.int64)
    # vectors in narrow bundles
    centres = rnd.normal(size=(40, 16))
    vectors = centres[rnd.integers(0, 40, 6000)] + rnd.normal(size=(6000, 16)) * 0.05
    ids = rnd.permutation(6000).astype(np.int64)
    for score, side in ((R._tanimoto_block, {"fp": bits}), (R._cosine_block, {"vec": vectors})):
        at = np.arange(0, 6000, 12)
        queries = {c: m[at] for c, m in side.items()}
        best = R._Best(score, 5, True)
        for part in np.array_split(np.arange(6000), 3):
            best.absorb(ids[at], queries, ids[part], {c: m[part] for c, m in side.items()})
        full = np.round(score(R._ready(queries), R._ready(side)), R.SCORE_DIGITS)
        full[ids[at][:, None] == ids[None, :]] = -np.inf
        for q in range(len(at)):
            order = np.lexsort((ids, -full[q]))[:5]
            assert best.ids[q].tolist() == ids[order].tolist() and np.allclose(best.scores[q], full[q][order])
        assert best.scored < 0.5 * full.size, best.scored / full.size


def test_vector_text_rounds_exact_values(spark):
    from corvane.functions.vectors import format_vector

    values = [2.0 ** -9, 3 * 2.0 ** -9, -(2.0 ** -9), 1.000000005, 1e22 + 2**21, -0.0, 123456789.987654321, -1e-12]
    d = spark.createDataFrame([(0, values), (1, None), (2, [None, 0.5])], "i int, v array<double>")
    got = [r["t"] for r in d.select("i", format_vector(F.col("v")).alias("t")).orderBy("i").collect()]
    assert got == ["[0.00195312,0.00585938,-0.00195312,1.00000000,10000000000000002097152.00000000,-0.00000000,123456789.98765433,-0.00000000]", None, "[0.50000000]"]


@pytest.mark.parametrize("k", [1, 20])
def test_only_scores_that_can_be_kept_are_sorted(monkeypatch, k):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(6000, 16)).round(1)
    v[3000:3200] = v[:200]  # equal scores
    ids, sorted_ = rng.permutation(6000), []
    top = R._Best._top
    monkeypatch.setattr(R._Best, "_top", lambda self, s, l_ids: sorted_.append(s.size) or top(self, s, l_ids))
    best = R._Best(R._cosine_block, k, True)
    best.absorb(ids[:500], {"vec": v[:500]}, ids, {"vec": v})
    unit = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-12)
    s = np.round(unit[:500] @ unit.T, R.SCORE_DIGITS)
    s[np.arange(500), np.arange(500)] = -np.inf
    want = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
    assert (best.ids == ids[want]).all() and sum(sorted_) < best.scored / 5


def test_narrow_fingerprints_come_from_wide_ones(spark):
    d = spark.createDataFrame([(0, "a b c d e " * 9 + "f g h i"), (1, "two words"), (2, ""), (3, None), (4, " ".join(str(i) for i in range(400)))], "i int, t string")
    wide, t = FP.hashed_fingerprint(F.col("t"), 2048, hasher="md5"), F.col("t")
    r = d.select("i", FP.narrower(wide, 128).alias("a"), FP.hashed_fingerprint(t, 128, hasher="md5").alias("b")).orderBy("i").collect()
    assert [x["a"] for x in r] == [x["b"] for x in r]
    from corvane.plans.registry import PLANS
    import corvane.plans  # noqa: F401

    plan = PLANS["G1_hashed_fingerprint"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1  # each run of words is hashed once


def test_few_pairs_are_scored_in_double_precision(monkeypatch):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(5000, 16))
    v[2500:] = v[:2500] + rng.normal(size=(2500, 16)) * 1e-9  # pairs that single precision cannot tell apart
    v[4000:4100] = v[7]  # equal ones
    v[13] = 0.0
    ids, exact = rng.permutation(5000), []
    take, keep = R._Best._take, R._Best._keep
    monkeypatch.setattr(R._Best, "_take", lambda self, at, q_ids, q, l_ids, lib: exact.append(len(at) * len(l_ids)) or take(self, at, q_ids, q, l_ids, lib))
    monkeypatch.setattr(R._Best, "_keep", lambda self, part, q_ids, mine, rows, *rest: exact.append(len(rows)) or keep(self, part, q_ids, mine, rows, *rest))
    best = R._Best(R._cosine_block, 10, True)
    for part in np.array_split(rng.permutation(5000), 2):
        best.absorb(ids, {"vec": v}, ids[part], {"vec": v[part]})
    s = np.round(unit(v) @ unit(v).T, R.SCORE_DIGITS)
    s[np.arange(5000), np.arange(5000)] = -np.inf
    order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :10]
    assert np.allclose(best.scores, np.take_along_axis(s, order, 1), atol=1e-11, rtol=0)
    # sums in another order move a score by one in its last digit, so ids are compared where no other score is that near
    apart = (np.abs(np.diff(np.take_along_axis(s, np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :11], 1), axis=1)) > 2e-12)
    clear = apart & np.concatenate([np.ones((5000, 1), bool), apart[:, :-1]], axis=1)
    assert clear.mean() > 0.5 and (best.ids == ids[order])[clear].all()
    assert (best.ids == ids[order]).mean() > 0.99
    assert sum(exact) < best.scored / 4


def test_tiles_hold_more_library_rows_and_are_not_put_together(sides):
    queries, library, *_ = sides
    hits = R._meet(queries, library, ["vec"], ["vec"], lambda: R._Best(R._cosine_block, 6, False), 64, 9)
    assert hits.count() <= 13 * 6 * 3  # 90 library rows, 36 in a tile
    plan = hits._jdf.queryExecution().executedPlan().toString().splitlines()
    assert sum("hashpartitioning(q_tile" in line and "REPARTITION_BY_NUM" in line for line in plan) == 2


@pytest.mark.parametrize("twice", [False, True])
def test_hybrid_scores_few_pairs_in_double_precision(monkeypatch, twice):
    rng = np.random.default_rng(8)
    n, k = 6000, 5
    vec = rng.normal(size=(n, 8))
    bits = rng.random((n, 64)) < 0.3
    if twice:  # every row comes twice: ties at each rank
        vec[n // 2:], bits[n // 2:] = vec[:n // 2], bits[:n // 2]
    bits[10] = False
    ids = rng.permutation(n)
    lib = {"vec": vec, "fp": np.packbits(bits, axis=1, bitorder="little").view(np.int64)}
    queries = np.r_[10, rng.choice(n, 149, False)]
    q = {c: m[queries] for c, m in lib.items()}
    cells, cosine = [], R._cosine_block
    monkeypatch.setattr(R, "_cosine_block", lambda a, b: (cells.append(len(a["vec"]) * len(b["vec"])), cosine(a, b))[1])
    cos = unit(q["vec"]) @ unit(vec).T
    both = bits[queries].astype(float) @ bits.T
    tan = both / np.maximum(bits[queries].sum(1)[:, None] + bits.sum(1)[None] - both, 1)
    own = ids[queries][:, None] == ids[None, :]
    moments = R._Moments(True)
    for part in (slice(0, 2500), slice(2500, n)):
        moments.absorb(ids[queries], q, ids[part], {c: m[part] for c, m in lib.items()})
    want = np.stack([(~own).sum(1), *[x for s in (cos, tan) for x in ((s * ~own).sum(1), (s * s * ~own).sum(1))]], 1)
    assert np.abs(moments.acc - want).max() < 1e-8
    mean, sd = ([np.array([s[i][~own[i]].mean() for i in range(len(s))]) for s in (cos, tan)], [np.array([s[i][~own[i]].std(ddof=1) for i in range(len(s))]) for s in (cos, tan)])
    q["stats"] = np.stack([mean[0], sd[0], mean[1], sd[1]], 1)
    score = sum((s - m[:, None]) / (d[:, None] + 1e-9) for s, m, d in zip((cos, tan), mean, sd))
    score = np.where(own, -np.inf, np.round(score, R.SCORE_DIGITS))
    best = R._Best(R._hybrid_block, k, True)
    for part in (slice(0, 2500), slice(2500, n)):
        best.absorb(ids[queries], q, ids[part], {c: m[part] for c, m in lib.items()})
    order = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :k]
    assert (best.ids == ids[order]).all() and np.abs(best.scores - np.take_along_axis(score, order, 1)).max() < 1e-11
    # the mean and spread of cosines need no pair, and the search only its first rows
    assert sum(cells) < 0.4 * len(queries) * n
