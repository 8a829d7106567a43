import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import comparison as X, graphs as GR, metrics as M, models as ML, resampling as B
from tests.conftest import rows


def pred(spark, y, p, score=None):
    s = score or [0.0] * len(y)
    return spark.createDataFrame([(1, i, a, b, c) for i, (a, b, c) in enumerate(zip(y, p, s))], "g int, row_id bigint, y int, pred int, score double")


def test_class_metrics_by_hand(spark):
    r = M.class_metrics(pred(spark, [0, 0, 1, 1, 2], [0, 1, 1, 1, 0]), ["g"]).first()
    assert r["n"] == 5 and abs(r["accuracy"] - 0.6) < 1e-12
    assert abs(r["precision"] - (1 / 2 + 2 / 3 + 0) / 3) < 1e-12 and abs(r["recall"] - (1 / 2 + 1 + 0) / 3) < 1e-12
    c, s, t, p = 3, 5, np.array([2, 2, 1]), np.array([2, 3, 0])
    assert abs(r["mcc"] - (c * s - t @ p) / np.sqrt((s * s - p @ p) * (s * s - t @ t))) < 1e-12


def test_mcc_edge_cases(spark):
    assert M.mcc(pred(spark, [0, 1], [1, 1]), ["g"]).first()["mcc"] == 0.0
    assert M.mcc(pred(spark, [0, 1], [0, 1]), ["g"]).first()["mcc"] == 1.0
    assert M.mcc(pred(spark, [0, 1], [1, 0]), ["g"]).first()["mcc"] == -1.0


def test_auc_ties_and_one_class(spark):
    assert M.auc(pred(spark, [0, 1, 1, 0], [0] * 4, [0.5, 0.5, 0.9, 0.1]), ["g"]).first()["auc"] == 0.875
    assert M.auc(pred(spark, [1, 1], [1, 1], [0.1, 0.9]), ["g"]).first()["auc"] is None


def test_average_precision_and_curves(spark):
    d = pred(spark, [1, 0, 1], [0] * 3, [0.9, 0.8, 0.7])
    assert abs(M.average_precision(d, ["g"]).first()["ap"] - (0.5 + 0.5 * 2 / 3)) < 1e-12
    assert [(r["fpr"], r["tpr"]) for r in M.roc_points(d, ["g"]).orderBy(F.desc("threshold")).collect()] == [(0.0, 0.5), (1.0, 0.5), (1.0, 1.0)]


def test_macro_roc_matches_numpy_interp(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 60)
    pr = rng.random((60, 3)).round(1)
    df = spark.createDataFrame([(i, int(a), b.tolist()) for i, (a, b) in enumerate(zip(y, pr))], "row_id bigint, y int, proba array<double>")
    got = M.macro_roc(df).orderBy("i").toPandas()["tpr"].to_numpy()
    want = np.zeros(200)
    for c in range(3):
        th = np.unique(pr[:, c])[::-1]
        fpr = [0.0] + [((pr[:, c] >= t) & (y != c)).sum() / (y != c).sum() for t in th]
        tpr = [0.0] + [((pr[:, c] >= t) & (y == c)).sum() / (y == c).sum() for t in th]
        want += np.interp(np.linspace(0, 1, 200), fpr, tpr) / 3
    assert np.allclose(got, want, atol=1e-9)


def test_spearman_with_ties(spark):
    a, b = [1, 2, 2, 3, 5, 5], [2, 1, 4, 4, 3, 9]
    df = spark.createDataFrame([(1, x, z) for x, z in zip(a, b)], "g int, a int, b int")
    rank = lambda v: [sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2 for x in v]
    assert abs(M.spearman(df, "a", "b", ["g"]).first()["rho"] - np.corrcoef(rank(a), rank(b))[0, 1]) < 1e-12


def test_unknown_predictions_are_counted_but_not_scored(spark):
    df = spark.createDataFrame([(1, "a", "a"), (1, "b", "unknown"), (1, "b", "b")], "g int, y string, pred string")
    r = M.metrics_valid(df, ["g"]).first()
    assert (r["n_total"], r["n_valid"], r["accuracy"]) == (3, 2, 1.0)


def test_draws_have_class_sizes_and_repeat(spark):
    df = spark.range(40).withColumn("y", (F.col("id") < 10).cast("int"))
    d = B.draws(df, "id", 5, 1, "y")
    n = d.join(df, "id").groupBy("draw", "y").agg(F.sum("times").alias("n")).collect()
    assert {(r["y"], r["n"]) for r in n} == {(1, 10), (0, 30)} and len(n) == 10
    assert rows(d, "draw", "id") == rows(B.draws(df.repartition(3), "id", 5, 1, "y"), "draw", "id")
    assert rows(d, "draw", "id") != rows(B.draws(df, "id", 5, 2, "y"), "draw", "id")


def test_equal_arms_have_no_difference(spark):
    base = spark.range(30).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 3 == 0).cast("int").alias("pred"))
    both = base.withColumn("arm", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn("seed", F.lit(42))
    r = B.paired_test(both, "arm", "a", "b", ["seed"], "mcc", 20).first()
    assert r["obs"] == 0.0 and r["se"] == 0.0 and r["p_value"] == 1.0 and not r["significant"]


def test_normal_interval_formula(spark):
    d = pred(spark, [0, 1] * 20, [0, 1, 1, 1] * 10)
    r = B.bootstrap_normal(d, ["g"], ["accuracy"], 30).first()
    assert r["point"] == 0.75 and abs((r["ci_hi"] - r["ci_lo"]) - 2 * 1.959964 * r["se"]) < 3e-4


def test_wilcoxon_drops_zeros(spark):
    df = spark.createDataFrame([("d", float(x)) for x in [1, 2, -3, 4, 0, 5]], "g string, diff double")
    r = B.wilcoxon(df, "diff", ["g"]).first()
    assert r["w"] == 3.0 and r["n_pairs"] == 6 and 0 < r["p"] < 1


def test_interval_clamp_and_flags(spark):
    df = spark.createDataFrame([(0.99, 5), (0.0, 5)], "v double, n int")
    out = B.approx_ci(df, "v", "n").collect()
    assert out[0]["ci_hi"] == 1.0 and out[1]["ci_lo"] == 0.0


SHAPES = {
    1: [("a", "b"), ("b", "c"), ("c", "d")],                              # path
    2: [("a", "b"), ("b", "c"), ("a", "c")],                              # triangle
    3: [("m", x) for x in "abcd"],                                        # star
    4: [("a", "b"), ("c", "d")],                                          # two components
    5: [(x, y) for x in "abcd" for y in "abcd" if x < y],                 # complete
    6: [(f"{i:02d}", f"{(i + 1) % 9:02d}") for i in range(9)],            # cycle
}


@pytest.fixture(scope="module")
def shapes(spark):
    e = spark.createDataFrame([(g, min(x), max(x)) for g, xs in SHAPES.items() for x in xs], "graph_id int, src string, dst string")
    n = [(g, v) for g, xs in SHAPES.items() for v in {w for x in xs for w in x}] + [(7, "solo")]
    return spark.createDataFrame(n, "graph_id int, node string"), e


def test_graph_shapes(shapes):
    nodes, edges = shapes
    cyc = {r["graph_id"]: (r["n_components"], r["n_cycles"]) for r in GR.cycles(nodes, edges).collect()}
    assert cyc == {1: (1, 0), 2: (1, 1), 3: (1, 0), 4: (2, 0), 5: (1, 3), 6: (1, 1), 7: (1, 0)}
    clu = {r["graph_id"]: r["clustering"] for r in GR.clustering(nodes, edges).collect()}
    assert clu == {1: 0.0, 2: 1.0, 3: 0.0, 4: 0.0, 5: 1.0, 6: 0.0, 7: 0.0}
    paths = GR.shortest_paths(edges)
    feats = {r["graph_id"]: (r["diameter"], r["wiener"]) for r in GR.path_features(nodes, paths).collect()}
    assert feats == {1: (3, 10.0), 2: (1, 3.0), 3: (2, 16.0), 4: (0, float("inf")), 5: (1, 6.0), 6: (4, 90.0), 7: (0, 0.0)}
    bet = {r["graph_id"]: r["betweenness_mean"] for r in GR.betweenness(nodes, edges, paths).collect()}
    assert abs(bet[1] - (2 * 2 / 3) / 4) < 1e-9 and bet[2] == 0 and abs(bet[3] - 1 / 5) < 1e-9 and bet[5] == 0 and bet[7] == 0


def test_spectral_join_path_agrees_with_the_bounded_one(shapes):
    nodes, edges = shapes
    keep = "graph_id IN (2, 3, 5)"
    small = {r["graph_id"]: r for r in GR.spectral(nodes.where(keep), edges.where(keep)).collect()}
    large = {r["graph_id"]: r for r in GR.spectral(nodes.where(keep), edges.where(keep), small=1).collect()}
    for g in (2, 3, 5):
        assert abs(small[g]["eigenvector_mean"] - large[g]["eigenvector_mean"]) < 1e-12
        assert abs(small[g]["katz_std"] - large[g]["katz_std"]) < 1e-12
    assert abs(small[2]["eigenvector_mean"] - 1 / np.sqrt(3)) < 1e-6


def test_edge_list_loops(shapes):
    nodes, edges = shapes
    assert rows(GR.edge_list(nodes, edges).where("graph_id = 7")) == [(7, "solo", "solo")]
    assert GR.edge_list(nodes, edges, "isolated").count() == 2 * edges.count() + 1


def test_linear_parts_match_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 3))
    y = x @ rng.normal(size=(3, 2)) + 0.01 * rng.normal(size=(80, 2))
    df = spark.createDataFrame([(i, a.tolist(), b.tolist(), "train" if i < 60 else "test") for i, (a, b) in enumerate(zip(x, y))],
                               "query_id bigint, x array<double>, y array<double>, split string").repartition(3)
    r = ML.r_factors(df, "split", "x", "y")["train"]
    z = np.hstack([np.ones((60, 1)), x[:60], y[:60]])
    assert np.allclose(r.T @ r, z.T @ z) and r.shape == (6, 6)
    res = np.array([r["residual"] for r in ML.residualise(df, "x", "y", "query_id", F.col("split") == "train", alphas=[1e-6]).collect()])
    assert res.shape == (80, 2) and np.abs(res).max() < 0.1
    r2 = ML.complementarity(df, "x", "y", ["a", "b"], ["A", "B"], "split").collect()
    assert all(r["mean_r2"] > 0.99 for r in r2)


def test_near_collinear_columns_keep_their_digits(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=400)
    x = np.column_stack([100 + base, 100 + base + 1e-6 * rng.normal(size=400), rng.normal(size=400), np.full(400, 7e3)])
    y = np.column_stack([2e6 * (x[:, 1] - x[:, 0]) + x[:, 2], x[:, 0]])
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "query_id bigint, x array<double>, y array<double>").repartition(5)
    got = {r["query_id"]: r["residual"] for r in ML.residualise(df, "x", "y", "query_id", F.col("query_id") < 300, alphas=[0.0]).collect()}
    z = np.column_stack([np.ones(400), x[:, :3] - x[:300, :3].mean(0)])
    want = y - z @ np.linalg.lstsq(z[:300], y[:300], rcond=None)[0]
    assert max(abs(np.array(got[i]) - want[i]).max() for i in range(300, 400)) < 1e-6  # x itself is rounded to 1e-14, times slopes of 2e6
    raw = np.column_stack([np.ones(400), x[:, :3]])
    try:
        squared = np.linalg.solve(raw[:300].T @ raw[:300], raw[:300].T @ y[:300])
        assert abs(y[300:] - raw[300:] @ squared).max() > 1e-3
    except np.linalg.LinAlgError:
        pass


def test_one_fold_and_few_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], [3.0]), (2, [2.0, 1.0], [5.0])], "query_id bigint, x array<double>, y array<double>")
    out = ML.residualise(df, "x", "y", "query_id", F.col("query_id") == 1, k=1, alphas=[1.0])
    got = {r["query_id"]: r["residual"] for r in out.collect()}
    assert abs(got[1][0]) < 1e-9 and abs(got[2][0] - 2.0) < 1e-9


def test_pca_reconstructs_and_fixes_signs(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 3)) @ np.diag([3.0, 1.0, 0.2])
    df = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "id int, v array<double>")
    fitted = ML.fit_pca(df, "v", 3)
    out = np.array([r["pca"] for r in ML.apply_pca(df, "v", fitted).orderBy("id").collect()])
    loads = fitted[0].stages[1].pc.toArray() * np.array(fitted[1])
    assert np.allclose(out @ loads.T + x.mean(0), x) and all(loads[np.abs(loads[:, j]).argmax(), j] > 0 for j in range(3))


def test_flip_counts(spark):
    g = spark.createDataFrame([(1.0, 0.0), (0.0, 1.0), (0.0, 0.0), (1.0, 1.0), (0.5, 0.0)], "a double, b double")
    r = X.flip_counts(g).first()
    assert (r["corrected"], r["broken"], r["both_wrong"], r["both_right"]) == (1, 1, 1, 1)


def test_cell_draws_are_fair_and_repeat(spark):
    rng = np.random.default_rng(5)
    y, p = rng.integers(0, 2, 300), rng.integers(0, 2, 300)
    d = pred(spark, y.tolist(), p.tolist())
    per = B.class_draws(d, ["g"], 600, 3, False)
    got = np.array([r["accuracy"] for r in per.collect()])
    hit = (y == p).mean()
    assert len(got) == 600 and abs(got.mean() - hit) < 0.01
    assert abs(got.std() / np.sqrt(hit * (1 - hit) / 300) - 1) < 0.1
    assert rows(per, "draw") == rows(B.class_draws(d.repartition(5), ["g"], 600, 3, False), "draw")
    strata = B.drawn_confusion(d, ["g"], 20, 1, True).groupBy("draw", "y").agg(F.sum("n").alias("n")).collect()
    assert {(r["y"], r["n"]) for r in strata} == {(1, int(y.sum())), (0, 300 - int(y.sum()))}


def test_plain_draws_skip_only_single_class_draws(spark):
    d = pred(spark, [0] * 20 + [1] * 20 + [2], [0] * 20 + [1] * 21)
    assert B.class_draws(d, ["g"], 200, 7, False).count() == 200


def test_exact_signed_rank_tail(spark):
    from itertools import product

    for n in (1, 5, 9):
        sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in product((0, 1), repeat=n)]
        for w in range(0, n * (n + 1) // 2 + 1, 3):
            got = spark.range(1).select(B.exact_tail(F.lit(float(n)), F.lit(float(w))).alias("p")).first()["p"]
            assert abs(got - sum(x <= w for x in sums) / 2**n) < 1e-12


def test_regression_gain_and_flips(spark):
    data = [("a", 1, i, float(i), i + e) for i, e in enumerate([0.0, 4.0, 1.0])] + [("b", 1, i, float(i), i + e) for i, e in enumerate([3.0, 0.0, -1.0])]
    g = X.row_gain(spark.createDataFrame(data, "arm string, seed int, row_id int, y double, pred double"), "arm", "a", "b", "row_id", "seed", True)
    sd = np.std([0, 1, 2])
    got = {r["row_id"]: r for r in g.collect()}
    assert abs(got[0]["a"]) < 1e-12 and abs(got[0]["b"] - 3 / sd) < 1e-9 and abs(got[0]["gain"] - 3 / sd) < 1e-9 and got[2]["raw_b"] == -1.0
    r = X.regression_flips(g).first()
    assert (r["corrected"], r["broken"], r["unchanged"]) == (1, 1, 1)


def test_many_cells_are_drawn_by_the_same_recipe(spark, monkeypatch):
    rng = np.random.default_rng(8)
    y, p = rng.integers(0, 2, 200), rng.integers(0, 3, 200)
    d = pred(spark, y.tolist(), p.tolist())
    scored = d.withColumn("score", (F.col("row_id") * 37 % 101).cast("double"))
    made = lambda: [rows(B.drawn_confusion(d, ["g"], 30, 5, s).select("draw", "y", "pred", "n"), "draw", "y", "pred") for s in (True, False)] + [
        [(r["draw"], round(r["auc"], 9)) for r in B.auc_draws(scored, ["g"], 30, 5, s).orderBy("draw").collect()] for s in (True, False)]
    sent = made()
    monkeypatch.setattr(B, "MOST_CELLS", 0)
    assert made() == sent


def test_draws_reach_every_position_of_huge_strata():
    n, m = 3 * 2**33, 1_000_000
    for first in (0, 2**31 - m // 2, 5 * 2**32):  # slots around and beyond the primes
        got = B.picks(4, np.arange(first, first + m), 42, 1, n)
        assert got.min() >= 0 and got.max() < n and abs(got.mean() / (n / 2) - 1) < 0.005
        shares = np.bincount(got // 2**30, minlength=24) / m
        assert abs(shares * 24 - 1).max() < 0.03
        repeats = m - len(np.unique(got))
        assert repeats < 60  # m * m / 2n = 19 are expected


def test_draws_of_a_small_stratum_are_with_replacement():
    n = 50_000
    missing = [n - len(np.unique(B.picks(d, np.arange(n), 7, 0, n))) for d in range(40)]
    assert abs(np.mean(missing) / (n * (1 - 1 / n) ** n) - 1) < 0.01


def test_hashed_positions_pass_32_bits(spark):
    from corvane.functions.hashing import md5_mod

    got = [r["p"] for r in spark.range(2000).select(md5_mod(F.lit(2**50), F.lit(1), F.col("id")).alias("p")).collect()]
    assert min(got) >= 0 and max(got) < 2**50 and abs(np.mean(got) / 2**49 - 1) < 0.05


def test_unpooled_sign_tests_have_ten_thousand_draws(spark):
    from corvane.plans.registry import PLANS
    import corvane.plans  # noqa: F401

    for name in ("B6_paired_sign_10000", "B6_paired_sign_multiclass_10000"):
        assert {r["n_draws"] for r in PLANS[name](spark, "/root/testdata/sf0.001").collect()} == {10_000}


def mid_ranks(v):
    v = np.asarray(v, float)
    return (v[:, None] > v).sum(1) + ((v[:, None] == v).sum(1) + 1) / 2


def regression_arms(spark, n=60):
    rng = np.random.default_rng(11)
    y = rng.integers(0, 25, n)
    arms = {(a, s): y + rng.integers(0, 10 * (1 + (a == "b")), n) for a in "ab" for s in (42, 43)}
    data = [(a, s, i, float(y[i]), float(p[i])) for (a, s), p in arms.items() for i in range(n)]
    return spark.createDataFrame(data, "arm string, seed int, row_id int, y double, pred double"), y, arms


def test_rank_correlation_draws_match_brute_force(spark):
    d, y, arms = regression_arms(spark)
    # positions follow the keys of the cells, the rows' values as text
    name = lambda i: "|".join([str(float(y[i])), ",".join(f"{a}:{s}={float(arms[a, s][i])}" for a, s in sorted(arms))])
    order = sorted(range(len(y)), key=name)
    want = {}
    for draw in range(25):
        rows_of = np.array(order)[B.picks(draw, np.arange(len(y)), 3, 0, len(y))]
        for (a, s), p in arms.items():
            want[a, s, draw] = np.corrcoef(mid_ranks(y[rows_of]), mid_ranks(p[rows_of]))[0, 1]
    got = {(r["arm"], r["seed"], r["draw"]): r["spearman"] for r in B.corr_draws(d, ["arm", "seed"], 25, 3).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-12


def test_rank_correlation_draws_do_not_depend_on_where_cells_are_held(spark, monkeypatch):
    d, *_ = regression_arms(spark)
    d = d.where("NOT (arm = 'a' AND seed = 43 AND row_id < 9)")  # arms over different rows
    made = lambda: [(r["arm"], r["seed"], r["draw"], round(r["spearman"], 9)) for r in B.corr_draws(d, ["arm", "seed"], 12, 5).orderBy("arm", "seed", "draw").collect()]
    sent = made()
    monkeypatch.setattr(B, "MOST_CELLS", 0)
    assert made() == sent and len(sent) == 48


def test_paired_rank_correlation_summaries(spark):
    d, y, arms = regression_arms(spark)
    rho = {k: np.corrcoef(mid_ranks(y), mid_ranks(p))[0, 1] for k, p in arms.items()}
    gaps = {s: rho["a", s] - rho["b", s] for s in (42, 43)}
    per = {(r["seed"], r["draw"], r["arm"]): r["spearman"] for r in B.corr_draws(d, ["arm", "seed"], 40, 0).collect()}
    deltas = {s: [per[s, k, "a"] - per[s, k, "b"] for k in range(40)] for s in (42, 43)}
    for r in B.paired_sign(d, "arm", "a", "b", ["seed"], "spearman", 40).collect():
        mine = np.array(deltas[r["seed"]])
        assert abs(r["obs"] - gaps[r["seed"]]) < 1e-12 and abs(r["ci_lo"] - np.percentile(mine, 2.5)) < 1e-12
        assert r["p_one_sided"] == (mine <= 0).mean()
    r = B.paired_pooled(d, "arm", "a", "b", "seed", [], "spearman", 40).first()
    pooled = np.mean([deltas[42], deltas[43]], axis=0)
    assert abs(r["obs"] - np.mean(list(gaps.values()))) < 1e-12 and abs(r["ci_hi"] - np.percentile(pooled, 97.5)) < 1e-12 and r["n_seeds"] == 2
    r = B.bootstrap_corr_normal(d, ["arm", "seed"], 40, 0).where("arm = 'b' AND seed = 43").first()
    sd = np.std([per[43, k, "b"] for k in range(40)])
    assert r["point"] == round(rho["b", 43], 4) and abs(r["ci_hi"] - (rho["b", 43] + 1.959964 * sd)) < 1e-4


def test_rank_correlation_without_spread_or_values(spark):
    d = spark.createDataFrame([(a, i, 1.0, float(i)) for a in "ab" for i in range(5)] + [("a", 9, None, 1.0), ("b", 9, 2.0, None)], "arm string, row_id int, y double, pred double")
    assert {r["spearman"] for r in B.corr_draws(d, ["arm"], 4).collect()} == {None}
    assert B.corr_draws(d.limit(0), ["arm"], 4).count() == 0
    r = B.paired_sign(d, "arm", "a", "b", [], "spearman", 4).collect()
    assert r == [] or r[0]["n_draws"] == 0


def test_rank_correlation_cells_do_not_reach_the_driver(spark, monkeypatch):
    from pyspark.sql import DataFrame

    d, *_ = regression_arms(spark, 300)
    seen, collect = [], type(d).collect
    monkeypatch.setattr(type(d), "collect", lambda self: seen.append(len(found := collect(self))) or found)
    per = B.corr_draws(d, ["arm", "seed"], 3)
    monkeypatch.undo()
    assert max(seen) == 4 and per.count() == 12 and isinstance(per, DataFrame)  # the arms alone, not the 300 cells


def test_draws_are_made_where_the_ids_are(spark, monkeypatch):
    df = spark.range(90).select((F.col("id") * 3).alias("id"), F.when(F.col("id") > 2, F.col("id") % 4).cast("int").alias("y"))  # three rows without a stratum
    d = B.draws(df, "id", 7, 1, "y")
    assert "Join" not in d._jdf.queryExecution().executedPlan().toString()
    sent = rows(d, "draw", "id")
    monkeypatch.setattr(B, "MOST_CELLS", 0)
    joined = B.draws(df, "id", 7, 1, "y")
    assert "Join" in joined._jdf.queryExecution().executedPlan().toString() and rows(joined, "draw", "id") == sent


def test_draws_add_up_rows_of_one_id(spark):
    df = spark.range(40).select((F.col("id") % 10).alias("id"), (F.col("id") % 2).cast("int").alias("y"))
    got = B.draws(df, "id", 4, 1, "y").groupBy("draw", "id").agg(F.count("*").alias("k"), F.sum("times").alias("n")).collect()
    assert {r["k"] for r in got} == {1} and sum(r["n"] for r in got) == 160


def test_positions_of_tasks_are_those_of_the_hash(spark):
    from corvane.functions.hashing import md5_mod

    want = [r["p"] for r in spark.range(500).select("id", md5_mod(F.lit(500), F.lit(3), F.lit(6), F.lit("ä"), F.col("id")).alias("p")).orderBy("id").collect()]
    assert B.md5_picks(3, 6, "ä", range(500), 500).tolist() == want


def test_bootstrap_of_rows_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 9, 80).astype(float), rng.normal(size=80).round(1)
    d = spark.createDataFrame([(i, i % 2, float(a[i]), float(b[i]) if i % 11 else None) for i in range(80)], "id int, g int, a double, b double")
    there = np.arange(80) % 11 != 0
    rho, means = [], {0: [], 1: []}
    for draw in range(20):
        rows_of = B.md5_picks(0, draw, "all", range(80), 80)
        rows_of = rows_of[there[rows_of]]
        rho.append(np.corrcoef(mid_ranks(a[rows_of]), mid_ranks(b[rows_of]))[0, 1])
        for g in (0, 1):
            mine = np.arange(g, 80, 2)[B.md5_picks(0, draw, str(g), range(40), 40)]
            means[g].append(b[mine[there[mine]]].mean())  # a null counts for nothing
    for most in (B.MOST_CELLS, 0):
        monkeypatch.setattr(B, "MOST_CELLS", most)
        r = B.bootstrap_corr(d, "a", "b", "id", 20).first()
        assert abs(r["ci_lo"] - np.percentile(rho, 2.5)) < 1e-12 and abs(r["ci_hi"] - np.percentile(rho, 97.5)) < 1e-12 and r["n_draws"] == 20
        for r in B.bootstrap_mean(d, "b", "id", "g", 20).collect():
            assert abs(r["ci_lo"] - np.percentile(means[r["g"]], 2.5)) < 1e-12 and r["n"] == 40
