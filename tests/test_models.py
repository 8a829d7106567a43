import numpy as np
from pyspark.sql import functions as F

from corvane.operators import models as ML


def frame(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 2))
    data = [(i, "test" if i % 4 == 0 else "train", int(v[0] > 0), v.tolist(), float(v[1])) for i, v in enumerate(x)]
    return spark.createDataFrame(data, "row_id bigint, split string, y int, ft array<double>, pc double")


def test_a_cell_is_tuned_on_train_and_scored_on_test(spark):
    df = ML.assemble(frame(spark), ["ft", "pc"]).select("row_id", "split", "y", "features")
    space = [dict(max_depth=1, n_trees=1, learning_rate=0.1), dict(max_depth=2, n_trees=3, learning_rate=0.1)]
    pred, record = ML.run_cell(df, "binary", "row_id", {"arm": "ft", "seed": 42}, space, k=2)
    r = record.first()
    assert r["n"] == 30 and r["accuracy"] > 0.9 and r["cv_best"] > 0.8 and r["arm"] == "ft"
    assert {x["row_id"] % 4 for x in pred.select("row_id").collect()} == {0}
    assert all(abs(sum(x["proba"]) - 1) < 1e-9 for x in pred.collect())


def test_search_space_and_arms():
    space = ML.search_space(7, 20, "binary")
    assert space == ML.search_space(7, 20, "binary") and len(space) == 20
    assert all(3 <= s["max_depth"] <= 10 and 100 <= s["n_trees"] <= 600 and 1e-3 <= s["learning_rate"] <= 1e-1 for s in space)
    arms = ML.ablation_arms({"one": ["pc"], "two": ["ft", "pc"]}, ["ft", "pc"], {"A": "a", "B": "b"})
    assert list(arms) == ["one", "two", "plus A", "plus B", "all", "all but A", "all but B"]
    assert arms["all but A"] == ["ft", "pc", "b"] and arms["plus B"] == ["ft", "pc", "b"] and arms["one"] == ["pc"]


def test_balanced_weights_and_pooling(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "y int")
    got = {r["y"]: r["weight"] for r in ML.with_weight(df, "binary").distinct().collect()}
    assert abs(got[0] - 4 / 6) < 1e-12 and got[1] == 2.0
    tokens = spark.createDataFrame([("d", 1), ("d", 1), ("d", 2)], "doc string, t int")
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [4.0, 3.0])], "t int, vec array<double>")
    r = ML.mean_pooled(tokens, vecs, "doc", "t").first()
    assert r["n_tokens"] == 3 and np.allclose(r["pooled"], [2.0, 1.0])


def test_registered_experiments_search_the_full_space(spark, monkeypatch):
    from corvane.plans import models as P

    sf, seen = "/root/testdata/sf0.001", []
    monkeypatch.setattr(ML, "search", lambda data, cells, seeds, k, *a: seen.extend((c, k) for c in cells) or [(dict(max_depth=1, n_trees=1, learning_rate=0.1), 0.5) for _ in cells])
    assert P.m5(spark, sf).first()["cv_best"] == 0.5
    P.m4(spark, sf)
    monkeypatch.setattr(P, "features", lambda *a: (frame(spark).withColumns({"label": F.col("y") * 9, "query_id": F.col("row_id"), **{g: F.array("pc") for g in "ABCD"}}).withColumn("pc", F.array("pc")), None))
    monkeypatch.setattr(ML, "ablation_arms", lambda *a: {"one": ["ft"]})
    records = P.m6(spark, sf)
    assert sorted(r["seed"] for r in records.select("seed").collect()) == [42, 43, 44, 45, 46]
    assert len(seen) == 8 and all(k == 5 and list(c.space) in [ML.search_space(c.seed, 20, t) for t in ("binary", "regression")] for c, k in seen)


def test_sweep_has_all_groups_at_every_k(spark):
    from corvane.plans import retrieval as R

    got = R.n7_groups(spark, "/root/testdata/sf0.001").collect()
    assert {r["k"] for r in got} == set(R.KS)
    assert {tuple(len(r[g]) for g in "ABCD") for r in got} == {(9, 3, 34, 3)}


def test_mean_pooled_moves_tokens_once_and_no_vectors(spark):
    from corvane.operators import models

    tokens = spark.createDataFrame([(i % 7, i * i % 5) for i in range(60)], "entity long, vec_id long")
    vectors = spark.createDataFrame([(k, [float(k), 1.0 / (k + 1)]) for k in range(4)], "vec_id long, vec array<double>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small, large = (models.mean_pooled(tokens, vectors, "entity", "vec_id", limit_bytes=n) for n in (models.VECTOR_BYTES, 0))
        plan = small._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("BroadcastExchange") == 1
        want = {}
        for e, v in ((i % 7, i * i % 5) for i in range(60)):
            if v < 4:
                want.setdefault(e, []).append((float(v), 1.0 / (v + 1)))
        for got in (small.collect(), large.collect()):
            assert {r["entity"]: r["n_tokens"] for r in got} == {e: len(x) for e, x in want.items()}
            assert all(abs(a - sum(c) / len(c)) < 1e-12 for r in got for a, c in zip(r["pooled"], zip(*want[r["entity"]])))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_sweep_equals_a_search_per_k_and_keeps_no_vector_per_neighbour(spark, tmp_path):
    import os

    from corvane.operators import retrieval
    from corvane.plans import inputs, models as plans
    from corvane.session import cut_lineage, shared_dir

    rng = np.random.default_rng(5)
    vec = rng.normal(size=(240, 40)).round(3)
    rows = [(i, v.tolist(), int(i % 4)) for i, v in enumerate(vec)]
    rows[9] = (9, None, 1)
    rows += [rows[20], rows[33], (None, vec[3].tolist(), 2)]  # ids that repeat, and one that is null
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    # no part for some ids: these are nobody's neighbours
    parts = [(i, f"name {i}", "b", "t", int(i % 7), 10.0 * i) for i in range(30) if i % 11] + [(4, "twice", "b", "t", 3, 5.0)]
    spark.createDataFrame(parts, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    sf, ks = str(tmp_path), [1, 5, 30]

    def bytes_kept():
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(shared_dir(spark)) for f in files)

    def sweep(**sizes):
        return {k: sorted((r["query_id"], [[np.nan if x is None else round(x, 5) + 0.0 for x in r[g]] for g in "ABCD"]) for r in f.collect()) for k, f in plans.sweep(spark, sf, ks, **sizes).items()}

    before = bytes_kept()
    looked_up = sweep()
    kept = bytes_kept() - before
    joined = sweep(limit_bytes=0)
    q, lib = inputs.queries_and_library(spark, sf)
    hits = cut_lineage(retrieval.topk_cosine(q, lib, max(ks), exclude_self=True))
    for k in ks:
        f = plans.features(spark, sf, hits.where(F.col("rank") <= k), (k,), k)[0]
        want = sorted((r["query_id"], [[np.nan if x is None else round(x, 5) + 0.0 for x in r[g]] for g in "ABCD"]) for r in f.collect())
        assert len(want) > 200
        for got in (looked_up[k], joined[k]):
            assert [r[0] for r in got] == [r[0] for r in want]
            for a, b in zip(got, want):
                assert all(np.allclose(x, y, atol=2e-5, equal_nan=True) for x, y in zip(a[1], b[1]))
    # a vector per neighbour and k was kept before: 36 of 40 numbers per query
    assert kept < len(rows) * sum(ks) * 40 * 4
