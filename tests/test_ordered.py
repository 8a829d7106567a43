import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corvane.operators import ordered as O


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    g = np.where(rng.random(600) < 0.7, "hot", rng.choice(["a", "b"], 600))
    pdf = pd.DataFrame({"id": range(600), "g": g, "v": rng.integers(0, 40, 600) / 4.0, "w": rng.random(600)})
    return spark.createDataFrame(pdf), pdf


def test_prefix_sums_equal_running_totals(skewed):
    df, pdf = skewed
    got = O.prefix_sums(df, ["g"], "id", {"c": F.col("v")}, buckets=7).toPandas().sort_values("id")
    want = pdf.groupby("g")["v"].cumsum()
    assert np.allclose(got["c"].to_numpy(), want.to_numpy())


def test_dense_index_is_a_gapless_order_with_ties_by_id(skewed):
    df, pdf = skewed
    got = O.dense_index(df, ["g"], "v", "id", buckets=5).toPandas().sort_values("id")["idx"].to_numpy()
    want = pdf.sort_values(["g", "v", "id"]).assign(i=lambda d: d.groupby("g").cumcount()).sort_values("id")["i"].to_numpy()
    assert (got == want).all()


@pytest.mark.parametrize("by", [[], ["g"]])
def test_exact_quantiles_match_linear_interpolation(skewed, by):
    df, pdf = skewed
    qs = {"a": 0.0, "b": 1 / 3, "c": 0.5, "d": 0.975, "e": 1.0}
    got = O.exact_quantiles(df, by, "w", qs, buckets=9).toPandas()
    groups = pdf.groupby("g") if by else [(None, pdf)]
    for name, part in groups:
        row = got[got["g"] == name].iloc[0] if by else got.iloc[0]
        assert np.allclose([row[k] for k in qs], np.quantile(part["w"], list(qs.values())))


def test_quantiles_ignore_nan_and_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    assert O.exact_quantiles(df, [], "x", {"m": 0.5}).first()["m"] == 2.0


def test_constant_column_falls_in_one_bucket(spark):
    df = spark.range(50).withColumn("x", F.lit(1.0))
    assert O.exact_quantiles(df, [], "x", {"m": 0.5}, buckets=6).first()["m"] == 1.0
    got = O.dense_index(df, [], "x", "id", buckets=6).orderBy("id").collect()
    assert [r["idx"] for r in got] == list(range(50))


def test_event_order_operators_cross_bucket_edges(spark):
    data = [("u", d, i, v, m) for d, i, v, m in [(1, 1, 5, None), (1, 2, 3, 7), (2, 3, 9, None), (4, 4, 9, None), (4, 5, 2, 8), (5, 6, 1, None)]]
    df = spark.createDataFrame(data, "u string, day int, i int, v int, m int")
    nxt = O.with_next(df, ["u"], "day", ["i"], "i", "n").orderBy("i").collect()
    assert [r["n"] for r in nxt] == [2, 3, 4, 5, 6, None]
    prior = O.with_prior_max(df, ["u"], "day", ["i"], "v", "p").orderBy("i").collect()
    assert [r["p"] for r in prior] == [None, 5, 5, 9, 9, 9]
    carried = O.carry_forward(df, ["u"], "day", ["i"], {"m": "c"}).orderBy("i").collect()
    assert [r["c"] for r in carried] == [None, 7, 7, 7, 8, 8]


def test_text_order(spark):
    import random

    rnd = random.Random(0)
    ids = list({"".join(rnd.choice("abéZ ") for _ in range(rnd.randint(0, 9))) for _ in range(120)})
    df = spark.createDataFrame([(x,) for x in ids], "id string")
    got = {r["id"]: r["idx"] for r in O.dense_index(df, [], "id", buckets=7).collect()}
    assert got == {x: i for i, x in enumerate(sorted(ids, key=lambda s: s.encode()))}
