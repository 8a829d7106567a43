"""Queries for bootstrap intervals and tests, with the usual numbers of draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions.numeric import rounded
from corvane.operators import comparison as X, joins as J, resampling as B
from corvane.plans import inputs
from corvane.plans.inputs import BINARY_SQL
from corvane.plans.metrics import conf_sql, rank_sql, show
from corvane.plans.registry import plan, r6, table

INTERVAL, POOLED, ROWS = 10_000, 3_000, 2_000  # draws of intervals and tests, of seed-pooled tests, and where rows themselves are drawn


def draw_sql(ids, seed, stratum="'all'", name="dw", n=ROWS):
    """``(draw, row_id)`` picks of the md5 recipe over ``ids``."""
    return f"""{name}_i AS (SELECT row_id, {stratum} AS stratum, row_number() OVER (PARTITION BY {stratum} ORDER BY row_id) - 1 AS idx,
   count(*) OVER (PARTITION BY {stratum}) AS n FROM {ids}),
{name}_p AS (SELECT d AS draw, stratum, concat('0x', substr(md5('{seed}:' || d || ':' || stratum || ':' || idx), 1, 15))::bigint % n AS pick
   FROM {name}_i, (SELECT unnest(range({n}))::int AS d)),
{name} AS (SELECT draw, row_id FROM {name}_p p JOIN {name}_i i ON i.stratum = p.stratum AND i.idx = p.pick)"""


IDS = "ids AS (SELECT doc_id AS row_id, quality AS y FROM labels)"


@plan("B1_stratified_draws", f"WITH {IDS}, {draw_sql('ids', 42, 'y::varchar')} SELECT draw, row_id, count(*) AS times FROM dw GROUP BY 1, 2")
def b1(spark, sf):
    ids = table(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").alias("y"))
    return B.draws(ids, "row_id", ROWS, 42, "y")


@plan("B2_plain_draws", f"WITH {IDS}, {draw_sql('ids', 42)} SELECT draw, row_id, count(*) AS times FROM dw GROUP BY 1, 2")
def b2(spark, sf):
    return B.draws(table(spark, sf, "labels").select(F.col("doc_id").alias("row_id")), "row_id", ROWS, 42)


def cell_draw_sql(by, seed, stratified, n, source, value):
    """Cells and how often each is drawn, by the integer recipe of the operator: ``drawn(draw, cell, times)``, ``arms(cell, ...)``."""
    b, arm = ", ".join(by), " || ':' || ".join(f"{c}::varchar" for c in by)
    stratum = "y::varchar" if stratified else "'all'"
    x = f"(d * 7919 + idx * 104729 + {seed} * 1299709 + k * 15485863 + 1) % 2147483647"
    y = f"(d * 104723 + idx * 7907 + {seed} * 1299721 + k * 15485867 + 1) % 2147483629"
    steps = "".join(f",\ns{i} AS (SELECT d, stratum, n, (x * x + {c}) % 2147483647 AS x, {e} AS y FROM s{i - 1})" for i, (c, e) in enumerate(
        ((11, "(y * y + 13) % 2147483629"), (101, "(y * y + 1013) % 2147483629"), (1009, "y"), (10007, "y")), 1))
    return f"""cell_rows AS MATERIALIZED (SELECT row_id, any_value(y) AS y, any_value(y)::varchar || '|' || string_agg({arm} || '=' || {value}::varchar, ',' ORDER BY {b}) AS cell FROM {source} GROUP BY row_id),
placed AS MATERIALIZED (SELECT cell, {stratum} AS stratum, row_number() OVER (PARTITION BY {stratum} ORDER BY cell, row_id) - 1 AS idx, count(*) OVER (PARTITION BY {stratum}) AS n,
  dense_rank() OVER (ORDER BY {stratum}) - 1 AS k FROM cell_rows),
s0 AS (SELECT d, stratum, n, {x} AS x, {y} AS y FROM placed, (SELECT unnest(range({n})) AS d)){steps},
drawn AS MATERIALIZED (SELECT s4.d::int AS draw, cell, count(*) AS times FROM s4 JOIN placed p ON p.stratum = s4.stratum AND p.idx = (s4.x * 2147483629 + s4.y) % s4.n GROUP BY 1, 2),
arms AS MATERIALIZED (SELECT DISTINCT cell, {', '.join('p.' + c for c in by)}, p.y, p.{value} FROM {source} p JOIN cell_rows USING (row_id))"""


def boot_sql(by, seed, stratified, n, source="binary_rows"):
    """Metrics ``bt`` per draw of more than one class."""
    b = ", ".join(by)
    return f"""{cell_draw_sql(by, seed, stratified, n, source, 'pred')},
met AS (SELECT {b}, draw, y, pred, sum(times) AS times FROM drawn JOIN arms USING (cell) GROUP BY ALL),
{conf_sql('met', [*by, 'draw'], 'bm', 'sum(times)')}, ok AS (SELECT {b}, draw FROM met GROUP BY ALL HAVING count(DISTINCT y) > 1),
bt AS MATERIALIZED (SELECT bm.* FROM bm JOIN ok USING ({b}, draw))"""


@plan("B3_bootstrap_normal", f"""
WITH {BINARY_SQL}, {boot_sql(['model', 'seed'], 42, True, INTERVAL)}, {conf_sql('binary_rows', ['model', 'seed'])},
o AS (SELECT model, seed, 'mcc' AS metric, mcc AS v FROM m UNION ALL SELECT model, seed, 'accuracy', accuracy FROM m),
d AS (SELECT model, seed, 'mcc' AS metric, stddev_pop(mcc) AS se FROM bt GROUP BY 1, 2 UNION ALL SELECT model, seed, 'accuracy', stddev_pop(accuracy) FROM bt GROUP BY 1, 2)
SELECT model, seed, metric, {r6('v', 4)} AS point, {r6('se', 4)} AS se, {r6('v - 1.959963984540054::double * se', 4)} AS ci_lo, {r6('v + 1.959963984540054::double * se', 4)} AS ci_hi FROM o JOIN d USING (model, seed, metric)
""")
def b3(spark, sf):
    return B.bootstrap_normal(inputs.binary_rows(spark, sf), ["model", "seed"], ["mcc", "accuracy"], INTERVAL)


@plan("B4_bootstrap_percentile", f"""
WITH {BINARY_SQL}, {boot_sql(['model', 'seed'], 42, True, INTERVAL)}, {conf_sql('binary_rows', ['model', 'seed'])}
SELECT model, seed, 'f1_macro' AS metric, {r6('any_value(m.f1_macro)')} AS observed, {r6('avg(bt.f1_macro)')} AS mean, {r6('stddev_samp(bt.f1_macro)')} AS se,
  {r6('quantile_cont(bt.f1_macro, 0.025)')} AS ci_lo, {r6('quantile_cont(bt.f1_macro, 0.975)')} AS ci_hi, count(*) AS n_valid FROM bt JOIN m USING (model, seed) GROUP BY 1, 2
""")
def b4(spark, sf):
    return show(B.bootstrap_percentile(inputs.binary_rows(spark, sf), ["model", "seed"], ["f1_macro"], INTERVAL), ["model", "seed", "metric"], ["n_valid"])


AUC_ROWS_SQL = f"""{BINARY_SQL}, scored AS (SELECT model, seed, row_id, y, (score * 1e12::double)::bigint AS score FROM binary_rows)"""


@plan("B4_bootstrap_auc", f"""
WITH {AUC_ROWS_SQL}, {cell_draw_sql(['model', 'seed'], 42, True, INTERVAL, 'scored', 'score')},
w AS (SELECT model, seed, draw, score, sum(times) FILTER (WHERE y = 1) AS up, sum(times) FILTER (WHERE y = 0) AS down FROM drawn JOIN arms USING (cell) GROUP BY ALL),
c AS (SELECT *, sum(coalesce(down, 0)) OVER (PARTITION BY model, seed, draw ORDER BY score) AS upto FROM w),
a AS (SELECT model, seed, draw, sum(coalesce(up, 0) * (upto - coalesce(down, 0) / 2.0::double)) / (sum(up) * sum(down)) AS auc FROM c GROUP BY 1, 2, 3),
ow AS (SELECT model, seed, score, count(*) FILTER (WHERE y = 1) AS up, count(*) FILTER (WHERE y = 0) AS down FROM scored GROUP BY ALL),
oc AS (SELECT *, sum(down) OVER (PARTITION BY model, seed ORDER BY score) AS upto FROM ow),
o AS (SELECT model, seed, sum(up * (upto - down / 2.0::double)) / (sum(up) * sum(down)) AS observed FROM oc GROUP BY 1, 2)
SELECT model, seed, 'auc' AS metric, {r6('any_value(observed)')} AS observed, {r6('avg(auc)')} AS mean, {r6('stddev_samp(auc)')} AS se,
  {r6('quantile_cont(auc, 0.025)')} AS ci_lo, {r6('quantile_cont(auc, 0.975)')} AS ci_hi, count(auc) AS n_valid FROM a JOIN o USING (model, seed) GROUP BY 1, 2
""")
def b4_auc(spark, sf):
    # scores in whole billionths of a thousandth, so that both engines write the cells' keys alike
    rows = inputs.binary_rows(spark, sf).select("model", "seed", "row_id", "y", F.round(F.col("score") * 1e12).cast("bigint").alias("score"))
    return show(B.bootstrap_auc(rows, ["model", "seed"], INTERVAL), ["model", "seed", "metric"], ["n_valid"])


def delta_sql(seed, stratified, n):
    return f"""two AS (SELECT * FROM binary_rows WHERE model IN (1, 2)), {boot_sql(['model', 'seed'], seed, stratified, n, 'two')}, {conf_sql('two', ['model', 'seed'])},
obs AS (SELECT a.seed, a.mcc - b.mcc AS obs FROM m a JOIN m b ON a.seed = b.seed AND a.model = 1 AND b.model = 2),
dl AS (SELECT a.seed, a.draw, a.mcc - b.mcc AS delta FROM bt a JOIN bt b ON a.seed = b.seed AND a.draw = b.draw AND a.model = 1 AND b.model = 2)"""


SUMMARY = f"""{r6('any_value(obs)')} AS obs, {r6('avg(delta)')} AS mean, {r6('stddev_samp(delta)')} AS se,
 {r6('quantile_cont(delta, 0.025)')} AS ci_lo, {r6('quantile_cont(delta, 0.975)')} AS ci_hi, count(delta) AS n_draws"""


@plan("B5_paired_test", f"""
WITH {BINARY_SQL}, {delta_sql(42, True, INTERVAL)}, j AS (SELECT *, avg(delta) OVER (PARTITION BY seed) AS mn FROM dl JOIN obs USING (seed))
SELECT seed, {SUMMARY}, {r6('avg((abs(delta - mn) >= abs(obs))::int)')} AS p_value, avg((abs(delta - mn) >= abs(obs))::int) < 0.05 AS significant FROM j GROUP BY seed
""")
def b5(spark, sf):
    return show(B.paired_test(inputs.binary_rows(spark, sf), "model", 1, 2, ["seed"], "mcc", INTERVAL), ["seed"], ["n_draws", "significant"])


def sign_sql(n):
    return f"""
WITH {BINARY_SQL}, {delta_sql(0, False, n)}, j AS (SELECT * FROM dl JOIN obs USING (seed))
SELECT seed, {SUMMARY}, {r6('avg(CASE WHEN obs > 0 THEN delta <= 0 ELSE delta >= 0 END::int)')} AS p_one_sided FROM j GROUP BY seed
"""


@plan("B6_paired_sign", sign_sql(POOLED))
def b6(spark, sf, n=POOLED):
    return show(B.paired_sign(inputs.binary_rows(spark, sf), "model", 1, 2, ["seed"], "mcc", n), ["seed"], ["n_draws"])


@plan("B6_paired_sign_10000", sign_sql(INTERVAL))
def b6_full(spark, sf):
    return b6(spark, sf, INTERVAL)


@plan("B7_paired_pooled", f"""
WITH {BINARY_SQL}, {delta_sql(0, False, POOLED)}, po AS (SELECT avg(obs) AS obs, count(*) AS n_seeds FROM obs),
j AS (SELECT * FROM (SELECT draw, avg(delta) AS delta FROM dl GROUP BY draw), po)
SELECT {SUMMARY}, any_value(n_seeds) AS n_seeds, quantile_cont(delta, 0.025) > 0 OR quantile_cont(delta, 0.975) < 0 AS excludes_0,
  quantile_cont(delta, 0.025) > 0 AS better, quantile_cont(delta, 0.975) < 0 AS worse FROM j
""")
def b7(spark, sf):
    out = B.paired_pooled(inputs.binary_rows(spark, sf), "model", 1, 2, "seed", [], "mcc", POOLED)
    return show(out, [], ["n_draws", "n_seeds", "excludes_0", "better", "worse"])


def corr_sql(seed, n):
    """Rank correlations ``co`` of the rows and ``bt`` per draw of the cells, from running counts along the values."""
    def ranked(source, keys, name):
        k = ", ".join(keys)
        ranks = "".join(f""",
{name}_{v} AS (SELECT {k}, {v}, sum(w) OVER (PARTITION BY {k} ORDER BY {v}) - (w - 1) / 2.0::double AS r{v} FROM (SELECT {k}, {v}, sum(w) AS w FROM {name}_w GROUP BY ALL))""" for v in ("y", "pred"))
        return f"""{name}_w AS MATERIALIZED (SELECT {k}, y, pred, sum(times)::double AS w FROM {source} GROUP BY ALL){ranks},
{name}_n AS (SELECT {k}, (sum(w) + 1) / 2 AS mid FROM {name}_w GROUP BY ALL),
{name} AS MATERIALIZED (SELECT {k}, sum(w * (ry - mid) * (rpred - mid)) / nullif(sqrt(sum(w * (ry - mid) ** 2) * sum(w * (rpred - mid) ** 2)), 0) AS rho
  FROM {name}_w JOIN {name}_y USING ({k}, y) JOIN {name}_pred USING ({k}, pred) JOIN {name}_n USING ({k}) GROUP BY {k})"""

    return f"""{inputs.REG_ARMS_SQL}, {cell_draw_sql(['model', 'seed'], seed, False, n, 'reg_arms', 'pred')},
met AS (SELECT model, seed, draw, y, pred, times FROM drawn JOIN arms USING (cell)), every AS (SELECT model, seed, y, pred, 1 AS times FROM reg_arms),
{ranked('met', ['model', 'seed', 'draw'], 'bt')}, {ranked('every', ['model', 'seed'], 'co')}"""


def corr_delta_sql(seed, n):
    return f"""{corr_sql(seed, n)},
obs AS (SELECT a.seed, a.rho - b.rho AS obs FROM co a JOIN co b ON a.seed = b.seed AND a.model = 1 AND b.model = 2),
dl AS (SELECT a.seed, a.draw, a.rho - b.rho AS delta FROM bt a JOIN bt b ON a.seed = b.seed AND a.draw = b.draw AND a.model = 1 AND b.model = 2 WHERE a.rho - b.rho IS NOT NULL)"""


@plan("B3_bootstrap_normal_spearman", f"""
WITH {corr_sql(42, INTERVAL)}, d AS (SELECT model, seed, stddev_pop(rho) AS se FROM bt GROUP BY 1, 2)
SELECT model, seed, 'spearman' AS metric, {r6('rho', 4)} AS point, {r6('se', 4)} AS se, {r6('rho - 1.959963984540054::double * se', 4)} AS ci_lo,
  {r6('rho + 1.959963984540054::double * se', 4)} AS ci_hi FROM co JOIN d USING (model, seed)
""")
def b3_spearman(spark, sf):
    return B.bootstrap_corr_normal(inputs.regression_arms(spark, sf), ["model", "seed"], INTERVAL)


@plan("B5_paired_test_spearman", f"""
WITH {corr_delta_sql(42, INTERVAL)}, j AS (SELECT *, avg(delta) OVER (PARTITION BY seed) AS mn FROM dl JOIN obs USING (seed))
SELECT seed, {SUMMARY}, {r6('avg((abs(delta - mn) >= abs(obs))::int)')} AS p_value, avg((abs(delta - mn) >= abs(obs))::int) < 0.05 AS significant FROM j GROUP BY seed
""")
def b5_spearman(spark, sf):
    return show(B.paired_test(inputs.regression_arms(spark, sf), "model", 1, 2, ["seed"], "spearman", INTERVAL), ["seed"], ["n_draws", "significant"])


@plan("B6_paired_sign_spearman", f"""
WITH {corr_delta_sql(0, INTERVAL)}, j AS (SELECT * FROM dl JOIN obs USING (seed))
SELECT seed, {SUMMARY}, {r6('avg(CASE WHEN obs > 0 THEN delta <= 0 ELSE delta >= 0 END::int)')} AS p_one_sided FROM j GROUP BY seed
""")
def b6_spearman(spark, sf):
    return show(B.paired_sign(inputs.regression_arms(spark, sf), "model", 1, 2, ["seed"], "spearman", INTERVAL), ["seed"], ["n_draws"])


@plan("B7_paired_pooled_spearman", f"""
WITH {corr_delta_sql(0, POOLED)}, po AS (SELECT avg(obs) AS obs, count(*) AS n_seeds FROM obs),
j AS (SELECT * FROM (SELECT draw, avg(delta) AS delta FROM dl GROUP BY draw), po)
SELECT {SUMMARY}, any_value(n_seeds) AS n_seeds, quantile_cont(delta, 0.025) > 0 OR quantile_cont(delta, 0.975) < 0 AS excludes_0,
  quantile_cont(delta, 0.025) > 0 AS better, quantile_cont(delta, 0.975) < 0 AS worse FROM j
""")
def b7_spearman(spark, sf):
    out = B.paired_pooled(inputs.regression_arms(spark, sf), "model", 1, 2, "seed", [], "spearman", POOLED)
    return show(out, [], ["n_draws", "n_seeds", "excludes_0", "better", "worse"])


MULTI_ARMS_SQL = f"""{inputs.MULTI_SQL},
multi_arms AS (SELECT row_id, y, arm, list_position(p, list_max(p)) - 1 AS pred FROM (
  SELECT row_id, y, 1 AS arm, proba AS p FROM multi_rows UNION ALL SELECT row_id, y, 2, list_transform(proba, lambda x, i: round(x, 2) + (i % 3) / 1000.0::double) FROM multi_rows)),
two AS (SELECT arm AS model, 0 AS seed, row_id, y, pred FROM multi_arms)"""


def multi_sign_sql(n):
    return f"""
WITH {MULTI_ARMS_SQL}, {boot_sql(['model'], 0, False, n, 'two')}, {conf_sql('two', ['model'])},
obs AS (SELECT a.mcc - b.mcc AS obs FROM m a, m b WHERE a.model = 1 AND b.model = 2),
j AS (SELECT a.draw, a.mcc - b.mcc AS delta, obs FROM bt a JOIN bt b ON a.draw = b.draw AND a.model = 1 AND b.model = 2, obs)
SELECT {SUMMARY}, {r6('avg(CASE WHEN obs > 0 THEN delta <= 0 ELSE delta >= 0 END::int)')} AS p_one_sided FROM j
"""


@plan("B6_paired_sign_multiclass", multi_sign_sql(POOLED))
def b6_multi(spark, sf, n=POOLED):
    m = inputs.multi_rows(spark, sf)
    best = lambda p: (F.array_position(p, F.array_max(p)) - 1).cast("int")
    coarse = F.transform("proba", lambda x, i: F.round(x, 2) + ((i + 1) % 3) / 1000.0)
    arms = m.select("row_id", "y", F.lit(1).alias("model"), best(F.col("proba")).alias("pred")).unionByName(
        m.select("row_id", "y", F.lit(2).alias("model"), best(coarse).alias("pred")))
    return show(B.paired_sign(arms, "model", 1, 2, [], "mcc", n), [], ["n_draws"])


@plan("B6_paired_sign_multiclass_10000", multi_sign_sql(INTERVAL))
def b6_multi_full(spark, sf):
    return b6_multi(spark, sf, INTERVAL)


@plan("B8_approx_ci", f"""
WITH {BINARY_SQL}, {conf_sql('binary_rows', ['model', 'lang'])}, s AS (SELECT model, lang, n, accuracy, sqrt(greatest(accuracy * (1 - accuracy), 1e-6::double) / n) AS se FROM m)
SELECT model, lang, n, {r6('accuracy')} AS accuracy, {r6('se')} AS se, {r6('greatest(0, accuracy - 1.96::double * se)')} AS ci_lo, {r6('least(1, accuracy + 1.96::double * se)')} AS ci_hi FROM s
""")
def b8(spark, sf):
    from corvane.operators.metrics import class_metrics
    m = class_metrics(inputs.binary_rows(spark, sf), ["model", "lang"]).select("model", "lang", "n", "accuracy")
    return show(B.approx_ci(m, "accuracy", "n"), ["model", "lang"], ["n"])


@plan("B9_ci_flags", f"""
WITH {inputs.CONFIG_SQL}, d AS (SELECT a.dataset, a.emb, a.point - b.point AS diff, sqrt(a.se ** 2 + b.se ** 2) AS se FROM configs a JOIN configs b USING (dataset, emb) WHERE a.tree = 'F' AND b.tree = 'O')
SELECT dataset, emb, {r6('diff')} AS diff, diff - se > 0 OR diff + se < 0 AS excludes_0, diff - se > 0 AS better, diff + se < 0 AS worse FROM d
""")
def b9(spark, sf):
    c = inputs.configs(spark, sf)
    side = lambda t, s: c.where(F.col("tree") == t).select("dataset", "emb", F.col("point").alias(f"p{s}"), F.col("se").alias(f"s{s}"))
    d = side("F", "a").join(side("O", "b"), ["dataset", "emb"])
    se = F.sqrt(F.col("sa") * F.col("sa") + F.col("sb") * F.col("sb"))
    d = d.withColumn("diff", F.col("pa") - F.col("pb")).withColumns({"ci_lo": F.col("diff") - se, "ci_hi": F.col("diff") + se})
    return B.ci_flags(d).select("dataset", "emb", rounded("diff").alias("diff"), "excludes_0", "better", "worse")


GAIN_SQL = f"""{BINARY_SQL},
gain AS (SELECT a.row_id, avg((a.pred = a.y)::int) AS a, avg((b.pred = b.y)::int) AS b, avg((a.pred = a.y)::int - (b.pred = b.y)::int) AS gain
  FROM binary_rows a JOIN binary_rows b USING (row_id, seed) WHERE a.model = 2 AND b.model = 1 GROUP BY a.row_id),
gc AS (SELECT row_id, a, b, gain, n_chars AS coverage FROM gain JOIN documents ON doc_id = row_id)"""


def gains(spark, sf):
    g = X.row_gain(inputs.binary_rows(spark, sf), "model", 2, 1, "row_id", "seed")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), F.col("n_chars").alias("coverage"))
    return g.join(d, "row_id")


@plan("B10_bootstrap_corr", f"""
WITH {GAIN_SQL}, {draw_sql('gc', 0)}, x AS (SELECT draw, gain, coverage FROM dw JOIN gc USING (row_id)),
r AS (SELECT draw, {rank_sql('gain', 'draw', 'a')}, {rank_sql('coverage', 'draw', 'b')} FROM x), c AS (SELECT draw, corr(a, b) AS rho FROM r GROUP BY draw),
o AS (SELECT 1 AS g, gain, coverage FROM gc), ro AS (SELECT {rank_sql('gain', 'g', 'a')}, {rank_sql('coverage', 'g', 'b')} FROM o)
SELECT {r6('quantile_cont(rho, 0.025)')} AS ci_lo, {r6('quantile_cont(rho, 0.975)')} AS ci_hi, count(rho) AS n_draws, {r6('(SELECT corr(a, b) FROM ro)')} AS rho FROM c
""")
def b10(spark, sf):
    return show(B.bootstrap_corr(gains(spark, sf), "gain", "coverage", "row_id", ROWS), [], ["n_draws"])


@plan("B11_bootstrap_mean", f"""
WITH {inputs.CONFIG_SQL}, mt AS (SELECT row_number() OVER (ORDER BY a.dataset, a.emb) AS row_id, a.point - b.point AS diff FROM configs a JOIN configs b USING (dataset, emb) WHERE a.tree = 'F' AND b.tree = 'O'),
{draw_sql('mt', 0)}, p AS (SELECT draw, avg(diff) AS m FROM dw JOIN mt USING (row_id) GROUP BY draw)
SELECT {r6('(SELECT avg(diff) FROM mt)')} AS mean, (SELECT count(*) FROM mt) AS n, {r6('quantile_cont(m, 0.025)')} AS ci_lo, {r6('quantile_cont(m, 0.975)')} AS ci_hi FROM p
""")
def b11(spark, sf):
    from pyspark.sql import Window
    d = X.delta_vs_base(inputs.configs(spark, sf).where("tree IN ('F', 'O')"), ["dataset", "emb"], "tree", "O", "point")
    # one row per (dataset, emb) configuration pair: a table as small as the grid
    ids = d.withColumn("row_id", F.row_number().over(Window.orderBy("dataset", "emb")).cast("bigint")).select("row_id", F.col("delta").alias("diff"))
    return show(B.bootstrap_mean(ids, "diff", "row_id", None, ROWS), [], ["n"])


PHI = "(exp(-z*z/2.0::double) * 0.3989422804014327::double * t * (0.319381530::double + t * (-0.356563782::double + t * (1.781477937::double + t * (-1.821255978::double + t * 1.330274429::double)))))"


@plan("B12_wilcoxon", f"""
WITH RECURSIVE {inputs.CELL_SQL},
ways AS (SELECT 0 AS k, [1.0::double] AS l UNION ALL SELECT k + 1, list_transform(range(0, len(l) + k + 1), lambda s: coalesce(l[s + 1], 0) + CASE WHEN s > k THEN coalesce(l[s - k], 0) ELSE 0 END) FROM ways WHERE k < 50), d AS (SELECT a.dataset, a.test - b.test AS diff FROM cells a JOIN cells b USING (dataset, emb, seed) WHERE a.tree = 'F' AND b.tree = 'O' AND a.test IS NOT NULL AND b.test IS NOT NULL),
tied AS (SELECT dataset, count(*) > count(DISTINCT abs(diff)) OR count(*) FILTER (WHERE diff = 0) > 0 AS tied FROM d GROUP BY 1),
nz AS (SELECT dataset, diff, abs(diff) AS ab FROM d WHERE diff <> 0), r AS (SELECT dataset, diff, ab, {rank_sql('ab', 'dataset', 'r')} FROM nz),
w AS (SELECT dataset, coalesce(sum(r) FILTER (WHERE diff > 0), 0) AS up, coalesce(sum(r) FILTER (WHERE diff < 0), 0) AS dn, count(*)::double AS n FROM r GROUP BY 1),
z AS (SELECT dataset, least(up, dn) AS w, abs(least(up, dn) - n * (n + 1) / 4.0::double) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::double) AS z FROM w),
p AS (SELECT z.dataset, w.n, z.w, z, 1 / (1 + 0.2316419::double * z) AS t FROM z JOIN w USING (dataset)),
s AS (SELECT dataset, count(*) AS n_pairs, avg(diff) AS mean_diff, avg((diff > 0)::int) AS share_better, quantile_cont(diff, 0.5) AS median_diff FROM d GROUP BY 1)
SELECT dataset, n_pairs, {r6('mean_diff')} AS mean_diff, {r6('share_better')} AS share_better, {r6('median_diff')} AS median_diff, {r6('w')} AS w, {r6(f'least(1, 2 * CASE WHEN NOT tied AND n <= 50 THEN list_sum(l[1:floor(w)::int + 1]) / 2.0::double ** n ELSE {PHI} END)')} AS p FROM s JOIN p USING (dataset) JOIN tied USING (dataset) LEFT JOIN ways ON k = n
""")
def b12(spark, sf):
    c = inputs.cells(spark, sf).where("tree IN ('F', 'O') AND test IS NOT NULL").drop("cv", "n")
    d = X.delta_vs_base(c, ["dataset", "emb", "seed"], "tree", "O", "test")
    return show(B.wilcoxon(d, "delta", ["dataset"]), ["dataset"], ["n_pairs"])
