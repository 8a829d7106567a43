"""Queries for scores, curves, correlations and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions.numeric import rounded
from corvane.functions.text import first_label
from corvane.operators import cleaning as C, metrics as M
from corvane.plans import inputs
from corvane.plans.inputs import BINARY_SQL, MULTI_SQL, REG_SQL
from corvane.plans.registry import plan, r6, table, text_table


def show(df, keys, ints=()):
    return df.select(*keys, *ints, *[rounded(c).alias(c) for c in df.columns if c not in keys and c not in ints])


def conf_sql(source, by, name="m", n="count(*)"):
    """Class metrics from confusion counts, as common table expressions."""
    b = ", ".join(by)
    return f"""
{name}_conf AS (SELECT {b}, y, pred, {n}::double AS n FROM {source} GROUP BY {b}, y, pred),
{name}_side AS (SELECT {b}, y AS c, n AS t, 0 AS p, CASE WHEN y = pred THEN n ELSE 0 END AS tp FROM {name}_conf
                UNION ALL SELECT {b}, pred, 0, n, 0 FROM {name}_conf),
{name}_per AS (SELECT {b}, c, sum(t) AS t, sum(p) AS p, sum(tp) AS tp FROM {name}_side GROUP BY {b}, c),
{name}_agg AS (SELECT {b}, sum(tp) AS c_, sum(t) AS s_, sum(p * t) AS pt, sum(p * p) AS pp, sum(t * t) AS tt,
   avg(CASE WHEN p > 0 THEN tp / p ELSE 0 END) AS precision, avg(CASE WHEN t > 0 THEN tp / t ELSE 0 END) AS recall,
   avg(CASE WHEN t + p > 0 THEN 2 * tp / (t + p) ELSE 0 END) AS f1_macro FROM {name}_per GROUP BY {b}),
{name} AS (SELECT {b}, s_::bigint AS n, c_ / s_ AS accuracy, precision, recall, f1_macro, c_ / s_ AS f1_micro,
   CASE WHEN (s_ * s_ - pp) * (s_ * s_ - tt) > 0 THEN (c_ * s_ - pt) / sqrt((s_ * s_ - pp) * (s_ * s_ - tt)) ELSE 0 END AS mcc FROM {name}_agg)
"""


CLASS_COLS = ", ".join(f"{r6(c)} AS {c}" for c in ("accuracy", "precision", "recall", "f1_macro", "f1_micro", "mcc"))

ARGMAX_SQL = f"{MULTI_SQL}, multi_pred AS (SELECT 1 AS g, row_id, y, (list_position(proba, list_max(proba)) - 1)::int AS pred FROM multi_rows)"


def multi_pred(spark, sf):
    from corvane.functions.numeric import argmax
    return inputs.multi_rows(spark, sf).withColumn("pred", argmax(F.col("proba")))


@plan("A4_confusion", f"WITH {ARGMAX_SQL} SELECT y, pred, count(*) AS n FROM multi_pred GROUP BY 1, 2")
def a4(spark, sf):
    return M.confusion(multi_pred(spark, sf), [])


@plan("A5_class_metrics", f"WITH {BINARY_SQL}, {conf_sql('binary_rows', ['model', 'seed', 'lang'])} SELECT model, seed, lang, n, {CLASS_COLS} FROM m")
def a5(spark, sf):
    return show(M.class_metrics(inputs.binary_rows(spark, sf), ["model", "seed", "lang"]), ["model", "seed", "lang"], ["n"])


@plan("A6_mcc", f"WITH {ARGMAX_SQL}, {conf_sql('multi_pred', ['g'])} SELECT g, {r6('mcc')} AS mcc FROM m")
def a6(spark, sf):
    return show(M.mcc(multi_pred(spark, sf).withColumn("g", F.lit(1)), ["g"]), ["g"])


def auc_sql(source, by, name="auc_t"):
    b = ", ".join(by)
    return f"""{name}_r AS (SELECT *, rank() OVER (PARTITION BY {b} ORDER BY score) + (count(*) OVER (PARTITION BY {b}, score) - 1) / 2.0::double AS r FROM {source}),
{name} AS (SELECT {b}, CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN
   (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0::double) / (sum(y)::double * sum(1 - y)) END AS auc FROM {name}_r GROUP BY {b})"""


@plan("A7_auc", f"WITH {BINARY_SQL}, {auc_sql('binary_rows', ['model', 'seed', 'lang'])} SELECT model, seed, lang, {r6('auc')} AS auc FROM auc_t")
def a7(spark, sf):
    return show(M.auc(inputs.binary_rows(spark, sf), ["model", "seed", "lang"]), ["model", "seed", "lang"])


OVR_SQL = f"""{MULTI_SQL}, ovr AS (SELECT row_id, c AS cls, (y = c)::int AS y, p AS score FROM
 (SELECT row_id, y, unnest(range({inputs.N_CLASSES}))::int AS c, unnest(proba) AS p FROM multi_rows))"""


@plan("A8_auc_ovr", f"WITH {OVR_SQL}, {auc_sql('ovr', ['cls'])} SELECT {r6('avg(auc)')} AS auc_ovr FROM auc_t")
def a8(spark, sf):
    return show(M.auc_ovr(inputs.multi_rows(spark, sf), []), [])


def curve_sql(source, by, name="cv"):
    b = ", ".join(by)
    return f"""{name}_c AS (SELECT {b}, score, sum(y)::double AS n_pos, sum(1 - y)::double AS n_neg FROM {source} GROUP BY {b}, score),
{name} AS (SELECT *, sum(n_pos) OVER w AS tp, sum(n_neg) OVER w AS fp, sum(n_pos) OVER (PARTITION BY {b}) AS p, sum(n_neg) OVER (PARTITION BY {b}) AS n
  FROM {name}_c WINDOW w AS (PARTITION BY {b} ORDER BY score DESC))"""


@plan("A9_average_precision", f"""
WITH {BINARY_SQL}, {OVR_SQL}, {curve_sql('binary_rows', ['model', 'seed'])}, {curve_sql('ovr', ['cls'], 'cm')},
per AS (SELECT cls, sum(n_pos * tp / (tp + fp)) / any_value(p) AS ap FROM cm GROUP BY cls)
SELECT 'binary/' || model || '/' || seed AS what, {r6('sum(n_pos * tp / (tp + fp)) / any_value(p)')} AS ap FROM cv GROUP BY model, seed
UNION ALL SELECT 'class/' || cls, {r6('ap')} FROM per UNION ALL SELECT 'macro', {r6('avg(ap)')} FROM per
""")
def a9(spark, sf):
    b = M.average_precision(inputs.binary_rows(spark, sf), ["model", "seed"]).select(
        F.concat_ws("/", F.lit("binary"), "model", "seed").alias("what"), "ap")
    per = M.average_precision(M.one_vs_rest(inputs.multi_rows(spark, sf), []), ["cls"])
    c = per.select(F.concat_ws("/", F.lit("class"), "cls").alias("what"), "ap")
    macro = per.agg(F.avg("ap").alias("ap")).select(F.lit("macro").alias("what"), "ap")
    return show(b.unionByName(c).unionByName(macro), ["what"])


@plan("A10_curves", f"""
WITH {BINARY_SQL}, {curve_sql('binary_rows', ['model', 'lang'])}
SELECT model, lang, {r6('score')} AS threshold, {r6('fp / n')} AS fpr, {r6('tp / p')} AS tpr, {r6('tp / (tp + fp)')} AS precision, {r6('p / (p + n)')} AS baseline FROM cv
""")
def a10(spark, sf):
    rows = inputs.binary_rows(spark, sf)
    by = ["model", "lang"]
    roc, pr = M.roc_points(rows, by), M.pr_points(rows, by).drop("recall")
    return show(roc.join(pr, [*by, "threshold"]), by)


@plan("A11_reg_metrics", f"""
WITH {REG_SQL} SELECT grp, {r6('sqrt(avg((y - pred) ** 2))', 4)} AS rmse, {r6('avg(abs(y - pred))', 4)} AS mae, {r6('1 - avg((y - pred) ** 2) / var_pop(y)')} AS r2 FROM reg_rows GROUP BY grp
""")
def a11(spark, sf):
    m = M.reg_metrics(inputs.regression_rows(spark, sf), ["grp"])
    return m.select("grp", rounded("rmse", 4).alias("rmse"), rounded("mae", 4).alias("mae"), rounded("r2").alias("r2"))


def rank_sql(col, by, name):
    return f"rank() OVER (PARTITION BY {by} ORDER BY {col}) + (count(*) OVER (PARTITION BY {by}, {col}) - 1) / 2.0::double AS {name}"


@plan("A12_spearman", f"""
WITH {REG_SQL}, r AS (SELECT grp, {rank_sql('y', 'grp', 'ry')}, {rank_sql('pred', 'grp', 'rp')} FROM reg_rows)
SELECT grp, {r6('corr(ry, rp)')} AS rho FROM r GROUP BY grp
""")
def a12(spark, sf):
    return show(M.spearman(inputs.regression_rows(spark, sf), "y", "pred", ["grp"]), ["grp"])


LOGIT_SQL = f"""{MULTI_SQL}, lg AS (SELECT row_id, y, list_transform(proba, lambda x: x * 20.0::double) AS z FROM multi_rows),
lp AS (SELECT row_id, y, z[y + 1] - list_max(z) - ln(list_sum(list_transform(z, lambda s: exp(s - list_max(z))))) AS lp FROM lg)"""


def logits(spark, sf):
    return inputs.multi_rows(spark, sf).select("row_id", "y", F.transform("proba", lambda x: x * 20.0).alias("logits"))


@plan("A14_focal_loss", f"""
WITH {LOGIT_SQL} SELECT {r6('avg(-((1 - exp(lp)) ** 2) * lp)')} AS focal, {r6('avg(-(0.25::double + 0.05::double * y) * ((1 - exp(lp)) ** 2) * lp)')} AS focal_alpha FROM lp
""")
def a14(spark, sf):
    rows = logits(spark, sf)
    alpha = [0.25 + 0.05 * i for i in range(inputs.N_CLASSES)]
    weighted = M.focal_loss(rows, [], alpha=alpha).select(F.col("focal").alias("focal_alpha"))
    return show(M.focal_loss(rows, []).withColumn("focal_alpha", weighted.scalar()), [])


@plan("A15_weighted_ce", f"""
WITH {LOGIT_SQL}, w AS (SELECT y, (SELECT count(*) FROM multi_rows) / ((SELECT count(DISTINCT y) FROM multi_rows) * count(*)::double) AS weight FROM multi_rows GROUP BY y)
SELECT {r6('sum(-weight * lp) / sum(weight)')} AS weighted_ce FROM lp JOIN w USING (y)
""")
def a15(spark, sf):
    rows = logits(spark, sf)
    return show(M.weighted_ce(rows, C.class_weights(rows, "y").select("y", "weight"), []), [])


@plan("A16_huber_mse", f"""
WITH {REG_SQL}, e AS (SELECT grp, abs(y - pred) / 1e5::double AS e FROM reg_rows)
SELECT grp, {r6('avg(CASE WHEN e <= 1 THEN 0.5::double * e * e ELSE e - 0.5::double END)')} AS huber, {r6('avg(e * e)')} AS mse FROM e GROUP BY grp
""")
def a16(spark, sf):
    rows = inputs.regression_rows(spark, sf).withColumns({"y": F.col("y") / 1e5, "pred": F.col("pred") / 1e5})
    return show(M.huber_and_mse(rows, ["grp"]), ["grp"])


LANG_SQL = """said AS (SELECT source, lang AS y, CASE WHEN contains(lower(text), ' the ') THEN 'the' WHEN contains(lower(text), ' der ') THEN 'der'
   WHEN contains(lower(text), ' les ') THEN 'les' ELSE 'unknown' END AS w FROM documents),
lang_pred AS (SELECT source, y, CASE w WHEN 'the' THEN 'en' WHEN 'der' THEN 'de' WHEN 'les' THEN 'fr' ELSE w END AS pred FROM said)"""


def lang_pred(spark, sf):
    word = first_label(F.col("text"), [" the ", " der ", " les "])
    named = F.when(word == " the ", "en").when(word == " der ", "de").when(word == " les ", "fr").otherwise(word)
    return text_table(spark, sf, "documents").select("source", F.col("lang").alias("y"), named.alias("pred"))


@plan("A17_metrics_valid", f"""
WITH {LANG_SQL}, ok AS (SELECT * FROM lang_pred WHERE pred <> 'unknown'), {conf_sql('ok', ['source'])},
t AS (SELECT source, count(*) AS n_total, count(*) FILTER (WHERE pred <> 'unknown') AS n_valid FROM lang_pred GROUP BY source)
SELECT source, n_total, n_valid, {CLASS_COLS} FROM t LEFT JOIN m USING (source)
""")
def a17(spark, sf):
    return show(M.metrics_valid(lang_pred(spark, sf), ["source"]), ["source"], ["n_total", "n_valid"])


@plan("A21_metric_agreement", f"""
WITH {inputs.CELL_SQL}, b AS (SELECT dataset, test, cv, n FROM cells WHERE test IS NOT NULL AND cv IS NOT NULL UNION ALL SELECT 'ALL', test, cv, n FROM cells WHERE test IS NOT NULL AND cv IS NOT NULL),
r AS (SELECT dataset, {rank_sql('test', 'dataset', 'a')}, {rank_sql('cv', 'dataset', 'b')}, {rank_sql('n', 'dataset', 'c')} FROM b)
SELECT dataset, 'test' AS a, 'cv' AS b, {r6('corr(a, b)')} AS rho FROM r GROUP BY dataset
UNION ALL SELECT dataset, 'test', 'n', {r6('corr(a, c)')} FROM r GROUP BY dataset UNION ALL SELECT dataset, 'cv', 'n', {r6('corr(b, c)')} FROM r GROUP BY dataset
""")
def a21(spark, sf):
    cells = inputs.cells(spark, sf).dropna(subset=["test", "cv"])
    return show(M.metric_agreement(cells, "dataset", ["test", "cv", "n"]), ["dataset", "a", "b"])


@plan("A31_macro_roc", f"""
WITH {OVR_SQL}, {curve_sql('ovr', ['cls'])},
pts AS (SELECT cls, fp / n AS fpr, tp / p AS tpr FROM cv UNION ALL SELECT DISTINCT cls, 0.0::double, 0.0::double FROM cv),
st AS (SELECT cls, fpr, min(tpr) AS lo, max(tpr) AS hi FROM pts GROUP BY 1, 2),
seg AS (SELECT *, lead(fpr) OVER w AS nf, lead(lo) OVER w AS nl FROM st WINDOW w AS (PARTITION BY cls ORDER BY fpr)),
g AS (SELECT i, i / 199.0::double AS x FROM (SELECT unnest(range(200)) AS i)),
v AS (SELECT i, x, cls, CASE WHEN nf IS NULL THEN hi ELSE hi + (nl - hi) / (nf - fpr) * (x - fpr) END AS t FROM g JOIN seg ON x >= fpr AND x < coalesce(nf, 2.0::double))
SELECT i, {r6('any_value(x)')} AS fpr, {r6('avg(t)')} AS tpr FROM v GROUP BY i
""")
def a31(spark, sf):
    return show(M.macro_roc(inputs.multi_rows(spark, sf)), ["i"])


@plan("A32_two_scales", f"""
WITH {REG_SQL}, l AS (SELECT 'raw' AS scale, grp, y, pred FROM reg_rows UNION ALL SELECT 'log1p', grp, ln(1 + y), ln(1 + pred) FROM reg_rows)
SELECT scale, grp, {r6('sqrt(avg((y - pred) ** 2))', 4)} AS rmse, {r6('avg(abs(y - pred))', 4)} AS mae, {r6('1 - avg((y - pred) ** 2) / var_pop(y)')} AS r2 FROM l GROUP BY 1, 2
""")
def a32(spark, sf):
    rows = inputs.regression_rows(spark, sf)
    both = [M.reg_metrics(rows, ["grp"], s).withColumn("scale", F.lit(s)) for s in ("raw", "log1p")]
    u = both[0].unionByName(both[1])
    return u.select("scale", "grp", rounded("rmse", 4).alias("rmse"), rounded("mae", 4).alias("mae"), rounded("r2").alias("r2"))


@plan("A33_micro_curves", f"""
WITH {OVR_SQL}, pooled AS (SELECT 1 AS g, y, score FROM ovr), {curve_sql('pooled', ['g'])}
SELECT {r6('score', 9)} AS threshold, {r6('fp / n')} AS fpr, {r6('tp / p')} AS tpr, {r6('tp / (tp + fp)')} AS precision FROM cv
""")
def a33(spark, sf):
    roc, pr = M.micro_curves(inputs.multi_rows(spark, sf))
    j = roc.join(pr, "threshold")
    return j.select(rounded("threshold", 9).alias("threshold"), *[rounded(c).alias(c) for c in ("fpr", "tpr", "precision")])


@plan("A34_expect", f"""
WITH {inputs.CONFIG_SQL} SELECT 'five seeds' AS "check", count(*) AS n_rows, count(*) FILTER (WHERE NOT coalesce(n = 5, false)) AS n_violations FROM configs
UNION ALL SELECT 'test above cv', count(*), count(*) FILTER (WHERE NOT coalesce(test > cv, false)) FROM configs
UNION ALL SELECT 'interval holds point', count(*), count(*) FILTER (WHERE NOT coalesce(ci_lo <= point AND point <= ci_hi, false)) FROM configs
""")
def a34(spark, sf):
    return M.expect(inputs.configs(spark, sf), {"five seeds": "n = 5", "test above cv": "test > cv", "interval holds point": "ci_lo <= point AND point <= ci_hi"})
