"""Queries for comparing configurations, ranks, gains and ordered event logic."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import vectors as V
from corvane.functions.numeric import rounded
from corvane.operators import comparison as X, ordered as O
from corvane.plans import inputs
from corvane.plans.inputs import BINARY_SQL, CELL_SQL, CONFIG_SQL
from corvane.plans.ingest import LOG_SQL, log_lines
from corvane.plans.metrics import show
from corvane.plans.registry import plan, r6, table
from corvane.plans.resampling import GAIN_SQL, ROWS, draw_sql, gains
from corvane.sources.logs import parse_log

CFG = ["dataset", "emb", "tree"]


@plan("A18_seed_summary", f"WITH {CELL_SQL} SELECT dataset, emb, tree, {r6('avg(test)')} AS mean, {r6('stddev_samp(test)')} AS sd, count(test) AS n FROM cells GROUP BY ALL")
def a18(spark, sf):
    return show(X.seed_summary(inputs.cells(spark, sf), CFG, "test"), CFG, ["n"])


@plan("A19_complete_groups", """
WITH c AS (SELECT o_custkey, o_orderstatus, count(DISTINCT o_orderkey % 5) AS n FROM orders GROUP BY 1, 2)
SELECT o_custkey FROM c GROUP BY 1 HAVING min(n) = 5 AND count(*) = (SELECT count(DISTINCT o_orderstatus) FROM orders)
UNION ALL SELECT -1 - o_orderpriority[1:1]::bigint FROM (SELECT o_orderpriority, count(DISTINCT o_orderkey % 5) AS n, o_orderstatus FROM orders GROUP BY 1, 3) GROUP BY 1 HAVING min(n) = 5 AND count(*) = (SELECT count(DISTINCT o_orderstatus) FROM orders)
""")
def a19(spark, sf):
    o = table(spark, sf, "orders")
    n_status = o.select(F.count_distinct("o_orderstatus")).scalar()

    def complete(group):
        s = o.groupBy(group, "o_orderstatus").agg(F.count_distinct(F.col("o_orderkey") % 5).alias("n"))
        expected = o.select(group).distinct().withColumn("n_expected", n_status)
        return X.complete_groups(s, group, expected)

    by_priority = complete("o_orderpriority").select((F.lit(-1) - F.substring("o_orderpriority", 1, 1).cast("bigint")).alias("o_custkey"))
    return complete("o_custkey").unionByName(by_priority)


@plan("A20_config_distribution", f"""
WITH {CELL_SQL} SELECT dataset, emb, count(*) AS n, {r6('min(test)')} AS min, {r6('quantile_cont(test, 0.25)')} AS q25, {r6('quantile_cont(test, 0.5)')} AS median,
 {r6('avg(test)')} AS mean, {r6('max(test)')} AS max, {r6('max(test) - quantile_cont(test, 0.5)')} AS best_minus_median FROM cells WHERE test IS NOT NULL GROUP BY 1, 2
""")
def a20(spark, sf):
    return show(X.config_distribution(inputs.cells(spark, sf), ["dataset", "emb"], "test"), ["dataset", "emb"], ["n"])


@plan("A22_best_per_metric", f"""
WITH {CONFIG_SQL} SELECT dataset, {r6('max(test)')} AS test_best, arg_max(method, test) AS test_config, {r6('max(cv)')} AS cv_best, arg_max(method, cv) AS cv_config FROM configs GROUP BY 1
""")
def a22(spark, sf):
    b = X.best_per_metric(inputs.configs(spark, sf), ["dataset"], "method", ["test", "cv"])
    return show(b, ["dataset"], ["test_config", "cv_config"])


@plan("A23_summary_counts", "SELECT lang, count(*) AS n_records, count(DISTINCT source) AS n_source, count(DISTINCT n_chars) AS n_n_chars FROM documents GROUP BY 1")
def a23(spark, sf):
    return X.summary_counts(table(spark, sf, "documents"), ["lang"], ["source", "n_chars"])


@plan("A24_row_gain", f"WITH {GAIN_SQL} SELECT row_id, {r6('a')} AS a, {r6('b')} AS b, {r6('gain')} AS gain FROM gain")
def a24(spark, sf):
    return show(X.row_gain(inputs.binary_rows(spark, sf), "model", 2, 1, "row_id", "seed"), ["row_id"])


@plan("A25_gain_by_bin", f"""
WITH {GAIN_SQL}, e AS (SELECT quantile_cont(coverage::double, 1/3::double) AS q1, quantile_cont(coverage::double, 2/3::double) AS q2 FROM gc),
bn AS (SELECT gc.*, (coverage >= q1)::int + (coverage >= q2)::int AS bin FROM gc, e),
{draw_sql('bn', 0, 'bin::varchar')}, p AS (SELECT bin, draw, avg(gain) AS m FROM dw JOIN bn USING (row_id) GROUP BY 1, 2),
ci AS (SELECT bin, quantile_cont(m, 0.025) AS ci_lo, quantile_cont(m, 0.975) AS ci_hi FROM p GROUP BY 1)
SELECT bin, count(*) AS n, min(coverage) AS lo, max(coverage) AS hi, {r6('avg(gain)')} AS mean, {r6('any_value(ci_lo)')} AS ci_lo, {r6('any_value(ci_hi)')} AS ci_hi FROM bn JOIN ci USING (bin) GROUP BY bin
""")
def a25(spark, sf):
    return show(X.gain_by_bin(gains(spark, sf), "coverage", "row_id", ROWS), ["bin"], ["n", "lo", "hi"])


@plan("A26_flip_counts", f"""
WITH {GAIN_SQL} SELECT count(*) FILTER (WHERE a > 0.5 AND b < 0.5) AS corrected, count(*) FILTER (WHERE a < 0.5 AND b > 0.5) AS broken,
 count(*) FILTER (WHERE a < 0.5 AND b < 0.5) AS both_wrong, count(*) FILTER (WHERE a > 0.5 AND b > 0.5) AS both_right, {r6('corr(1 - a, 1 - b)')} AS error_corr FROM gain
""")
def a26(spark, sf):
    return show(X.flip_counts(X.row_gain(inputs.binary_rows(spark, sf), "model", 2, 1, "row_id", "seed")), [], ["corrected", "broken", "both_wrong", "both_right"])


@plan("A26_flip_counts_regression", f"""
WITH {inputs.REG_SQL}, p AS (SELECT row_id, s AS seed, y, pred + (s - 42) * 900.0::double AS pb, pred * 0.9::double + y * 0.1::double + (row_id % 7 - 3) * 2500.0::double AS pa FROM reg_rows, (SELECT unnest([42, 43]) AS s)),
sd AS (SELECT stddev_pop(y) AS sd FROM p),
g AS (SELECT row_id, avg(abs(pb - y) / sd) - avg(abs(pa - y) / sd) AS gain, avg(pa - y) AS ra, avg(pb - y) AS rb FROM p, sd GROUP BY 1)
SELECT count(*) FILTER (WHERE gain > 0.05) AS corrected, count(*) FILTER (WHERE gain < -0.05) AS broken, count(*) FILTER (WHERE abs(gain) <= 0.05) AS unchanged, {r6('corr(ra, rb)')} AS error_corr FROM g
""")
def a26_regression(spark, sf):
    rows = inputs.regression_rows(spark, sf).select("row_id", "y", "pred", F.explode(F.array(F.lit(42), F.lit(43))).alias("seed"))
    b = rows.select("row_id", "seed", "y", F.lit("b").alias("arm"), (F.col("pred") + (F.col("seed") - 42) * 900.0).alias("pred"))
    a = rows.select("row_id", "seed", "y", F.lit("a").alias("arm"), (F.col("pred") * 0.9 + F.col("y") * 0.1 + (F.col("row_id") % 7 - 3) * 2500.0).alias("pred"))
    gains_of = X.row_gain(a.unionByName(b), "arm", "a", "b", "row_id", "seed", regression=True)
    return show(X.regression_flips(gains_of), [], ["corrected", "broken", "unchanged"])


@plan("A28_drift", f"""
WITH p AS (SELECT vec_id, label, embedding::double[] AS b, list_transform(embedding::double[], lambda x, i: x + ((vec_id * 7 + i * 13) % 11) / 100.0::double) AS a FROM embeddings),
c AS (SELECT label, list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) AS cos FROM p)
SELECT label, {r6('quantile_cont(cos, 0.5)')} AS median, {r6('quantile_cont(cos, 0.05)')} AS p5 FROM c GROUP BY 1
""")
def a28(spark, sf):
    e = table(spark, sf, "embeddings")
    # a re-embedding of every row, off by a small amount per entry
    again = e.withColumn("embedding", F.transform(
        V.as_doubles("embedding"), lambda x, i: x + ((F.col("vec_id") * 7 + (i + 1) * 13) % 11) / 100.0))
    return show(X.drift(again, e, "vec_id", "embedding", ["label"]), ["label"])


@plan("A29_factor_variance", f"""
WITH {CELL_SQL}, a AS (SELECT dataset, emb, avg(test) AS m FROM cells GROUP BY 1, 2), b AS (SELECT dataset, seed, avg(test) AS m FROM cells GROUP BY 1, 2)
SELECT dataset, 'emb' AS factor, {r6('stddev_samp(m)')} AS sd_of_means, {r6('max(m) - min(m)')} AS range FROM a GROUP BY 1
UNION ALL SELECT dataset, 'seed', {r6('stddev_samp(m)')}, {r6('max(m) - min(m)')} FROM b GROUP BY 1
""")
def a29(spark, sf):
    return show(X.factor_variance(inputs.cells(spark, sf), ["dataset"], ["emb", "seed"], "test"), ["dataset", "factor"])


@plan("A30_runtime_summary", f"""
SELECT event_type, count(value) AS n, {r6('max(value)')} AS max, {r6('quantile_cont(value, 0.25)')} AS q25, {r6('quantile_cont(value, 0.5)')} AS median,
 {r6('quantile_cont(value, 0.75)')} AS q75, {r6('quantile_cont(value, 0.75) - quantile_cont(value, 0.25)')} AS iqr FROM events GROUP BY 1
""")
def a30(spark, sf):
    return show(X.runtime_summary(table(spark, sf, "events"), "event_type", "value"), ["event_type"], ["n"])


RANK_SQL = f"""{CELL_SQL}, per AS (SELECT dataset, emb, 'max' AS convention, max(test) AS value FROM cells GROUP BY 1, 2
  UNION ALL SELECT dataset, emb, 'median', quantile_cont(test, 0.5) FROM cells GROUP BY 1, 2),
ranks AS (SELECT *, rank() OVER (PARTITION BY dataset, convention ORDER BY value DESC) AS rank FROM per)"""


@plan("W1_rank_methods", f"WITH {RANK_SQL} SELECT emb, convention, {r6('avg(rank)')} AS mean_rank, count(*) FILTER (WHERE rank <= 3) AS top3 FROM ranks GROUP BY 1, 2")
def w1(spark, sf):
    ranks = X.rank_methods(inputs.cells(spark, sf), "dataset", "emb", "test")
    return show(X.mean_ranks(ranks, "emb"), ["emb", "convention"], ["top3"])


@plan("W2_topk_per_group", """
SELECT event_type, rank, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 5
""")
def w2(spark, sf):
    top = X.topk_per_group(table(spark, sf, "events"), ["event_type"], [F.desc("value"), F.col("event_id")], 5)
    return top.select("event_type", F.col("rank").cast("bigint").alias("rank"), "event_id", "value")


@plan("W3_select_configs", f"""
WITH {CONFIG_SQL} SELECT dataset, tree, arg_max(method, cv) AS selected, {r6('arg_max(test, cv)')} AS selected_test, arg_max(method, test) AS oracle, {r6('max(test)')} AS oracle_test,
 {r6('max(test) - arg_max(test, cv)')} AS optimism FROM configs GROUP BY 1, 2
""")
def w3(spark, sf):
    return show(X.select_configs(inputs.configs(spark, sf), ["dataset", "tree"]), ["dataset", "tree"], ["selected", "oracle"])


@plan("W4_runner_up", f"""
WITH {CONFIG_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY test DESC, method) AS rn FROM configs)
SELECT a.dataset, a.method AS best, {r6('a.test')} AS best_value, b.method AS second, {r6('b.test')} AS second_value, {r6('a.test - b.test')} AS gap FROM r a JOIN r b ON a.dataset = b.dataset AND a.rn = 1 AND b.rn = 2
""")
def w4(spark, sf):
    return show(X.runner_up(inputs.configs(spark, sf), ["dataset"]), ["dataset"], ["best", "second"])


@plan("W5_best_mean_se", f"""
WITH {CONFIG_SQL}, s AS (SELECT *, CASE WHEN dataset < '3' THEN test ELSE cv END AS score, CASE WHEN dataset < '3' THEN 'test' ELSE 'cv' END AS m FROM configs)
SELECT dataset, arg_max(method, score) AS config, any_value(m) AS metric, {r6('max(score)')} AS value, {r6('arg_max(se, score)')} AS se FROM s GROUP BY 1
""")
def w5(spark, sf):
    c = inputs.configs(spark, sf).withColumn("task", F.when(F.col("dataset") < "3", "classification").otherwise("regression"))
    b = X.best_mean_se(c, ["dataset"], "task", {"classification": "test", "regression": "cv"}, "method", "se")
    return show(b, ["dataset"], ["config", "metric"])


@plan("W6_staircase", f"""
WITH RECURSIVE {CELL_SQL}, s AS (SELECT dataset, emb AS stage, avg(test) AS value FROM cells GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY stage) AS pos FROM s WHERE value IS NOT NULL),
f AS (SELECT dataset, stage, value, pos, true AS kept, value AS best FROM o WHERE pos = 1
  UNION ALL SELECT o.dataset, o.stage, o.value, o.pos, o.value > f.best + 0.005::double, CASE WHEN o.value > f.best + 0.005::double THEN o.value ELSE f.best END
  FROM f JOIN o ON o.dataset = f.dataset AND o.pos = f.pos + 1)
SELECT dataset, stage, {r6('value')} AS value, kept FROM f
""")
def w6(spark, sf):
    s = inputs.cells(spark, sf).groupBy("dataset", F.col("emb").alias("stage")).agg(F.avg("test").alias("value"))
    return show(X.staircase(s, ["dataset"], "stage", "value"), ["dataset", "stage"], ["kept"])


@plan("W7_sweep_best", f"""
WITH {CELL_SQL}, r AS (SELECT dataset, emb, tree, max(test) AS v, arg_max(seed, test) AS e FROM cells GROUP BY 1, 2, 3)
SELECT dataset, arg_max(emb, v) AS emb, arg_max(tree, v) AS tree, arg_max(e, v) AS seed, {r6('max(v)')} AS test FROM r GROUP BY 1
""")
def w7(spark, sf):
    return show(X.sweep_best(inputs.cells(spark, sf), ["emb", "tree"], "seed", "test", ["dataset"]), ["dataset"], ["emb", "tree", "seed"])


@plan("W8_new_best", """
SELECT event_type, event_id, value FROM (SELECT *, max(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM events)
WHERE prior IS NULL OR value > prior
""")
def w8(spark, sf):
    e = O.time_bucket(table(spark, sf, "events"), "ts")
    return X.new_best(e, ["event_type"], "_bucket", ["ts", "event_id"], "value").select("event_type", "event_id", "value")


@plan("W9_block_durations", f"""
WITH {LOG_SQL}, s AS (SELECT * FROM log WHERE ts IS NOT NULL), e AS (SELECT log, max(ts) AS en FROM s GROUP BY 1),
m AS (SELECT *, lead(ts) OVER (PARTITION BY log ORDER BY ts, line_no) AS nx FROM s WHERE is_marker)
SELECT m.log, line_no, dataset, ts, {r6('(epoch_us(coalesce(nx, en)) - epoch_us(ts)) / 1e6::double')} AS seconds FROM m JOIN e USING (log)
""")
def w9(spark, sf):
    log = parse_log(log_lines(spark, sf), "Block start", "dataset").drop("line")
    return show(X.block_durations(log, ["log"], "ts", "line_no", "dataset"), ["log", "line_no", "dataset", "ts"])


@plan("W10_carry_forward", """
SELECT user_id, event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM events
""")
def w10(spark, sf):
    e = O.time_bucket(table(spark, sf, "events"), "ts").withColumn("mark", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return O.carry_forward(e, ["user_id"], "_bucket", ["ts", "event_id"], {"mark": "section"}).select("user_id", "event_id", "section")


@plan("W11_digitize", """
WITH q AS (SELECT quantile_cont(o_totalprice, 0.2) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.8) AS c FROM orders)
SELECT o_orderkey, (o_totalprice >= a)::int + (o_totalprice >= b)::int + (o_totalprice >= c)::int AS bin FROM orders, q
""")
def w11(spark, sf):
    return X.digitize(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", [0.2, 0.5, 0.8]).drop("o_totalprice")


@plan("W12_sort", f"WITH {CONFIG_SQL} SELECT dataset, method, {r6('test')} AS test FROM configs ORDER BY dataset, test DESC, method")
def w12(spark, sf):
    return show(inputs.configs(spark, sf).select("dataset", "method", "test"), ["dataset", "method"]).orderBy("dataset", F.desc("test"), "method")


TOP_SQL = f"""{CONFIG_SQL}, b AS (SELECT dataset, method, test, row_number() OVER (PARTITION BY dataset ORDER BY test DESC, method) AS original_rank, length(method) % 3 <> 0 AS available FROM configs WHERE test IS NOT NULL),
top AS (SELECT * FROM (SELECT dataset, method, test, original_rank, row_number() OVER (PARTITION BY dataset ORDER BY original_rank) AS rank FROM b WHERE available) WHERE rank <= 5)"""


def top5(spark, sf):
    c = inputs.configs(spark, sf).withColumn("available", F.length("method") % 3 != 0)
    t = X.top_available(c, ["dataset"], "method", "test", "available")
    return t.select("dataset", "method", rounded("test").alias("test"), F.col("original_rank").cast("bigint").alias("original_rank"), F.col("rank").cast("bigint").alias("rank"))


@plan("W13_top5_available", f"WITH {TOP_SQL} SELECT dataset, method, {r6('test')} AS test, original_rank, rank FROM top")
def w13(spark, sf):
    return top5(spark, sf)


@plan("W14_rank_of", f"WITH {TOP_SQL} SELECT dataset, method, {r6('test')} AS test, original_rank, rank FROM top WHERE method = (SELECT min(method) FROM top)")
def w14(spark, sf):
    t = top5(spark, sf)
    # the method asked for: the first name on the published lists
    name = t.select(F.min("method")).scalar()
    return t.withColumn("_want", name).where("method = _want").drop("_want")


PAIR_SQL = f"""{CONFIG_SQL}, pr AS (SELECT a.dataset, a.tree AS variant, a.point - b.point AS obs, a.point - b.point - sqrt(a.se ** 2 + b.se ** 2) AS ci_lo, a.point - b.point + sqrt(a.se ** 2 + b.se ** 2) AS ci_hi
  FROM configs a JOIN configs b USING (dataset, emb) WHERE a.tree <> 'O' AND b.tree = 'O')"""


@plan("W15_win_counts", f"WITH {PAIR_SQL} SELECT variant, count(*) AS n, count(*) FILTER (WHERE obs > 0) AS point_better, count(*) FILTER (WHERE ci_lo > 0) AS ci_better, count(*) FILTER (WHERE ci_hi < 0) AS ci_worse FROM pr GROUP BY 1")
def w15(spark, sf):
    c = inputs.configs(spark, sf)
    base = c.where("tree = 'O'").select("dataset", "emb", F.col("point").alias("p0"), F.col("se").alias("s0"))
    se = F.sqrt(F.col("se") * F.col("se") + F.col("s0") * F.col("s0"))
    d = c.where("tree <> 'O'").join(base, ["dataset", "emb"]).withColumn("obs", F.col("point") - F.col("p0"))
    return X.win_counts(d.select(F.col("tree").alias("variant"), "obs", (F.col("obs") - se).alias("ci_lo"), (F.col("obs") + se).alias("ci_hi")), ["variant"])


@plan("W16_delta_vs_base", f"""
WITH {CELL_SQL}, d AS (SELECT a.tree, a.test - b.test AS delta FROM cells a JOIN cells b USING (dataset, emb, seed) WHERE a.tree <> 'O' AND b.tree = 'O')
SELECT tree, {r6('avg(delta)')} AS mean_delta, count(*) FILTER (WHERE abs(delta) > 0.02) AS n_shifts, {r6('avg((abs(delta) > 0.02)::int)')} AS share_shifts, count(delta) AS n FROM d GROUP BY 1
""")
def w16(spark, sf):
    d = X.delta_vs_base(inputs.cells(spark, sf).drop("cv", "n"), ["dataset", "emb", "seed"], "tree", "O", "test")
    return show(X.delta_summary(d, ["tree"], 0.02), ["tree"], ["n_shifts", "n"])


@plan("W17_comparison_matrix", f"""
WITH {CELL_SQL}, w AS (SELECT dataset, emb, avg(test) FILTER (WHERE tree = 'F') AS f, avg(test) FILTER (WHERE tree = 'O') AS o, avg(test) FILTER (WHERE tree = 'P') AS p FROM cells GROUP BY 1, 2)
SELECT dataset, emb, {r6('f')} AS "F", {r6('o')} AS "O", {r6('p')} AS "P", concat_ws(',', CASE WHEN f = greatest(f, o, p) THEN 'F' END, CASE WHEN o = greatest(f, o, p) THEN 'O' END, CASE WHEN p = greatest(f, o, p) THEN 'P' END) AS best_arms FROM w
""")
def w17(spark, sf):
    return show(X.comparison_matrix(inputs.cells(spark, sf), ["dataset", "emb"], "tree", ["F", "O", "P"], "test"), ["dataset", "emb"], ["best_arms"])


FEATURE_SETS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@plan("W18_best_tree_means", f"""
WITH {CELL_SQL}, m AS (SELECT dataset, emb, tree, avg(test) AS m FROM cells GROUP BY 1, 2, 3)
SELECT dataset, {', '.join(f"""{r6(f"max(m) FILTER (WHERE emb = '{e}')")} AS "{e}" """ for e in FEATURE_SETS)} FROM m GROUP BY 1
""")
def w18(spark, sf):
    return show(X.best_tree_means(inputs.cells(spark, sf), "dataset", "emb", "tree", "test", FEATURE_SETS), ["dataset"])


@plan("P22_feature_groups", f"WITH {inputs.VEC_SQL} SELECT query_id, {r6('max(sim) FILTER (WHERE rank = 1)')} AS nearest_sim, {r6('avg(sim) FILTER (WHERE rank <= 10)')} AS k10_sim_mean, {r6('stddev_pop(sim) FILTER (WHERE rank <= 10)')} AS k10_sim_std, {r6('avg(sim)')} AS k20_sim_mean, {r6('stddev_pop(sim)')} AS k20_sim_std FROM nb GROUP BY 1")
def p22(spark, sf):
    from corvane.operators import cleaning, context
    full = context.profile_and_density(inputs.neighbours(spark, sf), inputs.PROPS)
    return show(cleaning.feature_groups(full, ["query_id"], "B", context.group_map(inputs.PROPS)), ["query_id"])
