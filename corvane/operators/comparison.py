"""Comparing configurations: summaries, selection, ranks, matched deltas, staircases, gains.

Tables of configurations have one row per (dataset, arm, tree, ...) cell. Their
groups are as large as the experiment grid, so plain windows over a dataset are
safe here; anything over prediction or event rows goes through ``ordered``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.operators import ordered as O
from corvane.operators.joins import pair_arms
from corvane.session import cut_lineage


# ---- summaries -----------------------------------------------------------------------


def seed_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))


def complete_groups(summary: DataFrame, group: str, expected: DataFrame, seeds: int = 5) -> DataFrame:
    """Groups in which every expected cell is there with all seeds; ``expected(group, n_expected)``."""
    have = summary.groupBy(group).agg(F.min("n").alias("_min"), F.count("*").alias("_cells"))
    return have.join(expected, group).where((F.col("_min") == seeds) & (F.col("_cells") == F.col("n_expected"))).select(group)


def config_distribution(df: DataFrame, by: list[str], value: str) -> DataFrame:
    q = O.exact_quantiles(df, by, value, {"q25": 0.25, "median": 0.5})
    s = df.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    return s.join(q, by).withColumn("best_minus_median", F.col("max") - F.col("median"))


def best_per_metric(df: DataFrame, by: list[str], config: str, metrics: list[str]) -> DataFrame:
    aggs = []
    for m in metrics:
        aggs += [F.max(m).alias(f"{m}_best"), F.max_by(config, m).alias(f"{m}_config")]
    return df.groupBy(*by).agg(*aggs)


def summary_counts(df: DataFrame, by: list[str], distinct: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n_records"), *[F.count_distinct(c).alias(f"n_{c}") for c in distinct])


def factor_variance(df: DataFrame, by: list[str], factors: list[str], value: str) -> DataFrame:
    """Sample sd and range of the group means across each factor."""
    out = None
    for f in factors:
        means = df.groupBy(*by, f).agg(F.avg(value).alias("_m"))
        part = means.groupBy(*by).agg(F.stddev_samp("_m").alias("sd_of_means"), (F.max("_m") - F.min("_m")).alias("range")).withColumn("factor", F.lit(f))
        out = part if out is None else out.unionByName(part)
    return out


def runtime_summary(df: DataFrame, stage: str, seconds: str) -> DataFrame:
    q = O.exact_quantiles(df, [stage], seconds, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return df.groupBy(stage).agg(F.count(seconds).alias("n"), F.max(seconds).alias("max")).join(q, stage).withColumn("iqr", F.col("q75") - F.col("q25"))


def drift(vecs: DataFrame, base: DataFrame, row_id: str, vec: str, by: list[str]) -> DataFrame:
    """Cosine of each row to its baseline vector: median and 5th percentile."""
    from corvane.functions.vectors import as_doubles, cosine

    j = vecs.select(row_id, *by, as_doubles(vec).alias("_a")).join(base.select(row_id, as_doubles(vec).alias("_b")), row_id)
    c = j.select(*by, cosine(F.col("_a"), F.col("_b")).alias("cos"))
    return O.exact_quantiles(c, by, "cos", {"median": 0.5, "p5": 0.05})


# ---- gains of one arm over another ------------------------------------------------------


def row_gain(pred: DataFrame, arm: str, a, b, row_id: str, seed: str, regression: bool = False) -> DataFrame:
    """Per row, averaged over seeds: correctness of a and of b and the gain of a over b.

    For regression ``a`` and ``b`` are the absolute errors of the two arms in units of the target's population sd, and the gain
    is the drop from b to a; the mean signed errors in the target's own units come as ``raw_a`` and ``raw_b``.
    """
    two = pair_arms(pred, arm, a, b, [row_id, seed])
    if regression:
        sd = pred.where(F.col(arm) == a).select(F.stddev_pop("y")).scalar()
        two = two.withColumn("_sd", sd)
        error = lambda x: F.col(f"pred_{x}") - F.col("y")
        left, right = F.abs(error("a")) / F.col("_sd"), F.abs(error("b")) / F.col("_sd")
        return two.groupBy(row_id).agg(F.avg(left).alias("a"), F.avg(right).alias("b"), F.avg(right - left).alias("gain"),
                                       F.avg(error("a")).alias("raw_a"), F.avg(error("b")).alias("raw_b"))
    else:
        left, right = (F.col("pred_a") == F.col("y")).cast("double"), (F.col("pred_b") == F.col("y")).cast("double")
    return two.groupBy(row_id).agg(F.avg(left).alias("a"), F.avg(right).alias("b"), F.avg(left - right).alias("gain"))


def flip_counts(gains: DataFrame) -> DataFrame:
    """Rows a corrected, a broke, both got wrong or both right (majority over seeds), and the correlation of errors."""
    up, down = lambda c: F.col(c) > 0.5, lambda c: F.col(c) < 0.5
    return gains.agg(
        F.count_if(up("a") & down("b")).alias("corrected"), F.count_if(down("a") & up("b")).alias("broken"),
        F.count_if(down("a") & down("b")).alias("both_wrong"), F.count_if(up("a") & up("b")).alias("both_right"),
        F.corr(1 - F.col("a"), 1 - F.col("b")).alias("error_corr"))


def regression_flips(gains: DataFrame, margin: float = 0.05) -> DataFrame:
    """Rows whose absolute error a lowers or raises by more than ``margin``, the others, and the correlation of raw errors."""
    return gains.agg(
        F.count_if(F.col("gain") > margin).alias("corrected"), F.count_if(F.col("gain") < -margin).alias("broken"),
        F.count_if(F.abs("gain") <= margin).alias("unchanged"), F.corr("raw_a", "raw_b").alias("error_corr"))


def digitize(df: DataFrame, col: str, qs: list[float], out: str = "bin") -> DataFrame:
    """Bin number by exact quantiles of the column; a value on an edge belongs to the upper bin."""
    edges = O.exact_quantiles(df, [], col, {f"_q{i}": q for i, q in enumerate(qs)})
    names = [f"_q{i}" for i in range(len(qs))]
    wide = O.scalar_columns(df, edges, names)
    bins = sum(((F.col(col) >= F.col(n)).cast("int") for n in names), F.lit(0))
    return wide.withColumn(out, bins).drop(*names)


def gain_by_bin(df: DataFrame, coverage: str, row_id: str, n_draws: int = 2_000, seed: int = 0) -> DataFrame:
    """Mean gain with a bootstrap interval per coverage tercile."""
    from corvane.operators.resampling import bootstrap_mean

    binned = cut_lineage(digitize(df, coverage, [1 / 3, 2 / 3]))
    spans = binned.groupBy("bin").agg(F.min(coverage).alias("lo"), F.max(coverage).alias("hi"))
    return bootstrap_mean(binned, "gain", row_id, "bin", n_draws, seed).join(spans, "bin")


# ---- selection and ranks -----------------------------------------------------------------


def topk_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """``row_number() <= k``: Spark keeps k rows per group before the shuffle, so a hot group stays small."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def select_configs(df: DataFrame, by: list[str], config: str = "method", cv: str = "cv", test: str = "test") -> DataFrame:
    """Configuration chosen by cross-validation, the one a test-set oracle would take, and the optimism between them."""
    out = df.groupBy(*by).agg(
        F.max_by(config, cv).alias("selected"), F.max_by(test, cv).alias("selected_test"),
        F.max_by(config, test).alias("oracle"), F.max(test).alias("oracle_test"))
    return out.withColumn("optimism", F.col("oracle_test") - F.col("selected_test"))


def runner_up(df: DataFrame, by: list[str], config: str = "method", value: str = "test") -> DataFrame:
    top = topk_per_group(df.where(F.col(value).isNotNull()), by, [F.desc(value), F.col(config)], 2)
    pick = lambda c, r: F.max(F.when(F.col("rank") == r, F.col(c)))
    out = top.groupBy(*by).agg(pick(config, 1).alias("best"), pick(value, 1).alias("best_value"),
                               pick(config, 2).alias("second"), pick(value, 2).alias("second_value"))
    return out.withColumn("gap", F.col("best_value") - F.col("second_value"))


def best_mean_se(df: DataFrame, by: list[str], task: str, metric_of: dict[str, str], config: str, se: str) -> DataFrame:
    """Best configuration by the metric its task is judged on, with that metric and its se."""
    score = F.coalesce(*[F.when(F.col(task) == t, F.col(m)) for t, m in metric_of.items()])
    name = F.coalesce(*[F.when(F.col(task) == t, F.lit(m)) for t, m in metric_of.items()])
    s = df.withColumns({"_score": score, "_metric": name})
    return s.groupBy(*by).agg(F.max_by(config, "_score").alias("config"), F.first("_metric").alias("metric"),
                              F.max("_score").alias("value"), F.max_by(se, "_score").alias("se"))


def rank_methods(df: DataFrame, dataset: str, method: str, value: str) -> DataFrame:
    """Per dataset and convention (best or median over a method's configurations): rank, ties share the lowest."""
    med = O.exact_quantiles(df, [dataset, method], value, {"median": 0.5})
    per = df.groupBy(dataset, method).agg(F.max(value).alias("max")).join(med, [dataset, method])
    long = per.select(dataset, method, F.inline(F.array(
        F.struct(F.lit("max").alias("convention"), F.col("max").alias("value")),
        F.struct(F.lit("median").alias("convention"), F.col("median").alias("value")))))
    w = Window.partitionBy(dataset, "convention").orderBy(F.desc("value"))
    return long.withColumn("rank", F.rank().over(w))


def mean_ranks(ranks: DataFrame, method: str) -> DataFrame:
    return ranks.groupBy(method, "convention").agg(F.avg("rank").alias("mean_rank"), F.count_if(F.col("rank") <= 3).alias("top3"))


def staircase(df: DataFrame, by: list[str], stage: str, value: str, gain: float = 0.005) -> DataFrame:
    """Stages in rising cost; a stage is kept when it beats the last *kept* stage by more than ``gain``.

    The comparison is with the last kept value, which a running maximum would
    not give, so it is a fold over the few stages of a group.
    """
    stages = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(stage), F.col(value)))).alias("_s"))
    t = df.schema[stage].dataType.simpleString()
    start = F.expr(f"struct(cast(null as double) as best, cast(array() as array<struct<stage:{t},value:double,kept:boolean>>) as out)")

    def step(acc: Column, s: Column) -> Column:
        keep = acc["best"].isNull() | (s[value] > acc["best"] + gain)
        return F.struct(F.when(keep, s[value]).otherwise(acc["best"]).alias("best"),
                        F.array_append(acc["out"], F.struct(s[stage].alias("stage"), s[value].alias("value"), keep.alias("kept"))).alias("out"))

    return stages.select(*by, F.inline(F.aggregate("_s", start, step)["out"]))


def sweep_best(history: DataFrame, run: list[str], epoch: str, value: str, group: list[str]) -> DataFrame:
    """Best epoch of each run, then the best run of each group."""
    per_run = history.groupBy(*group, *run).agg(F.max(value).alias("_v"), F.max_by(epoch, value).alias("_e"))
    best = per_run.groupBy(*group).agg(F.max_by(F.struct(*run, "_e", "_v"), "_v").alias("_b"))
    return best.select(*group, *[F.col(f"_b.{c}").alias(c) for c in run], F.col("_b._e").alias(epoch), F.col("_b._v").alias(value))


def new_best(df: DataFrame, by: list[str], bucket: str, order: list[str], value: str) -> DataFrame:
    """Rows strictly better than everything before them in their group."""
    prior = O.with_prior_max(df, by, bucket, order, value, "_prior")
    return prior.where(F.col("_prior").isNull() | (F.col(value) > F.col("_prior"))).drop("_prior")


def block_durations(log: DataFrame, by: list[str], ts: str, order: str, label: str) -> DataFrame:
    """Seconds from each marker to the next one; the last block of a log runs to the log's last timestamp."""
    stamped = log.where(F.col(ts).isNotNull())
    marks = O.time_bucket(stamped.where("is_marker"), ts)
    nxt = O.with_next(marks, by, "_bucket", [ts, order], ts, "_next")
    ends = stamped.groupBy(*by).agg(F.max(ts).alias("_end"))
    seconds = (F.unix_micros(F.coalesce("_next", "_end").cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1e6
    return nxt.join(ends, by).select(*by, order, label, ts, seconds.alias("seconds"))


def top_available(df: DataFrame, by: list[str], method: str, value: str, available: str, k: int = 5) -> DataFrame:
    """Best entry per method, ranked; entries without an artifact step aside for the next one, original rank kept."""
    best = df.where(F.col(value).isNotNull()).groupBy(*by, method).agg(
        F.max(value).alias(value), F.max_by(available, value).alias(available))
    w = Window.partitionBy(*by).orderBy(F.desc(value), method)
    ranked = best.withColumn("original_rank", F.row_number().over(w))
    return topk_per_group(ranked.where(F.col(available)), by, [F.col("original_rank")], k).drop(available)


def rank_of(top: DataFrame, method: str, name: str) -> DataFrame:
    return top.where(F.col(method) == name)


def win_counts(paired: DataFrame, by: list[str]) -> DataFrame:
    return paired.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(F.col("obs") > 0).alias("point_better"),
        F.count_if(F.col("ci_lo") > 0).alias("ci_better"), F.count_if(F.col("ci_hi") < 0).alias("ci_worse"))


def delta_vs_base(df: DataFrame, cell: list[str], arm: str, base, value: str) -> DataFrame:
    """Value of each arm minus the base arm's value in the same cell."""
    b = df.where(F.col(arm) == base).select(*cell, F.col(value).alias("_base"))
    return df.where(F.col(arm) != base).join(b, cell).withColumn("delta", F.col(value) - F.col("_base")).drop("_base")


def delta_summary(deltas: DataFrame, by: list[str], threshold: float) -> DataFrame:
    big = F.abs(F.col("delta")) > threshold
    return deltas.groupBy(*by).agg(F.avg("delta").alias("mean_delta"), F.count_if(big).alias("n_shifts"),
                                   F.avg(big.cast("double")).alias("share_shifts"), F.count("delta").alias("n"))


def comparison_matrix(df: DataFrame, rows: list[str], arm: str, arms: list[str], value: str) -> DataFrame:
    """One column per arm plus the names of all arms that reach the row's best."""
    wide = df.groupBy(*rows).pivot(arm, arms).agg(F.avg(value))
    top = F.greatest(*[F.col(a) for a in arms])
    best = F.array_join(F.array_compact(F.array(*[F.when(F.col(a) == top, F.lit(a)) for a in arms])), ",")
    return wide.withColumn("best_arms", best)


def best_tree_means(df: DataFrame, dataset: str, features: str, tree: str, value: str, sets: list[str]) -> DataFrame:
    """Mean over seeds per tree, then the best tree, one column per feature set."""
    means = df.groupBy(dataset, features, tree).agg(F.avg(value).alias("_m"))
    return means.groupBy(dataset).pivot(features, sets).agg(F.max("_m"))
