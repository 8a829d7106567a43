"""Scores of prediction tables as DataFrame aggregates.

Ranking metrics first add up equal scores, then need only prefix counts over
distinct scores (see ``ordered``), so neither a hot score nor a hot group lands
in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions.numeric import log_softmax
from corvane.operators.ordered import average_ranks, exact_quantiles, prefix_sums, with_bucket, with_next  # noqa: F401
from corvane.session import cut_lineage, join_small


# ---- classification ---------------------------------------------------------------


def confusion(pred: DataFrame, by: list[str], y: str = "y", p: str = "pred", weight: str | None = None) -> DataFrame:
    """Counts of every (true, predicted) pair."""
    n = F.sum(weight) if weight else F.count("*")
    return pred.groupBy(*by, F.col(y).alias("y"), F.col(p).alias("pred")).agg(n.alias("n"))


def class_metrics_from(conf: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy, macro precision/recall/F1 (0 where undefined), micro F1 and multiclass MCC from confusion counts.

    The classes averaged over are those that occur as truth or as prediction.
    """
    side = conf.select(*by, F.inline(F.array(
        F.struct(F.col("y").alias("c"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("p"),
                 F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("pred").alias("c"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("tp")),
    )))
    per = side.groupBy(*by, "c").agg(*[F.sum(x).cast("double").alias(x) for x in ("t", "p", "tp")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, t, p = F.col("tp"), F.col("t"), F.col("p")
    agg = per.groupBy(*by).agg(
        F.sum("tp").alias("c_"), F.sum("t").alias("s_"),
        F.count_if(t > 0).alias("n_classes"), F.sum(p * t).alias("pt"), F.sum(p * p).alias("pp"), F.sum(t * t).alias("tt"),
        F.avg(ratio(tp, p)).alias("precision"), F.avg(ratio(tp, t)).alias("recall"), F.avg(ratio(2 * tp, t + p)).alias("f1_macro"))
    s = F.col("s_")
    root = F.sqrt((s * s - F.col("pp")) * (s * s - F.col("tt")))
    mcc = F.when(root > 0, (F.col("c_") * s - F.col("pt")) / root).otherwise(0.0)
    acc = F.col("c_") / s
    return agg.select(*by, s.cast("bigint").alias("n"), acc.alias("accuracy"), "precision", "recall", "f1_macro",
                      acc.alias("f1_micro"), mcc.alias("mcc"), "n_classes")


def class_metrics(pred: DataFrame, by: list[str]) -> DataFrame:
    return class_metrics_from(confusion(pred, by), by).drop("n_classes")


def mcc(pred: DataFrame, by: list[str]) -> DataFrame:
    return class_metrics(pred, by).select(*by, "mcc")


def metrics_valid(pred: DataFrame, by: list[str], unknown: str = "unknown") -> DataFrame:
    """Metrics over rows with a usable prediction, plus how many rows there were and how many counted."""
    totals = pred.groupBy(*by).agg(F.count("*").alias("n_total"), F.count_if(F.col("pred") != unknown).alias("n_valid"))
    return totals.join(class_metrics(pred.where(F.col("pred") != unknown), by).drop("n"), by, "left")


# ---- ranking ----------------------------------------------------------------------


def score_counts(pred: DataFrame, by: list[str], y: str = "y", score: str = "score", weight: str | None = None) -> DataFrame:
    """Positives and negatives per distinct score."""
    w = F.col(weight) if weight else F.lit(1)
    return pred.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(y) == 1, w).otherwise(0)).alias("n_pos"), F.sum(F.when(F.col(y) == 1, 0).otherwise(w)).alias("n_neg"))


def auc_from(counts: DataFrame, by: list[str]) -> DataFrame:
    """Tie-aware area under the ROC curve; null when a class is missing."""
    cum = prefix_sums(counts, by, "score", {"c_neg": F.col("n_neg")})
    below = F.col("c_neg") - F.col("n_neg") / 2.0
    out = cum.groupBy(*by).agg(F.sum(F.col("n_pos") * below).alias("_u"),
                               F.sum("n_pos").cast("double").alias("_p"), F.sum("n_neg").cast("double").alias("_n"))
    return out.select(*by, F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_u") / (F.col("_p") * F.col("_n"))).alias("auc"))


def auc(pred: DataFrame, by: list[str]) -> DataFrame:
    return auc_from(score_counts(pred, by), by)


def one_vs_rest(pred: DataFrame, keep: list[str]) -> DataFrame:
    """One row per class: ``y`` says whether the row is of that class, ``score`` is that class's probability."""
    long = pred.select(*keep, F.col("y").alias("_y"), F.posexplode("proba").alias("cls", "score"))
    return long.select(*keep, "cls", (F.col("_y") == F.col("cls")).cast("int").alias("y"), "score")


def auc_ovr(pred: DataFrame, by: list[str]) -> DataFrame:
    """Mean of the one-vs-rest areas; null when some class has no rows."""
    per = auc(one_vs_rest(pred, by), [*by, "cls"])
    whole = F.when(F.count("auc") == F.count("*"), F.avg("auc"))
    return (per.groupBy(*by) if by else per.groupBy()).agg(whole.alias("auc_ovr"))


def _falling(counts: DataFrame, by: list[str]) -> DataFrame:
    """Cumulative true and false positives when the threshold falls through the distinct scores, with class totals."""
    down = counts.withColumn("_down", -F.col("score"))
    cum = prefix_sums(down, by, "_down", {"tp": F.col("n_pos"), "fp": F.col("n_neg")}, {"_p": "tp", "_n": "fp"})
    return cum.drop("_down").withColumns({c: F.col(c).cast("double") for c in ("_p", "_n")})


def average_precision(pred: DataFrame, by: list[str]) -> DataFrame:
    """Sum over falling thresholds of recall gained times precision there."""
    counts = score_counts(pred, by)
    curve = _falling(counts, by)
    out = curve.groupBy(*by).agg(F.sum(F.col("n_pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("_s"),
                                 F.sum("n_pos").cast("double").alias("_p"))
    return out.select(*by, F.when(F.col("_p") > 0, F.col("_s") / F.col("_p")).alias("ap"))


def roc_points(pred: DataFrame, by: list[str]) -> DataFrame:
    counts = score_counts(pred, by)
    return _falling(counts, by).select(
        *by, F.col("score").alias("threshold"), (F.col("fp") / F.col("_n")).alias("fpr"), (F.col("tp") / F.col("_p")).alias("tpr"))


def pr_points(pred: DataFrame, by: list[str]) -> DataFrame:
    """Precision and recall per threshold, with the share of positives as the no-skill baseline."""
    counts = score_counts(pred, by)
    return _falling(counts, by).select(
        *by, F.col("score").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp") / F.col("_p")).alias("recall"), (F.col("_p") / (F.col("_p") + F.col("_n"))).alias("baseline"))


def micro_curves(pred: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ROC and PR points of all one-vs-rest rows pooled into one curve."""
    pooled = one_vs_rest(pred, [])
    return roc_points(pooled, []), pr_points(pooled, [])


def macro_roc(pred: DataFrame, grid: int = 200) -> DataFrame:
    """Mean over classes of TPR interpolated on ``grid`` evenly spaced FPR values.

    A curve point covers the grid values up to the next point, so each one emits
    its own grid values; the grid never joins the curve.
    """
    rows = one_vs_rest(pred, [])
    points = roc_points(rows, ["cls"]).select("cls", "fpr", "tpr")
    start = rows.select("cls").distinct().select("cls", F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    steps = points.unionByName(start).groupBy("cls", "fpr").agg(F.min("tpr").alias("lo"), F.max("tpr").alias("hi"))
    steps = cut_lineage(steps)  # read for bucket bounds, bucket heads and segments
    cut = with_bucket(steps, "fpr").withColumn("_pt", F.struct("fpr", "lo"))
    nxt = with_next(cut, ["cls"], "_bucket", ["fpr"], "_pt", "nxt")
    last = float(grid - 1)
    end = F.coalesce(F.col("nxt.fpr"), F.lit(2.0))
    ids = F.filter(F.sequence(F.floor(F.col("fpr") * last), F.least(F.ceil(end * last), F.lit(int(last)).cast("bigint"))),
                   lambda i: (i / last >= F.col("fpr")) & (i / last < end))
    on = nxt.withColumn("i", F.explode(ids)).withColumn("x", F.col("i") / last)
    slope = (F.col("nxt.lo") - F.col("hi")) / (F.col("nxt.fpr") - F.col("fpr"))
    tpr = F.col("hi") + F.coalesce(slope * (F.col("x") - F.col("fpr")), F.lit(0.0))
    return on.withColumn("tpr_at", tpr).groupBy("i").agg(F.first("x").alias("fpr"), F.avg("tpr_at").alias("tpr"))


# ---- regression and correlation -------------------------------------------------------


def reg_metrics(pred: DataFrame, by: list[str], scale: str = "raw") -> DataFrame:
    """RMSE, MAE and R2, on the given or the log1p scale."""
    y, p = (F.col("y"), F.col("pred")) if scale == "raw" else (F.log1p("y"), F.log1p("pred"))
    agg = pred.groupBy(*by).agg(F.avg((y - p) * (y - p)).alias("_mse"), F.avg(F.abs(y - p)).alias("mae"), F.var_pop(y).alias("_var"))
    return agg.select(*by, F.sqrt("_mse").alias("rmse"), "mae",
                      F.when(F.col("_var") > 0, 1.0 - F.col("_mse") / F.col("_var")).alias("r2"))


def spearman(df: DataFrame, a: str, b: str, by: list[str], weight: str | None = None) -> DataFrame:
    """Rank correlation with average ranks. Equal (a, b) pairs are added up before anything is ranked or joined."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b")).agg(
        (F.sum(weight) if weight else F.count("*")).alias("_w"))
    pairs = cut_lineage(pairs)  # read by both rankings and by the final join: written once, not derived seven times
    ra = average_ranks(pairs, by, "_a", name="_ra")
    rb = average_ranks(pairs, by, "_b", name="_rb")
    j = pairs.join(ra, [*by, "_a"]).join(rb, [*by, "_b"])
    w, x, z = F.col("_w"), F.col("_ra"), F.col("_rb")
    # the mean rank is (n + 1) / 2, so sums of squares can be centred after one pass
    m = j.groupBy(*by).agg(F.sum(w).cast("double").alias("_n"), F.sum(w * x * x).alias("_xx"), F.sum(w * z * z).alias("_zz"), F.sum(w * x * z).alias("_xz"))
    mid = (F.col("_n") + 1) / 2.0
    centre = F.col("_n") * mid * mid
    root = F.sqrt((F.col("_xx") - centre) * (F.col("_zz") - centre))
    return m.select(*by, F.when(root > 0, (F.col("_xz") - centre) / root).alias("rho"))


def metric_agreement(df: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """Spearman between every two metric columns, per group and over all rows."""
    both = df.withColumn(group, F.explode(F.array(F.col(group), F.lit("ALL"))))
    out = []
    for i, a in enumerate(metrics):
        for b in metrics[i + 1:]:
            out.append(spearman(both, a, b, [group]).select(group, F.lit(a).alias("a"), F.lit(b).alias("b"), "rho"))
    return reduce(DataFrame.unionByName, out)


# ---- losses ---------------------------------------------------------------------------


def _log_p(logits: str, y: str) -> Column:
    return F.element_at(log_softmax(F.col(logits)), F.col(y) + 1)


def focal_loss(df: DataFrame, by: list[str], gamma: float = 2.0, alpha: list[float] | None = None) -> DataFrame:
    lp = _log_p("logits", "y")
    a = F.element_at(F.array(*[F.lit(float(x)) for x in alpha]), F.col("y") + 1) if alpha else F.lit(1.0)
    return df.groupBy(*by).agg(F.avg(-a * F.pow(1.0 - F.exp(lp), F.lit(gamma)) * lp).alias("focal"))


def weighted_ce(df: DataFrame, weights: DataFrame, by: list[str]) -> DataFrame:
    """Weighted mean of the cross-entropy; ``weights(y, weight)`` has one row per class."""
    j = join_small(df, weights, ["y"])
    return j.groupBy(*by).agg((F.sum(-F.col("weight") * _log_p("logits", "y")) / F.sum("weight")).alias("weighted_ce"))


def huber_and_mse(df: DataFrame, by: list[str], delta: float = 1.0) -> DataFrame:
    e = F.abs(F.col("y") - F.col("pred"))
    h = F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta))
    return df.groupBy(*by).agg(F.avg(h).alias("huber"), F.avg(e * e).alias("mse"))


def expect(df: DataFrame, checks: dict[str, str]) -> DataFrame:
    """One row per named condition: rows checked and rows violating it (null counts as a violation), in one pass."""
    aggs = [F.count("*").alias("_n")] + [F.count_if(~F.coalesce(F.expr(c), F.lit(False))).alias(f"v{i}") for i, c in enumerate(checks.values())]
    rows = ", ".join(f"'{name}', _n, v{i}" for i, name in enumerate(checks))
    return df.agg(*aggs).selectExpr(f"stack({len(checks)}, {rows}) as (check, n_rows, n_violations)")
