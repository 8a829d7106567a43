"""Curation operators: key rules, deduplication, coercion, imputation, outlier bounds, encodings, audits."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions.numeric import clip, finite
from corvane.operators.ordered import dense_index, exact_quantiles, scalar_columns
from corvane.session import cut_lineage, join_small


@dataclass(frozen=True)
class Roles:
    """What each column is for, by name; everything not skipped is a feature."""

    key: str | None = None
    labels: tuple[str, ...] = ()
    skip: tuple[str, ...] = ()
    prefix: str | None = None
    suffix: str | None = None
    artefacts: tuple[str, ...] = field(default=("Unnamed: 0", "_c0"))


def valid_key(df: DataFrame, col: str, rule: str = r"\S") -> DataFrame:
    """Drops rows whose key is null, blank or does not match ``rule``."""
    return df.where(F.col(col).isNotNull() & (F.trim(col) != "") & F.col(col).rlike(rule))


def normalise_key(col: str) -> Column:
    """Lower case, single spaces, no outer space; null when nothing is left."""
    key = F.trim(F.regexp_replace(F.lower(F.col(col)), r"\s+", " "))
    return F.when(key != "", key)


def dedup_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of lowest ``order`` per key.

    An aggregate, not a window: it combines on the map side, so a key that holds
    a third of all rows reaches the reducer as one row per map task.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.col(order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest]).select(*df.columns)


def dedup_key(df: DataFrame, key: str, order: str) -> DataFrame:
    return dedup_first(df, [key], order)


def label_conflicts(df: DataFrame, key: str, label: str) -> DataFrame:
    """Keys that carry more than one label."""
    per_label = df.where(F.col(label).isNotNull()).groupBy(key, label).agg(F.count("*").alias("_n"))
    return per_label.groupBy(key).agg(F.count("*").alias("n_labels"), F.sum("_n").alias("n_rows")).where("n_labels > 1")


def drop_missing(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.dropna(subset=cols)


def keep_labels(df: DataFrame, col: str, allowed: list[str]) -> DataFrame:
    return df.withColumn(col, F.lower(F.trim(col))).where(F.col(col).isin(allowed))


def role_columns(df: DataFrame, roles: Roles) -> list[str]:
    out = []
    for c in df.columns:
        if c in roles.skip or c in roles.labels or c == roles.key or c in roles.artefacts:
            continue
        if roles.prefix and not c.startswith(roles.prefix):
            continue
        if roles.suffix and not c.endswith(roles.suffix):
            continue
        out.append(c)
    return out


def select_role(df: DataFrame, roles: Roles) -> DataFrame:
    keep = [roles.key] if roles.key else []
    return df.select(*keep, *role_columns(df, roles))


def feature_groups(df: DataFrame, keep: list[str], groups: str, group_of: dict[str, str]) -> DataFrame:
    """Columns of the chosen groups: ``"AB"`` keeps A and B. ``group_of`` names each feature's group (see ``context``)."""
    return df.select(*keep, *[c for c in df.columns if c not in keep and group_of.get(c, "-") in groups])


def to_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast("double") for c in cols})


def sanitize(df: DataFrame, cols: list[str], impute: str | float = "median", by: list[str] | None = None,
             limit: float | None = 1e6, fit_on: DataFrame | None = None) -> DataFrame:
    """Non-finite to null, impute (the split's own median, or a constant), clip to +-``limit``.

    A column with no usable value is filled with 0.
    """
    by = by or []
    out = df.withColumns({c: finite(F.col(c).try_cast("double")) for c in cols})
    if impute == "median":
        source = out if fit_on is None else fit_on.withColumns({c: finite(F.col(c).try_cast("double")) for c in cols})
        # all columns at once: one (column, value) table, one quantile pass, one row per group
        pairs = ", ".join(f"'{c}', `{c}`" for c in cols)
        long = source.selectExpr(*[f"`{b}`" for b in by], f"stack({len(cols)}, {pairs}) as (_column, _value)")
        found = exact_quantiles(long, [*by, "_column"], "_value", {"_median": 0.5})
        medians = found.groupBy(*by).agg(*[F.max(F.when(F.col("_column") == c, F.col("_median"))).alias(f"_m_{c}") for c in cols])
        if by:
            out = join_small(out, medians, by, "left")
        else:  # one row
            out = scalar_columns(out, cut_lineage(medians), [f"_m_{c}" for c in cols])
        fill = {c: F.coalesce(F.col(c), F.col(f"_m_{c}"), F.lit(0.0)) for c in cols}
    else:
        fill = {c: F.coalesce(F.col(c), F.lit(float(impute))) for c in cols}
    return out.select(*[
        (clip(fill[c], -limit, limit) if limit else fill[c]).alias(c) if c in fill else F.col(c) for c in df.columns
    ])


def audit_nonfinite(df: DataFrame, cols: list[str], stage: str) -> DataFrame:
    """Long table ``(column, stage, n_null, n_nan, n_inf)`` from one pass."""
    aggs = []
    for c in cols:
        v = F.col(c)
        aggs += [F.count_if(v.isNull()).alias(f"{c}__null"), F.count_if(F.isnan(v)).alias(f"{c}__nan"),
                 F.count_if(F.abs(v) == float("inf")).alias(f"{c}__inf")]
    rows = ", ".join(f"'{c}', `{c}__null`, `{c}__nan`, `{c}__inf`" for c in cols)
    return df.agg(*aggs).selectExpr(f"stack({len(cols)}, {rows}) as (column, n_null, n_nan, n_inf)").withColumn("stage", F.lit(stage))


def iqr_bounds(df: DataFrame, by: list[str], col: str, whisker: float = 1.5) -> DataFrame:
    """Bounds from the quartiles in log1p space, back on the original scale."""
    q = exact_quantiles(df.withColumn("_log", F.log1p(col)), by, "_log", {"q1": 0.25, "q3": 0.75})
    width = (F.col("q3") - F.col("q1")) * whisker
    return q.select(*by, F.expm1(F.col("q1") - width).alias("lo"), F.expm1(F.col("q3") + width).alias("hi"))


def apply_bounds(df: DataFrame, bounds: DataFrame, by: list[str], col: str) -> DataFrame:
    return join_small(df, bounds, by).where(F.col(col).between(F.col("lo"), F.col("hi")))


def encode_labels(df: DataFrame, col: str, out: str, fit_on: DataFrame | None = None) -> DataFrame:
    """Ordinal code by sorted class of ``fit_on`` (default: the frame itself); an unseen class is null."""
    classes = (fit_on if fit_on is not None else df).select(col).dropna().distinct()
    codes = dense_index(classes, [], col, name=out).withColumn(out, F.col(out).cast("int"))
    return join_small(df, codes, [col], "left")


def one_hot(col: str, choices: list[str]) -> Column:
    """Flags per choice plus a last flag for anything else (null included)."""
    c = F.coalesce(F.col(col), F.lit(""))
    return F.array(*[(c == v).cast("int") for v in choices], (~c.isin(choices)).cast("int"))


def class_stats(df: DataFrame, label: str) -> DataFrame:
    """Count and percent per class, null class included."""
    counts = df.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n"))
    total = df.select(F.count("*")).scalar()
    return counts.withColumn("_t", total).select(
        F.lit(label).alias("label"), "class", "n", (F.col("n") * 100.0 / F.col("_t")).alias("pct"))


def value_stats(df: DataFrame, by: list[str], col: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
                               F.min(col).alias("min"), F.max(col).alias("max"))


def audit(steps: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """Rows left after each step per ``by`` and rows removed since the step before."""
    names = list(steps)
    tagged = [d.groupBy(*by).agg(F.count("*").alias("n")).withColumn("step", F.lit(i)) for i, d in enumerate(steps.values())]
    wide = reduce(DataFrame.unionByName, tagged).groupBy(*by).pivot("step", list(range(len(names)))).agg(F.first("n"))
    cols = [F.coalesce(F.col(str(i)), F.lit(0)) for i in range(len(names))]
    gone = [(cols[i - 1] - cols[i]).alias(f"removed_{names[i]}") for i in range(1, len(names))]
    return wide.select(*by, *[c.alias(f"n_{n}") for c, n in zip(cols, names)], *gone)


def class_weights(df: DataFrame, label: str, mode: str = "balanced") -> DataFrame:
    """``balanced``: n/(k n_c); ``complement``: 1 - share; ``inverse``: inverse share scaled to mean 1;
    ``neg_pos``: negatives over positives for the positive class, 1 otherwise."""
    counts = df.dropna(subset=[label]).groupBy(label).agg(F.count("*").alias("n_c"))
    total = counts.agg(F.sum("n_c").alias("n"), F.count("*").alias("k"),
                       F.sum(1.0 / F.col("n_c")).alias("inv"),
                       F.sum(F.when(F.col(label) == 0, F.col("n_c"))).alias("neg"),
                       F.sum(F.when(F.col(label) == 1, F.col("n_c"))).alias("pos"))
    t = counts
    for c in ("n", "k", "inv", "neg", "pos"):
        t = t.withColumn(f"_{c}", total.select(c).scalar())
    weight = {
        "balanced": F.col("_n") / (F.col("_k") * F.col("n_c")),
        "complement": 1.0 - F.col("n_c") / F.col("_n"),
        "inverse": (1.0 / F.col("n_c")) / F.col("_inv") * F.col("_k"),
        "neg_pos": F.when(F.col(label) == 1, F.col("_neg") / F.col("_pos")).otherwise(1.0),
    }[mode]
    return t.select(label, "n_c", weight.alias("weight"))


def filter_configs(df: DataFrame, emb: str, tree: str, skip: list[str] = (), only: list[str] = ()) -> DataFrame:
    """Rules are ``EMB`` (any tree) or ``EMB:TREE``."""

    def matches(rules) -> Column:
        hit = F.lit(False)
        for r in rules:
            e, _, t = r.partition(":")
            hit = hit | ((F.col(emb) == e) & ((F.col(tree) == t) if t else F.lit(True)))
        return hit

    keep = ~matches(skip)
    return df.where(keep & matches(only)) if only else df.where(keep)


def grid(arms: DataFrame, seeds: list[int], models: list[str]) -> DataFrame:
    """Every arm with every seed and model; the short lists ride along as literals."""
    return arms.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds]))).withColumn(
        "model", F.explode(F.array(*[F.lit(m) for m in models])))
