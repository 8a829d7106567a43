"""Feature joins, lookups with checks, arm pairing and table comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from corvane.operators.ordered import prefix_sums


def join_features(left: DataFrame, *others: DataFrame | None, key: str, assert_unique: bool = False) -> DataFrame:
    """Inner joins on ``key``. A side given as None is skipped; a column already present is taken from the left.

    A key that is not unique multiplies rows, as an inner merge does;
    ``assert_unique`` fails instead.
    """

    def add(a: DataFrame, b: DataFrame) -> DataFrame:
        if assert_unique and b.groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError(f"{key} is not unique in a joined table")
        return a.join(b.drop(*[c for c in b.columns if c in a.columns and c != key]), key)

    return reduce(add, [o for o in others if o is not None], left)


def rows_in_split(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def lookup(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Left join; unmatched rows keep nulls."""
    return df.join(dim, key, "left")


def missing_keys(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct().join(dim.select(key), key, "left_anti")


def require_match(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Inner join that fails when a key has no match, naming a few of them."""
    gone = [r[0] for r in missing_keys(df, dim, key).limit(5).collect()]
    if gone:
        raise ValueError(f"keys without a match, for example {gone}")
    return df.join(dim, key)


def attach_vectors(df: DataFrame, vecs: DataFrame, key: str) -> DataFrame:
    return df.join(vecs, key)


def dropped_without_vector(df: DataFrame, vecs: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Rows kept and dropped per split."""
    flagged = df.join(vecs.select(key, F.lit(1).alias("_has")), key, "left")
    return flagged.groupBy(*by).agg(F.count("_has").alias("n_kept"), F.count_if(F.col("_has").isNull()).alias("n_dropped"))


def zip_columns(left: DataFrame, right: DataFrame, row_id: str) -> DataFrame:
    """Columns side by side by an explicit row id, never by position."""
    return left.join(right, row_id)


def pair_arms(pred: DataFrame, arm: str, a, b, keys: list[str], y: str = "y", values: tuple[str, ...] = ("pred",),
              check: bool = True) -> DataFrame:
    """Predictions of two arms on the same rows: ``<value>_a`` and ``<value>_b``.

    With ``check`` a row missing on one side, or with another label there, raises.
    """
    def side(name, tag: str) -> DataFrame:
        return pred.where(F.col(arm) == name).select(
            *keys, F.col(y).alias(f"{y}_{tag}"), *[F.col(v).alias(f"{v}_{tag}") for v in values])

    both = side(a, "a").join(side(b, "b"), keys, "full_outer" if check else "inner")
    if check:
        wrong = ~F.col(f"{y}_a").eqNullSafe(F.col(f"{y}_b"))
        label = F.when(wrong, F.raise_error(F.lit("arms do not cover the same rows with the same labels"))).otherwise(F.col(f"{y}_a"))
    else:
        label = F.col(f"{y}_a")
    return both.select(*keys, label.alias(y), *[f"{v}_{t}" for v in values for t in "ab"])


def matched_configs(df: DataFrame, key: list[str], stage: str, stages: list) -> DataFrame:
    """Keys present in every stage."""
    hits = df.where(F.col(stage).isin(stages)).groupBy(*key).agg(F.count_distinct(stage).alias("_n"))
    return hits.where(F.col("_n") == len(stages)).select(*key)


def compare_tables(a: DataFrame, b: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Per column: rows in common, correlation and largest absolute difference."""
    both = a.select(key, *[F.col(c).alias(f"{c}__a") for c in cols]).join(
        b.select(key, *[F.col(c).alias(f"{c}__b") for c in cols]), key)
    aggs = [F.count("*").alias("n")]
    for c in cols:
        x, y = F.col(f"{c}__a").cast("double"), F.col(f"{c}__b").cast("double")
        aggs += [F.corr(x, y).alias(f"{c}__corr"), F.max(F.abs(x - y)).alias(f"{c}__diff")]
    rows = ", ".join(f"'{c}', n, `{c}__corr`, `{c}__diff`" for c in cols)
    return both.agg(*aggs).selectExpr(f"stack({len(cols)}, {rows}) as (column, n, corr, max_abs_diff)")


def availability(wanted: DataFrame, present: DataFrame, name: str) -> DataFrame:
    """Case-insensitive match of two name sets, one row per wanted name."""
    have = present.select(F.lower(name).alias("_k")).distinct().withColumn("_in", F.lit(True))
    return (wanted.select(name).distinct().withColumn("_k", F.lower(name)).join(have, "_k", "left")
            .select(name, F.coalesce("_in", F.lit(False)).alias("available")))


def overlap_counts(ci: DataFrame, by: list[str], lo: str = "ci_lo", hi: str = "ci_hi") -> DataFrame:
    """Per method: how many others in its group lie wholly below, wholly above, or overlap its interval.

    Counting end points by prefix sums answers the all-pairs question without forming pairs.
    """
    ends = ci.select(*by, F.col(lo).alias("_v"), F.lit(1).alias("is_lo"), F.lit(0).alias("is_hi")).unionByName(
        ci.select(*by, F.col(hi).alias("_v"), F.lit(0).alias("is_lo"), F.lit(1).alias("is_hi")))
    at = ends.groupBy(*by, "_v").agg(F.sum("is_lo").alias("n_lo"), F.sum("is_hi").alias("n_hi"))
    cum = prefix_sums(at, by, "_v", {"c_lo": F.col("n_lo"), "c_hi": F.col("n_hi")}, {"_n": "c_lo"})
    below = cum.select(*by, F.col("_v").alias(lo), (F.col("c_hi") - F.col("n_hi")).alias("n_below"), "_n")
    not_above = cum.select(*by, F.col("_v").alias(hi), F.col("c_lo").alias("_le"))
    out = ci.join(below, [*by, lo]).join(not_above, [*by, hi])
    above = F.col("_n") - F.col("_le")
    return out.select(*ci.columns, "n_below", above.alias("n_above"),
                      (F.col("_n") - 1 - F.col("n_below") - above).alias("n_overlap"))


def overlap_pairs(ci: DataFrame, pairs: DataFrame, by: list[str], name: str = "method") -> DataFrame:
    """CI overlap and +-1 SE overlap for the listed pairs ``(by..., a, b)``."""
    def side(tag: str) -> DataFrame:
        return ci.select(*by, F.col(name).alias(tag), *[F.col(c).alias(f"{c}_{tag}") for c in ("point", "se", "ci_lo", "ci_hi")])

    j = pairs.join(side("a"), [*by, "a"]).join(side("b"), [*by, "b"])
    ci_apart = (F.col("ci_hi_a") < F.col("ci_lo_b")) | (F.col("ci_hi_b") < F.col("ci_lo_a"))
    se_apart = ((F.col("point_a") + F.col("se_a") < F.col("point_b") - F.col("se_b"))
                | (F.col("point_b") + F.col("se_b") < F.col("point_a") - F.col("se_a")))
    return j.select(*by, "a", "b", (~ci_apart).alias("ci_overlap"), (~se_apart).alias("se_overlap"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def intersect_keys(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return a.select(*key).intersect(b.select(*key))
