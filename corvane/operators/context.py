"""Features of a query's neighbourhood: groups A (profile), B (density), C (centroid), D (structure).

Every input has at most ``k`` rows per query, so one hash aggregate per group
of features is enough and it combines on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions import vectors as V

GROUPS = {"A": "profile", "B": "density", "C": "centroid", "D": "structure"}


def group_map(props: list[str], ks: list[int] = [10, 20], k: int = 10, first: int = 5) -> dict[str, str]:
    """Feature name to group letter, for the names that the operators of this module give."""
    out = {f"{p}_{stat}_k{n}": "A" for p in props for stat in ("mean", "std", "wmean") for n in ks}
    out |= {"nearest_sim": "B"} | {f"k{n}_sim_{stat}": "B" for n in ks for stat in ("mean", "std")}
    out |= dict.fromkeys(("centroid", "sim_to_centroid", "centroid_spread"), "C")
    return out | dict.fromkeys(("fp_sim_k1", f"fp_sim_k{first}_mean", f"same_group_frac_k{k}"), "D")


def _within(value: Column, k: int) -> Column:
    return F.when(F.col("rank") <= k, value)


def profile_aggs(props: list[str], ks: list[int]) -> list[Column]:
    """Mean, population std and similarity-weighted mean; negative weights count as 0."""
    out = []
    for p in props:
        v = F.col(p).cast("double")
        w = F.greatest(F.col("sim"), F.lit(0.0))
        for k in ks:
            out += [
                F.avg(_within(v, k)).alias(f"{p}_mean_k{k}"),
                F.stddev_pop(_within(v, k)).alias(f"{p}_std_k{k}"),
                (F.sum(_within(v * w, k)) / (F.sum(_within(w, k)) + 1e-9)).alias(f"{p}_wmean_k{k}"),
            ]
    return out


def density_aggs(ks: list[int]) -> list[Column]:
    """Nearest similarity, mean and population std of similarity."""
    out = [F.max(_within(F.col("sim"), 1)).alias("nearest_sim")]
    for k in ks:
        out += [F.avg(_within(F.col("sim"), k)).alias(f"k{k}_sim_mean"),
                F.stddev_pop(_within(F.col("sim"), k)).alias(f"k{k}_sim_std")]
    return out


def profile(neighbours: DataFrame, props: list[str], ks: list[int] = [10, 20]) -> DataFrame:
    return neighbours.groupBy("query_id").agg(*profile_aggs(props, ks))


def density(neighbours: DataFrame, ks: list[int] = [10, 20]) -> DataFrame:
    return neighbours.groupBy("query_id").agg(*density_aggs(ks))


def profile_and_density(neighbours: DataFrame, props: list[str], ks: list[int] = [10, 20]) -> DataFrame:
    """Groups A and B in one pass over the neighbour rows."""
    return neighbours.groupBy("query_id").agg(*profile_aggs(props, ks), *density_aggs(ks))


def single_k(neighbours: DataFrame, props: list[str], k: int) -> DataFrame:
    """All statistics at one ``k``."""
    return neighbours.groupBy("query_id").agg(*profile_aggs(props, [k]), *density_aggs([k]))


def _neighbour_list(neighbours: DataFrame, k: int, vec: str) -> DataFrame:
    near = neighbours.where(F.col("rank") <= k)
    return near.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", V.as_doubles(vec).alias("v")))), lambda s: s["v"]).alias("_vs")
    )


def _mean_vector(vs: Column) -> Column:
    def total(rows: Column) -> Column:
        return F.aggregate(
            F.slice(rows, 2, F.size(rows)), F.element_at(rows, 1), lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b)
        )

    return V.let(vs, lambda rows: F.transform(total(rows), lambda x: x / F.size(rows)))


def centroid(neighbours: DataFrame, k: int = 10, vec: str = "vec") -> DataFrame:
    """Mean vector of the first ``k`` neighbours (at most ``k`` vectors per query are brought together)."""
    return _neighbour_list(neighbours, k, vec).select("query_id", _mean_vector(F.col("_vs")).alias("centroid"))


def centroid_stats(queries: DataFrame, neighbours: DataFrame, k: int = 10, vec: str = "vec") -> DataFrame:
    """Cosine of the query to its centroid and mean Euclidean spread around the centroid."""

    def stats(c: Column) -> Column:
        spread = F.aggregate("_vs", F.lit(0.0), lambda acc, v: acc + V.distance(v, c)) / F.size("_vs")
        to_centre = V.dot(F.col("_q"), c) / (V.norm(c) + 1e-9)
        return F.struct(c.alias("centroid"), to_centre.alias("sim_to_centroid"), spread.alias("centroid_spread"))

    q = queries.select("query_id", V.l2_normalise(V.as_doubles(vec)).alias("_q"))
    both = _neighbour_list(neighbours, k, vec).join(q, "query_id")
    return both.select("query_id", V.let(_mean_vector(F.col("_vs")), stats).alias("_s")).select("query_id", "_s.*")


def structure(neighbours: DataFrame, k: int = 10, first: int = 5) -> DataFrame:
    """Fingerprint similarity of the nearest, mean of the first ``first`` known ones, same-group share of ``k``.

    ``fp_sim`` is null for an unreadable neighbour: the similarity mean drops it,
    the group share still divides by all neighbours. A blank group never matches.
    """
    near = neighbours.where(F.col("rank") <= k)
    known = F.when(F.col("fp_sim").isNotNull(), F.struct("rank", "fp_sim"))
    same = (F.col("query_group") == F.col("lib_group")) & (F.col("query_group") != "")
    agg = near.groupBy("query_id").agg(
        F.array_sort(F.collect_list(known)).alias("_fp"),
        F.avg(F.coalesce(same, F.lit(False)).cast("double")).alias(f"same_group_frac_k{k}"),
    )
    head = F.slice("_fp", 1, first)
    mean = F.aggregate(head, F.lit(0.0), lambda acc, s: acc + s["fp_sim"]) / F.size(head)
    return agg.select(
        "query_id",
        F.when(F.size("_fp") > 0, F.element_at("_fp", 1)["fp_sim"]).otherwise(0.0).alias("fp_sim_k1"),
        F.when(F.size("_fp") > 0, mean).otherwise(0.0).alias(f"fp_sim_k{first}_mean"),
        f"same_group_frac_k{k}",
    )


def coverage_table(cov: DataFrame, by: str, thresholds: list[float] = [0.3, 0.4, 0.6, 0.8]) -> DataFrame:
    """n, median, mean and share above each threshold: per group plus an ``ALL`` row."""
    from corvane.operators.ordered import exact_quantiles

    both = cov.select(F.explode(F.array(F.col(by), F.lit("ALL"))).alias(by), "max_sim")
    base = both.groupBy(by).agg(
        F.count("*").alias("n"),
        F.avg("max_sim").alias("mean"),
        *[F.avg((F.col("max_sim") >= t).cast("double")).alias(f"ge_{int(t * 100)}") for t in thresholds],
    )
    return base.join(exact_quantiles(both, [by], "max_sim", {"median": 0.5}), by)
