"""Ordered operators that never send a whole group through one task.

A plain ``Window.partitionBy(group).orderBy(x)`` sorts each group in a single
task, which fails when one group holds a third of the table. Every operator
here works on two levels instead: rows are cut into order-preserving buckets,
the window runs inside ``(group, bucket)``, and what earlier buckets contribute
comes from a small per-bucket table joined back on ``(group, bucket)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.session import default_buckets

BUCKET = "_bucket"


def _as_number(df: DataFrame, order: str) -> Column:
    """A double that never falls while ``order`` rises; values that share one only share a bucket."""
    if df.schema[order].dataType.typeName() in ("string", "char", "varchar"):
        # the first six bytes, padded, as a number
        head = F.rpad(F.hex(F.substring(F.col(order).cast("binary"), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    return F.col(order).cast("double")


def with_bucket(df: DataFrame, order: str, buckets: int | None = None) -> DataFrame:
    """Adds an equi-depth bucket id that is monotone in the numeric or text column ``order``.

    The split points come from one approximate-quantile aggregate over all rows.
    They only decide balance; every result built on top is exact.
    """
    n = buckets or default_buckets(df.sparkSession)
    cuts = [i / n for i in range(1, n)]
    value = _as_number(df, order)
    points = df.select(F.percentile_approx(value, cuts, max(1000, 10 * n))).scalar()
    # how many cuts lie below the value: binary search with halving strides, log2(n) steps per row
    strides = F.array(*[F.lit(1 << b) for b in reversed(range((n - 1).bit_length()))])
    below = F.aggregate(
        strides, F.lit(0), lambda at, step: F.when(F.try_element_at("_cuts", at + step) < value, at + step).otherwise(at)
    )
    return df.withColumn("_cuts", points).withColumn(BUCKET, below).drop("_cuts")


def _join_back(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(small, keys, "left")


def prefix_sums(
    df: DataFrame,
    by: list[str],
    order: str,
    values: dict[str, Column],
    totals: dict[str, str] | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Inclusive prefix sums of ``values`` inside each ``by`` group, in rising ``order``.

    ``order`` must be unique inside a group (aggregate ties first). ``totals``
    maps a new column to one of the values and adds that value's group total; it
    comes with the per-bucket table, so no join on the bare group key is needed.
    """
    keyed = with_bucket(df.select("*", *[v.alias(f"_v_{k}") for k, v in values.items()]), order, buckets)
    keys, totals = [*by, BUCKET], totals or {}
    sums = keyed.groupBy(*keys).agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in values])
    whole = Window.partitionBy(*by)
    before = whole.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(
        *keys,
        *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_c_{k}") for k in values],
        *[F.sum(f"_t_{k}").over(whole).alias(name) for name, k in totals.items()],
    )
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = keyed.select("*", *[F.sum(f"_v_{k}").over(inside).alias(f"_l_{k}") for k in values])
    out = _join_back(local, carried, keys)
    return out.select(*df.columns, *[(F.col(f"_l_{k}") + F.col(f"_c_{k}")).alias(k) for k in values], *totals)


def dense_index(
    df: DataFrame, by: list[str], order: str, tie: str | None = None, name: str = "idx", total: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """0-based position of each row inside its ``by`` group, in rising ``(order, tie)``.

    Equals ``row_number() - 1`` but without one task per group. ``order`` (numbers
    or text) drives the buckets; ``tie`` settles equal values; ``total`` names
    an extra column with the group's size.
    """
    keyed = with_bucket(df, order, buckets)
    keys = [*by, BUCKET]
    counts = keyed.groupBy(*keys).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*by)
    before = whole.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_c"), F.sum("_n").over(whole).alias("_all"))
    inside = Window.partitionBy(*keys).orderBy(*[c for c in (order, tie) if c])
    local = keyed.withColumn("_r", F.row_number().over(inside))
    extra = [F.col("_all").alias(total)] if total else []
    return _join_back(local, carried, keys).select(*df.columns, (F.col("_r") - 1 + F.col("_c")).alias(name), *extra)


def exact_quantiles(
    df: DataFrame, by: list[str], col: str, qs: dict[str, float], buckets: int | None = None
) -> DataFrame:
    """Exact linearly interpolated quantiles per group (the NumPy/pandas default).

    ``percentile`` keeps every distinct value of a group in one reducer; this
    aggregates equal values first and then only needs prefix counts.
    """
    value = F.col(col).cast("double")
    counts = (
        df.where(value.isNotNull() & ~F.isnan(value))
        .groupBy(*by, value.alias("_v"))
        .agg(F.count("*").alias("_c"))
    )
    ranked = prefix_sums(counts, by, "_v", {"_cum": F.col("_c")}, {"_n": "_cum"}, buckets)
    picks = []
    for name, q in qs.items():
        spot = (F.col("_n") - 1) * F.lit(float(q))
        picks += [
            F.min(F.when(F.col("_cum") >= F.floor(spot) + 1, F.col("_v"))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("_cum") >= F.ceil(spot) + 1, F.col("_v"))).alias(f"_hi_{name}"),
        ]
    agg = ranked.groupBy(*by).agg(F.max("_n").alias("_n"), *picks)
    cols = []
    for name, q in qs.items():
        spot = (F.col("_n") - 1) * F.lit(float(q))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        cols.append((lo + (hi - lo) * (spot - F.floor(spot))).alias(name))
    return agg.select(*by, *cols)


def average_ranks(df: DataFrame, by: list[str], col: str, weight: str = "_w", name: str = "rank") -> DataFrame:
    """Average rank (ties share their mean rank) of each distinct ``col`` value, given row counts ``weight``."""
    counts = df.groupBy(*by, col).agg(F.sum(weight).alias("_c"))
    ranked = prefix_sums(counts, by, col, {"_cum": F.col("_c")})
    return ranked.select(*by, col, (F.col("_cum") - F.col("_c") + (F.col("_c") + 1) / 2.0).alias(name))


def time_bucket(df: DataFrame, ts: str, name: str = "_bucket", buckets: int | None = None) -> DataFrame:
    """Adds an equi-depth bucket of a timestamp, so a busy hour is cut as finely as a quiet month."""
    cut = with_bucket(df.withColumn("_micros", F.unix_micros(F.col(ts).cast("timestamp"))), "_micros", buckets)
    return cut.drop("_micros").withColumnRenamed(BUCKET, name)


def with_next(df: DataFrame, by: list[str], bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """``lead(value)`` by ``order`` inside ``by``; ``bucket`` is a coarse monotone part of the order (see ``time_bucket``)."""
    keys = [*by, bucket]
    heads = df.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias("_head"))
    after = heads.select(*keys, F.lead("_head").over(Window.partitionBy(*by).orderBy(bucket)).alias("_after"))
    local = df.withColumn("_next", F.lead(value).over(Window.partitionBy(*keys).orderBy(*order)))
    out = _join_back(local, after, keys)
    return out.select(*df.columns, F.coalesce("_next", "_after").alias(name))


def with_prior_max(df: DataFrame, by: list[str], bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """Largest ``value`` strictly before each row by ``order`` inside ``by`` (null on the first row)."""
    keys = [*by, bucket]
    tops = df.groupBy(*keys).agg(F.max(value).alias("_top"))
    earlier = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*keys, F.max("_top").over(earlier).alias("_carried"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_here", F.max(value).over(inside))
    out = _join_back(local, carried, keys)
    return out.select(*df.columns, F.greatest("_here", "_carried").alias(name))


def scalar_columns(df: DataFrame, one_row: DataFrame, names: list[str]) -> DataFrame:
    """Adds the columns of a one-row aggregate as scalar subqueries (no join, no collect)."""
    return reduce(lambda d, n: d.withColumn(n, one_row.select(n).scalar()), names, df)


def carry_forward(df: DataFrame, by: list[str], bucket: str, order: list[str], values: dict[str, str]) -> DataFrame:
    """Last non-null value at or before each row by ``order`` inside ``by``, for each ``{value column: new name}``."""
    keys = [*by, bucket]
    lasts = df.groupBy(*keys).agg(*[
        F.max_by(v, F.when(F.col(v).isNotNull(), F.struct(*order))).alias(f"_last_{n}") for v, n in values.items()])
    earlier = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(*keys, *[F.last(f"_last_{n}", ignorenulls=True).over(earlier).alias(f"_carried_{n}") for n in values.values()])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.select("*", *[F.last(v, ignorenulls=True).over(inside).alias(f"_here_{n}") for v, n in values.items()])
    out = _join_back(local, carried, keys)
    return out.select(*df.columns, *[F.coalesce(f"_here_{n}", f"_carried_{n}").alias(n) for n in values.values()])
