"""Outputs: partitioned writes, manifests, keyed upserts, pending work and change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_splits(df: DataFrame, path: str, by: tuple[str, ...] = ("dataset", "split")) -> str:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
    return path


def write_predictions(df: DataFrame, path: str, by: tuple[str, ...] = ("exp", "cfg")) -> str:
    """Prediction store keyed by experiment cell: one folder per cell, replaced as a whole when recomputed."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return path


def manifest(df: DataFrame, dataset: str, split: str, splits: list[str]) -> DataFrame:
    """One row per dataset with a column of rows per split."""
    wide = df.groupBy(dataset).pivot(split, splits).count()
    return wide.select(dataset, *[F.coalesce(F.col(s), F.lit(0)).alias(f"n_{s}") for s in splits])


def upsert_by_key(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of recomputed keys are replaced, the rest stays."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def pending(work: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Work items without an output yet."""
    return work.join(done.select(*key), key, "left_anti")


def changed_rows(a: DataFrame, b: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """``(key..., change)`` with change added, removed or changed; equal rows are left out."""
    def digest(d: DataFrame, name: str) -> DataFrame:
        cells = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols]
        return d.select(*key, F.md5(F.concat_ws("\u0001", *cells)).alias(name))

    j = digest(a, "_a").join(digest(b, "_b"), key, "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    return j.where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*key, change.alias("change"))
