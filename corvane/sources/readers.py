"""Reading split tables, aliased text tables and trees of JSON records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read_splits(spark: SparkSession, paths: dict[str, str], schema: str, fmt: str = "csv") -> DataFrame:
    """One table from a file or folder per split, tagged with ``split``."""
    def one(split: str, path: str) -> DataFrame:
        reader = spark.read.schema(schema)
        frame = reader.option("header", True).csv(path) if fmt == "csv" else reader.parquet(path)
        return frame.withColumn("split", F.lit(split))

    return reduce(DataFrame.unionByName, [one(s, p) for s, p in paths.items()])


def read_aliased(spark: SparkSession, path: str, aliases: dict[str, str], types: dict[str, str]) -> DataFrame:
    """Quoted tab-separated file whose header may use any of the aliased names; canonical names come out."""
    raw = spark.read.option("header", True).option("sep", "\t").option("quote", '"').option("escape", '"').csv(path)
    named = raw.withColumnsRenamed({c: aliases[c] for c in raw.columns if c in aliases})
    return named.select(*[F.col(c).cast(t).alias(c) for c, t in types.items()])


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_if_exists(spark: SparkSession, paths: dict[str, str], schema: str) -> tuple[DataFrame, DataFrame]:
    """The splits that exist, and a ``(split, status)`` table naming the ones that do not."""
    found = {s: p for s, p in paths.items() if _exists(spark, p)}
    rows = [(s, "read" if s in found else "missing") for s in paths]
    status = spark.createDataFrame(rows, "split string, status string")
    if not found:
        return spark.createDataFrame([], schema + ", split string"), status
    return read_splits(spark, found, schema), status


def scan_metrics(spark: SparkSession, root: str, schema: str, path_columns: list[str], glob: str = "*.json") -> DataFrame:
    """All JSON records below ``root``. The last path parts become columns: with ``["dataset", "model"]`` a file at
    ``.../en/gbt/x.json`` gets dataset ``en`` and model ``gbt``; a ``name=`` in front of a part is cut off.
    Interval files next to the metric files are not metric records and are left out.
    """
    raw = (spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", glob).json(root)
           .withColumn("_path", F.col("_metadata.file_path")))
    parts = F.split("_path", "/")
    n = len(path_columns)
    for i, name in enumerate(path_columns):
        raw = raw.withColumn(name, F.regexp_replace(F.url_decode(F.element_at(parts, i - n - 1)), r"^[A-Za-z_]+=", ""))
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.json$", "")
    return raw.where(~stem.contains("ci_metrics") & ~stem.contains("best_params")).withColumn("stem", stem).drop("_path")


def parse_stem(stem: Column, prefix: Column) -> Column:
    """Model name left after cutting a prefix that may be repeated."""
    return F.regexp_replace(stem, F.concat(F.lit("^("), prefix, F.lit("_)+")), F.lit(""))


def attach_ci(metrics: DataFrame, ci: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """``ci(keys..., metric, se, ci_lo, ci_hi)`` as ``<metric>_se/_ci_lo/_ci_hi`` columns on the metric rows."""
    wide = ci.groupBy(*keys).pivot("metric", names).agg(*[F.first(c).alias(c) for c in ("se", "ci_lo", "ci_hi")])
    return metrics.join(wide, keys, "left")


def unify_results(frames: list[DataFrame], renames: list[dict[str, str]], family: str, pattern: str) -> DataFrame:
    """Result tables of different historical schemas as one; ``family`` is read off the model name."""
    same = [f.withColumnsRenamed(r) for f, r in zip(frames, renames)]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), same)
    return out.withColumn(family, F.regexp_extract("model", pattern, 1))
