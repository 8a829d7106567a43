"""Mixing sources to target weights by hash-threshold histograms.

Each document has a uniform hash. A source takes whole passes over its documents and, for the rest of its target, the
documents whose hash lies below a threshold. The threshold comes from nested histograms: sizes are summed by (source, hash
bucket), the bucket in which the budget runs out is found, and only the documents of that one bucket are summed again at a
finer grain. Nothing is sorted, no source meets in one task, and a rerun chooses the same documents.

Cases: a null text has size 0; a null source is a source, the last one; ties (equal hashes, as of rows with the same id) stay
together; an empty table gives an empty table; input columns named like a result column are replaced; texts count whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from corvane.llm.common import WORD, without
from corvane.session import cut_lineage

WEIGHTS = (5.0, 2.0, 1.0)
#: Words wanted, as a share of all words.
SHARE = 1.5
#: Passes over a source at most.
MOST = 2.0
#: Hash bits settled per histogram, and hash bits in all.
STEP_BITS, HASH_BITS = 12, 60
#: Number of sources up to which their table (about 50 bytes a row) is broadcast.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform_hash(key: Column) -> Column:
    """60 bits of an MD5 of the key's text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per source: ``source_size`` and ``target``.

    Targets share ``share`` of all sizes by weight, weights repeating over the sources in code-point order, null last. A
    target stops at ``most`` times its source's size and the excess is shared again by weight among the others.
    """
    spark = sizes.sparkSession
    totals = cut_lineage(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    schema = T.StructType([totals.schema["source"], T.StructField("source_size", T.LongType()), T.StructField("weight", T.DoubleType())])
    ranked = totals.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex()
    weighted = spark.createDataFrame(ranked.map(lambda x: (x[0]["source"], x[0]["source_size"], float(weights[x[1] % len(weights)]))), schema)
    weighted = cut_lineage(weighted.withColumn("cap", F.col("source_size") * F.lit(float(most))))
    whole = share * (weighted.agg(F.sum("source_size")).first()[0] or 0)
    capped, free_weight, rate = 0.0, weighted.agg(F.sum("weight")).first()[0] or 0.0, 0.0
    while free_weight > 0:
        rate = (whole - capped) / free_weight
        over = F.col("cap") < F.col("weight") * F.lit(rate)
        row = weighted.agg(F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight")))).first()
        now_capped, now_free = row[0] or 0.0, row[1] or 0.0
        if now_free == free_weight:
            break
        capped, free_weight = now_capped, now_free
    return weighted.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.lit(rate)).alias("target"))


def _join(rows: DataFrame, small: DataFrame, few: bool, names: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with columns ``names`` of the per-source table; sources match as null-safe values."""
    side = small.select(F.col("source").alias("_source"), *[F.col(n) for n in names])
    return rows.join(F.broadcast(side) if few else side, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def thresholds(sizes: DataFrame, targets: DataFrame, few: bool) -> DataFrame:
    """Adds to ``targets`` the whole ``passes`` and the exclusive hash ``bound`` of the documents taken once more."""
    size, goal = F.greatest(F.col("source_size"), F.lit(1)), F.col("target")
    found = cut_lineage(targets.withColumn("passes", F.floor(goal / size)).withColumn(
        "budget", F.floor(goal - F.col("passes") * F.col("source_size"))).withColumn("bound", F.lit(0).cast("long")))
    shift = HASH_BITS
    rows = sizes.where("size > 0")
    while shift > 0:
        # the open bucket of a source is [bound, bound + 2^shift); its documents fall into 2^STEP_BITS finer ones
        finer = shift - STEP_BITS
        open_rows = _join(rows, found, few, ["bound"]).where(
            (F.col("hash") >= F.col("bound")) & (F.col("hash") < F.col("bound") + F.lit(1 << shift)))
        cells = open_rows.groupBy("source", F.shiftright("hash", finer).alias("cell")).agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
        # 2^STEP_BITS cells of a source at most: the running sum is bounded per source
        cells = cells.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("cell", "words", "docs"))).alias("cells"))
        step = F.aggregate(
            "cells",
            F.struct(F.lit(0).cast("long").alias("used"), F.lit(None).cast("long").alias("at"), F.lit(0).cast("long").alias("docs")),
            lambda a, c: F.when(a["at"].isNotNull(), a)
            .when(a["used"] + c["words"] <= F.col("budget"), F.struct((a["used"] + c["words"]).alias("used"), a["at"].alias("at"), a["docs"].alias("docs")))
            .otherwise(F.struct(a["used"].alias("used"), c["cell"].alias("at"), c["docs"].alias("docs"))),
        )
        joined = found.join(cells.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        joined = joined.withColumn("step", F.when(F.col("cells").isNotNull(), step)).drop("cells")
        at = F.col("step.at")
        found = cut_lineage(joined.select(
            "source", "source_size", "target", "passes",
            F.coalesce(F.col("budget") - F.col("step.used"), F.col("budget")).alias("budget"),
            # without a boundary bucket every document of the open bucket fits
            F.when(at.isNotNull(), F.shiftleft(at, finer)).when(F.col("step").isNotNull(), F.col("bound") + F.lit(1 << shift)).otherwise(F.col("bound")).alias("bound"),
            (at.isNotNull() & (F.col("step.docs") > 1)).alias("open"),
        ))
        shift = finer
        if not found.where("open").limit(1).count():
            break
    return found


def mix_sources(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[float, ...] = WEIGHTS,
                share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds ``size``, ``source_size``, ``target`` and ``taken`` (words the mix takes of the document, repeats counted).

    ``taken`` is a multiple of ``size`` and at most ``most`` times it, rounded up to whole passes; per source the sum of
    ``taken`` is below its target by less than the size of the document at the threshold (of all documents that share its hash).
    """
    rows = without(df, ["size", "source_size", "target", "taken", "_mix_source", "_mix_passes", "_mix_bound"])
    sized = rows.withColumn("size", word_count(F.col(text)))
    thin = cut_lineage(sized.select(F.col(source).alias("source"), "size", uniform_hash(F.col(key)).alias("hash")))
    targets = cut_lineage(source_targets(thin, weights, share, most))
    few = targets.count() <= BROADCAST_SOURCES
    found = thresholds(thin, targets, few)
    side = found.select(F.col("source").alias("_mix_source"), "source_size", "target", F.col("passes").alias("_mix_passes"), F.col("bound").alias("_mix_bound"))
    out = sized.join(F.broadcast(side) if few else side, F.col(source).eqNullSafe(F.col("_mix_source")), "left")
    times = F.col("_mix_passes") + (uniform_hash(F.col(key)) < F.col("_mix_bound")).cast("long")
    return out.withColumn("taken", (F.col("size") * times).cast("long")).drop("_mix_source", "_mix_passes", "_mix_bound")
