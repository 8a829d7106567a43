"""Documents to packed training sequences, in stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.llm import jaccard_join, mixing, packing, quality, secret_scan
from corvane.llm.common import documents
from corvane.llm.queries import TOKENIZER
from corvane.session import cut_lineage, new_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.quality_rules(docs).where("kept").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group linked by five-word shingles at 0.8; a row without an id stays.

    Where ids repeat, rows are told apart by their place in the order of (id, text): other texts of the same id stay, copies go.
    """
    rows = docs.select(*COLUMNS)
    named, key = rows.where("doc_id is not null"), "doc_id"
    if not named.groupBy("doc_id").count().where("count > 1").isEmpty():
        by = [F.col("doc_id"), F.xxhash64("text")]
        named, key = cut_lineage(named.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_key", F.monotonically_increasing_id())), "_key"
    stays = jaccard_join.jaccard_components(named, key=key, size=5, percent=80).where(f"component_id = {key}").select(key)
    return named.join(stays, key, "left_semi").select(*COLUMNS).unionByName(rows.where("doc_id is null"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in the text and ``n_chars`` counted anew where a text changed."""
    clean = secret_scan.scan_secrets(docs, redact=True)
    return clean.withColumn("n_chars", F.when(F.size("secret_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of a document as the mix takes passes over it; documents without words stay out."""
    mixed = mixing.mix_sources(docs).where("taken > 0")
    return mixed.withColumn("_pass", F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int")))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: pieces with their place."""
    return packing.pack_documents(docs, TOKENIZER, payload="crc32")


STAGES = [("quality", quality_stage), ("near duplicates", near_duplicate_stage), ("secrets", secret_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: Compression and tokenization have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
