"""Semi-structured text: tables inside text files and timestamped log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corvane.functions.text import clean_cell, to_number
from corvane.operators.ordered import carry_forward

LINES_PER_BUCKET = 50_000


def extract_text_tables(lines: DataFrame, label_re: str, header_re: str, row_re: str, sep: str = "&") -> DataFrame:
    """Rows of tables written into text, as ``(doc, line_no, label, column, value, number)``.

    ``lines(doc, line_no, line)``. A label line and a header line hold for all
    rows after them, until the next one; a row counts only when it has as many
    fields as the header in force.
    """
    tagged = (
        lines.withColumn("_bucket_no", F.floor(F.col("line_no") / LINES_PER_BUCKET))
        .withColumn("_label", F.when(F.col("line").rlike(label_re), F.regexp_extract("line", label_re, 1)))
        .withColumn("_header", F.when(F.col("line").rlike(header_re), F.col("line")))
    )
    tagged = carry_forward(tagged, ["doc"], "_bucket_no", ["line_no"], {"_label": "label", "_header": "header"})
    rows = tagged.where(F.col("_label").isNull() & F.col("_header").isNull() & F.col("line").rlike(row_re)
                        & F.col("header").isNotNull() & F.col("label").isNotNull())

    def fields(c: str):
        return F.transform(F.split(F.regexp_replace(c, r"\\\\\s*$", ""), sep), clean_cell)

    cut = rows.select("doc", "line_no", "label", fields("header").alias("_h"), fields("line").alias("_f"))
    pairs = cut.where(F.size("_h") == F.size("_f")).select(
        "doc", "line_no", "label", F.inline(F.arrays_zip(F.col("_h").alias("column"), F.col("_f").alias("value"))))
    return pairs.withColumn("number", to_number(F.col("value")))


def parse_log(lines: DataFrame, marker: str, key: str) -> DataFrame:
    """Adds ``ts`` (null without a leading timestamp), ``is_marker`` and the ``key=value`` value to ``lines(line)``."""
    stamp = F.regexp_extract("line", r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)", 1)
    value = F.regexp_extract("line", rf"{key}=(\w+)", 1)
    return lines.withColumns({
        "ts": F.when(stamp != "", F.to_timestamp_ntz(F.nullif(stamp, F.lit("")), F.lit("yyyy-MM-dd HH:mm:ss"))),
        key: F.when(value != "", value),
        "is_marker": F.col("line").contains(marker) & (value != ""),
    })
