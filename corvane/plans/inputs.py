"""Shared inputs built from the given tables, as DataFrames and as SQL.

The SQL constants are lists of common table expressions without the leading
``WITH``. Everything covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.functions.fingerprints import hashed_fingerprint
from corvane.plans.registry import table, text_table

# ---- vectors -------------------------------------------------------------------


def vector_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All embeddings; label 0 stands for 'no group'."""
    e = table(spark, sf, "embeddings")
    group = F.when(F.col("label") != 0, F.concat(F.lit("g"), F.col("label").cast("string")))
    return e.select("vec_id", F.col("embedding").alias("vec"), group.alias("grp"))


def queries_and_library(spark: SparkSession, sf: str):
    """Every vector is a query against the whole table; a row is never its own neighbour."""
    v = vector_rows(spark, sf)
    return (v.select(F.col("vec_id").alias("query_id"), "vec", F.col("grp").alias("query_group")),
            v.select(F.col("vec_id").alias("lib_id"), "vec", F.col("grp").alias("lib_group")))


def library_properties(spark: SparkSession, sf: str) -> DataFrame:
    """Three numbers per library row, taken from the part its id wraps to."""
    part = table(spark, sf, "part")
    ids = table(spark, sf, "embeddings").select("vec_id").withColumn("_n", part.select(F.count("*")).scalar())
    props = part.select(
        F.col("p_partkey").alias("_pk"),
        (F.col("p_retailprice") / 100.0).alias("price"),
        F.col("p_size").cast("double").alias("size"),
        F.length("p_name").cast("double").alias("name_len"),
    )
    return ids.withColumn("_pk", F.col("vec_id") % F.col("_n")).join(props, "_pk").select(
        F.col("vec_id").alias("lib_id"), "price", "size", "name_len")


PROPS = ["price", "size", "name_len"]

VEC_SQL = """
v AS (SELECT vec_id, embedding::double[] AS e,
             CASE WHEN label <> 0 THEN 'g' || label::varchar END AS grp FROM embeddings),
u AS (SELECT vec_id, grp, sqrt(list_dot_product(e, e)) AS nrm, e FROM v),
unit AS (SELECT vec_id, grp, list_transform(e, lambda x: x / (nrm + 1e-12)) AS e FROM u),
lib AS (SELECT unit.vec_id AS lib_id, unit.e, unit.grp AS lib_group, p.p_retailprice / 100.0::double AS price,
               p.p_size::double AS size, length(p.p_name)::double AS name_len
        FROM unit JOIN part p ON p.p_partkey = unit.vec_id % (SELECT count(*) FROM part)),
scored AS (SELECT q.vec_id AS query_id, q.grp AS query_group, l.lib_id, l.lib_group, l.e AS le, q.e AS qe,
                  l.price, l.size, l.name_len, list_dot_product(q.e, l.e) AS sim
           FROM unit q JOIN lib l ON q.vec_id <> l.lib_id),
nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, lib_id) AS rank
                      FROM scored) WHERE rank <= 20)
"""


def neighbours(spark: SparkSession, sf: str, k: int = 20) -> DataFrame:
    from corvane.operators.retrieval import gather, topk_cosine

    q, lib = queries_and_library(spark, sf)
    hits = gather(topk_cosine(q, lib, k, exclude_self=True), library_properties(spark, sf), PROPS)
    return gather(hits, lib, ["lib_group", "vec"])


# ---- fingerprints ----------------------------------------------------------------


def fingerprints(spark: SparkSession, sf: str, name: str, key: str, out: str, n_bits: int = 2048) -> DataFrame:
    return text_table(spark, sf, name).select(F.col(key).alias(out), hashed_fingerprint(F.col("text"), n_bits, hasher="md5").alias("fp"))


def bits_sql(source: str, key: str, out: str, n_bits: int = 2048) -> str:
    """Sorted list of set bit positions, the unpacked form of the packed words."""
    return f"""
tok_{out} AS (SELECT {key} AS {out}, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '') AS w FROM {source}),
bits_{out} AS (SELECT {out}, list_sort(list_distinct(list_transform(
      CASE WHEN len(w) >= 3 THEN range(1, len(w) - 1) ELSE []::bigint[] END,
      lambda i: concat('0x', substr(md5(w[i] || ' ' || w[i+1] || ' ' || w[i+2]), 1, 8))::bigint % {n_bits}))) AS b FROM tok_{out})
"""


# ---- predictions -------------------------------------------------------------------
# Scores come from integer arithmetic on the rows, so every engine gets the same bits. Ties occur on purpose.


def binary_rows(spark: SparkSession, sf: str) -> DataFrame:
    """``(model, seed, row_id, lang, y, score, pred)``: three models by five seeds over every labelled document."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    noise = (F.col("row_id") * 7919 + F.col("n_chars") * 31 + F.col("model") * 1013 + F.col("seed") * 37 * F.col("model")) % 1000
    rows = (
        d.select(F.col("doc_id").alias("row_id"), "lang", "n_chars", F.col("quality").alias("y"))
        .withColumn("model", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
        .withColumn("seed", F.explode(F.array(*[F.lit(s) for s in range(42, 47)])))
    )
    score = (noise + F.col("y") * 200 * F.col("model")) / (F.lit(1000.0) + 200 * F.col("model"))
    return rows.select("model", "seed", "row_id", "lang", "y", score.alias("score"), (score >= 0.5).cast("int").alias("pred"))


BINARY_SQL = """
binary_base AS (SELECT model, seed, doc_id AS row_id, lang, quality AS y,
   ((doc_id * 7919 + n_chars * 31 + model * 1013 + seed * 37 * model) % 1000 + quality * 200 * model) / (1000.0::double + 200 * model) AS score
   FROM documents JOIN labels USING (doc_id), (SELECT unnest([1, 2, 3]) AS model), (SELECT unnest(range(42, 47))::int AS seed)),
binary_rows AS (SELECT *, (score >= 0.5)::int AS pred FROM binary_base)
"""

N_CLASSES = 10


def multi_rows(spark: SparkSession, sf: str) -> DataFrame:
    """``(row_id, y, proba)`` over every embedding: ten class scores that sum to 1."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").alias("y"))
    raw = F.transform(
        F.sequence(F.lit(0), F.lit(N_CLASSES - 1)),
        lambda c: (F.col("row_id") * 37 + c * 101) % 97 + F.when(c == F.col("y"), 60).otherwise(0) + 1,
    )
    return e.withColumn("raw", raw).select(
        "row_id", "y",
        F.transform("raw", lambda x: x / F.aggregate("raw", F.lit(0).cast("bigint"), lambda a, b: a + b).cast("double")).alias("proba"))


MULTI_SQL = f"""
multi_raw AS (SELECT vec_id AS row_id, label AS y,
   list_transform(range({N_CLASSES}), lambda c: (vec_id * 37 + c * 101) % 97 + CASE WHEN c = label THEN 60 ELSE 0 END + 1) AS raw FROM embeddings),
multi_rows AS (SELECT row_id, y, list_transform(raw, lambda x: x / list_sum(raw)::double) AS proba FROM multi_raw)
"""


def regression_rows(spark: SparkSession, sf: str) -> DataFrame:
    """``(grp, row_id, y, pred)`` over every order."""
    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("grp"), F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("y"),
        (F.col("o_totalprice") * 0.5 + (F.col("o_custkey") * 37 % 1000) * 250.0).alias("pred"))


REG_SQL = """
reg_rows AS (SELECT o_orderpriority AS grp, o_orderkey AS row_id, o_totalprice AS y,
   o_totalprice * 0.5::double + (o_custkey * 37 % 1000) * 250.0::double AS pred FROM orders)
"""


def regression_arms(spark: SparkSession, sf: str) -> DataFrame:
    """``(model, seed, row_id, y, pred)``: lengths predicted by two models of five seeds over every document, in whole numbers."""
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), F.col("n_chars").cast("bigint").alias("y"))
    rows = rows.withColumn("model", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in range(42, 47)])))
    noise = (F.col("row_id") * 7919 + F.col("model") * 1013 + F.col("seed") * 37 * F.col("model")) % 1000
    return rows.select("model", "seed", "row_id", "y", (F.col("y") + noise * (F.lit(6) - F.col("model"))).cast("bigint").alias("pred"))


REG_ARMS_SQL = """
reg_arms AS (SELECT model, seed, doc_id AS row_id, n_chars::bigint AS y,
   n_chars::bigint + (doc_id * 7919 + model * 1013 + seed * 37 * model) % 1000 * (6 - model) AS pred
   FROM documents, (SELECT unnest([1, 2]) AS model), (SELECT unnest(range(42, 47))::int AS seed))
"""


# ---- a grid of configuration cells ---------------------------------------------------


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """``(dataset, emb, tree, seed, cv, test, n)``: a measured value per configuration and seed, over every order.

    dataset = order priority, emb = market segment, tree = order status, seed =
    42 + key mod 5; cv and test are mean prices of even and odd order lines in millions.
    """
    o = table(spark, sf, "orders").join(
        table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    price = F.col("o_totalprice") / 1e6
    half = F.col("o_orderkey") % 2
    return o.groupBy(
        F.col("o_orderpriority").alias("dataset"), F.col("c_mktsegment").alias("emb"), F.col("o_orderstatus").alias("tree"),
        (F.lit(42) + F.col("o_orderkey") % 5).cast("int").alias("seed"),
    ).agg(F.avg(F.when(half == 0, price)).alias("cv"), F.avg(F.when(half == 1, price)).alias("test"), F.count("*").alias("n"))


CELL_SQL = """
cells AS (SELECT o_orderpriority AS dataset, c_mktsegment AS emb, o_orderstatus AS tree, (42 + o_orderkey % 5)::int AS seed,
   avg(o_totalprice / 1e6::double) FILTER (WHERE o_orderkey % 2 = 0) AS cv,
   avg(o_totalprice / 1e6::double) FILTER (WHERE o_orderkey % 2 = 1) AS test, count(*) AS n
   FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)
"""


def configs(spark: SparkSession, sf: str) -> DataFrame:
    """Cells averaged over seeds, with a normal interval from the seed spread."""
    g = cells(spark, sf).groupBy("dataset", "emb", "tree").agg(
        F.avg("test").alias("test"), F.avg("cv").alias("cv"), F.stddev_samp("test").alias("sd"), F.count("test").alias("n"))
    se = F.col("sd") / F.sqrt(F.col("n").cast("double"))
    return g.withColumns({"method": F.concat_ws("/", "emb", "tree"), "point": F.col("test"), "se": se,
                          "ci_lo": F.col("test") - se, "ci_hi": F.col("test") + se})


CONFIG_SQL = CELL_SQL + """,
configs AS (SELECT *, emb || '/' || tree AS method, test AS point, sd / sqrt(n) AS se,
   test - sd / sqrt(n) AS ci_lo, test + sd / sqrt(n) AS ci_hi FROM
   (SELECT dataset, emb, tree, avg(test) AS test, avg(cv) AS cv, stddev_samp(test) AS sd, count(test) AS n FROM cells GROUP BY ALL))
"""
