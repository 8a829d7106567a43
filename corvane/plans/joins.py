"""Queries for joins, lookups, pairing and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions.numeric import rounded
from corvane.operators import joins as J
from corvane.plans import inputs
from corvane.plans.cleaning import split_of, split_sql
from corvane.plans.registry import plan, r6, table


def _stats(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "n_chars")


@plan("J1_join_features", "SELECT doc_id, lang, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)")
def j1(spark, sf):
    other = table(spark, sf, "labels").withColumn("lang", F.lit("ignored"))
    return J.join_features(_stats(spark, sf), other, key="doc_id", assert_unique=True)


@plan("J2_join_three", """
SELECT doc_id, lang, n_chars, quality, toxic, label FROM documents JOIN labels USING (doc_id) JOIN embeddings ON vec_id = doc_id
""")
def j2(spark, sf):
    vec = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return J.join_features(_stats(spark, sf), None, table(spark, sf, "labels"), vec, key="doc_id")


@plan("J3_rows_in_split", f"SELECT l.doc_id, quality FROM labels l SEMI JOIN (SELECT doc_id FROM documents WHERE {split_sql('doc_id')} = 'train') t ON t.doc_id = l.doc_id")
def j3(spark, sf):
    ids = table(spark, sf, "documents").where(split_of("doc_id") == "train")
    return J.rows_in_split(table(spark, sf, "labels").select("doc_id", "quality"), ids, "doc_id")


@plan("J4_lookup", "SELECT doc_id, n_chars, quality FROM documents LEFT JOIN labels USING (doc_id)")
def j4(spark, sf):
    return J.lookup(table(spark, sf, "documents").select("doc_id", "n_chars"), table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


@plan("J5_require_match", "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def j5(spark, sf):
    return J.missing_keys(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@plan("J6_attach_vectors", f"""
SELECT {split_sql('doc_id')} AS split, count(vec_id) AS n_kept, count(*) - count(vec_id) AS n_dropped
FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY 1
""")
def j6(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", split_of("doc_id").alias("split"))
    return J.dropped_without_vector(d, table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", ["split"])


@plan("J7_zip_columns", "SELECT o_orderkey, o_totalprice, lines, qty FROM orders JOIN (SELECT l_orderkey, count(*) AS lines, sum(l_quantity) AS qty FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def j7(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("lines"), F.sum("l_quantity").alias("qty"))
    return J.zip_columns(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), lines, "o_orderkey")


@plan("J13_pair_arms", f"""
WITH {inputs.BINARY_SQL}
SELECT row_id, seed, a.y, a.pred AS pred_a, b.pred AS pred_b FROM (SELECT * FROM binary_rows WHERE model = 1) a
JOIN (SELECT * FROM binary_rows WHERE model = 2) b USING (row_id, seed)
""")
def j13(spark, sf):
    return J.pair_arms(inputs.binary_rows(spark, sf), "model", 1, 2, ["row_id", "seed"])


@plan("J14_matched_configs", f"""
WITH s AS (SELECT p_brand, p_type, CASE WHEN p_size < 15 THEN 'low' WHEN p_size < 35 THEN 'mid' ELSE 'high' END AS stage FROM part)
SELECT p_brand, p_type FROM s GROUP BY 1, 2 HAVING count(DISTINCT stage) = 3
""")
def j14(spark, sf):
    stage = F.when(F.col("p_size") < 15, "low").when(F.col("p_size") < 35, "mid").otherwise("high")
    p = table(spark, sf, "part").select("p_brand", "p_type", stage.alias("stage"))
    return J.matched_configs(p, ["p_brand", "p_type"], "stage", ["low", "mid", "high"])


@plan("J15_compare_tables", f"""
WITH b AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS total, count(*)::double AS cust FROM lineitem GROUP BY 1),
j AS (SELECT o_totalprice AS ta, o_custkey::double AS ca, total AS tb, cust AS cb FROM orders JOIN b ON k = o_orderkey)
SELECT 'total' AS "column", count(*) AS n, {r6('corr(ta, tb)')} AS corr, {r6('max(abs(ta - tb))', 3)} AS max_abs_diff FROM j
UNION ALL SELECT 'cust', count(*), {r6('corr(ca, cb)')}, {r6('max(abs(ca - cb))', 3)} FROM j
""")
def j15(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("total"), F.col("o_custkey").alias("cust"))
    b = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.sum("l_extendedprice").alias("total"), F.count("*").alias("cust"))
    return J.compare_tables(a, b, "k", ["total", "cust"]).withColumns(
        {"corr": rounded("corr"), "max_abs_diff": rounded("max_abs_diff", 3)})


@plan("J16_availability", """
WITH have AS (SELECT DISTINCT lower(p_name) AS k FROM part WHERE p_size > 48)
SELECT n AS name, have.k IS NOT NULL AS available FROM (SELECT DISTINCT upper(p_name) AS n FROM part) LEFT JOIN have ON have.k = lower(n)
""")
def j16(spark, sf):
    p = table(spark, sf, "part")
    return J.availability(p.select(F.upper("p_name").alias("name")), p.where("p_size > 48").select(F.col("p_name").alias("name")), "name")


@plan("J17_overlap", f"""
WITH {inputs.CONFIG_SQL},
best AS (SELECT dataset, arg_max(method, point) AS b FROM configs GROUP BY dataset),
n AS (SELECT x.dataset, x.method, count(*) FILTER (WHERE y.ci_hi < x.ci_lo) AS n_below, count(*) FILTER (WHERE y.ci_lo > x.ci_hi) AS n_above,
        count(*) FILTER (WHERE y.ci_hi >= x.ci_lo AND y.ci_lo <= x.ci_hi) - 1 AS n_overlap
      FROM configs x JOIN configs y USING (dataset) GROUP BY 1, 2)
SELECT n.dataset, n.method, n_below, n_above, n_overlap, NOT (x.ci_hi < y.ci_lo OR y.ci_hi < x.ci_lo) AS ci_overlap,
       NOT (x.point + x.se < y.point - y.se OR y.point + y.se < x.point - x.se) AS se_overlap
FROM n JOIN configs x USING (dataset, method) JOIN best USING (dataset) JOIN configs y ON y.dataset = n.dataset AND y.method = b
""")
def j17(spark, sf):
    ci = inputs.configs(spark, sf).select("dataset", "method", "point", "se", "ci_lo", "ci_hi")
    best = ci.groupBy("dataset").agg(F.max_by("method", "point").alias("b"))
    pairs = ci.select("dataset", F.col("method").alias("a")).join(best, "dataset")
    flags = J.overlap_pairs(ci, pairs, ["dataset"]).withColumnRenamed("a", "method").drop("b")
    counts = J.overlap_counts(ci, ["dataset"]).select("dataset", "method", "n_below", "n_above", "n_overlap")
    return counts.join(flags, ["dataset", "method"])


@plan("U1_union_all", """
SELECT c_name AS name, c_nationkey AS nationkey, c_acctbal AS bal, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_name, s_nationkey, s_acctbal, NULL FROM supplier UNION ALL SELECT n_name, n_nationkey, NULL, NULL FROM nation
""")
def u1(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_name AS name", "c_nationkey AS nationkey", "c_acctbal AS bal", "c_mktsegment AS segment")
    s = table(spark, sf, "supplier").selectExpr("s_name AS name", "s_nationkey AS nationkey", "s_acctbal AS bal")
    n = table(spark, sf, "nation").selectExpr("n_name AS name", "n_nationkey AS nationkey")
    return J.union_all([c, s, n])


@plan("U2_key_sets", """
SELECT 'both' AS part, c_nationkey AS nationkey FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'missing', n_nationkey FROM (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'docs', doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
""")
def u2(spark, sf):
    key = lambda t, c: table(spark, sf, t).select(F.col(c).cast("bigint").alias("nationkey"))
    tag = lambda d, p: d.select(F.lit(p).alias("part"), "nationkey")
    return J.union_all([
        tag(J.intersect_keys(key("customer", "c_nationkey"), key("supplier", "s_nationkey"), ["nationkey"]), "both"),
        tag(J.missing_keys(key("nation", "n_nationkey"), key("supplier", "s_nationkey"), "nationkey"), "missing"),
        tag(J.missing_keys(key("documents", "doc_id"), key("labels", "doc_id"), "nationkey"), "docs"),
    ])
