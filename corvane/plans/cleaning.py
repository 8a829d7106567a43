"""Queries for curation, audits, encodings and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import numeric as N, vectors as V
from corvane.functions.numeric import rounded
from corvane.operators import cleaning as C, splits
from corvane.plans import inputs
from corvane.plans.registry import plan, r6, table, text_table


def split_of(col):
    return F.when(F.col(col) % 10 < 8, "train").when(F.col(col) % 10 == 8, "valid").otherwise("test")


def split_sql(col):
    return f"CASE WHEN {col} % 10 < 8 THEN 'train' WHEN {col} % 10 = 8 THEN 'valid' ELSE 'test' END"


KEY_SQL = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"
DOC_SQL = f"docs AS (SELECT d.*, nullif({KEY_SQL}, '') AS key, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


def keyed(spark, sf):
    """Documents with the md5 of their normalised text as key.

    Blank texts go by a cheap pattern first: a null test on the key itself would
    be pushed below the projection and normalise every text twice.
    """
    d = C.valid_key(text_table(spark, sf, "documents"), "text")
    return d.select("doc_id", "source", F.md5(C.normalise_key("text")).alias("key_md5"))


@plan("P1_valid_key", "SELECT doc_id FROM documents WHERE trim(text) <> '' AND regexp_matches(text, '[A-Za-z]{3}')")
def p1(spark, sf):
    return C.valid_key(table(spark, sf, "documents"), "text", "[A-Za-z]{3}").select("doc_id")


@plan("P2_normalise_key", f"SELECT doc_id, md5({KEY_SQL}) AS key_md5 FROM documents WHERE {KEY_SQL} <> ''")
def p2(spark, sf):
    return keyed(spark, sf).drop("source")


@plan("P3_dedup_first", f"""
WITH {DOC_SQL}
SELECT doc_id, md5(key) AS key_md5, quality, source FROM
 (SELECT *, row_number() OVER (PARTITION BY key, quality, toxic ORDER BY doc_id) AS rn FROM docs WHERE key IS NOT NULL) WHERE rn = 1
""")
def p3(spark, sf):
    # the hash stands for the whole text as grouping key, so the shuffle moves 16 bytes, not documents
    d = keyed(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    return C.dedup_first(d, ["key_md5", "quality", "toxic"], "doc_id").drop("toxic")


@plan("P4_label_conflicts", f"""
WITH {DOC_SQL}
SELECT md5(key) AS key_md5, count(DISTINCT source) AS n_labels, count(*) AS n_rows
FROM docs WHERE key IS NOT NULL GROUP BY key HAVING count(DISTINCT source) > 1
""")
def p4(spark, sf):
    return C.label_conflicts(keyed(spark, sf), "key_md5", "source")


@plan("P5_dedup_key", f"WITH {DOC_SQL} SELECT md5(key) AS key_md5, min(doc_id) AS doc_id FROM docs WHERE key IS NOT NULL GROUP BY key")
def p5(spark, sf):
    return C.dedup_key(keyed(spark, sf).drop("source"), "key_md5", "doc_id")


@plan("P6_drop_missing", "SELECT doc_id, quality, toxic FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def p6(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return C.drop_missing(d, ["quality"])


@plan("P7_keep_labels", """
SELECT o_orderkey, lower(trim(o_orderpriority)) AS label FROM orders WHERE lower(trim(o_orderpriority)) IN ('1-urgent', '2-high', '5-low')
""")
def p7(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("label"))
    return C.keep_labels(o, "label", ["1-urgent", "2-high", "5-low"])


@plan("P8_select_role", "SELECT l_orderkey, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def p8(spark, sf):
    roles = C.Roles(key="l_orderkey", labels=("l_returnflag",), prefix="l_",
                    skip=("l_partkey", "l_suppkey", "l_linenumber", "l_linestatus", "l_shipdate"))
    return C.select_role(table(spark, sf, "lineitem"), roles)


@plan("P9_to_numeric", """
SELECT o_orderkey, try_cast(substr(o_orderpriority, 1, 1) AS double) AS level, try_cast(o_orderpriority AS double) AS whole FROM orders
""")
def p9(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.substring("o_orderpriority", 1, 1).alias("level"), F.col("o_orderpriority").alias("whole"))
    return C.to_numeric(o, ["level", "whole"])


DIRTY_SQL = """dirty AS (SELECT l_orderkey, l_partkey, l_returnflag,
  CASE l_linenumber WHEN 1 THEN 'NaN'::double WHEN 2 THEN 'Infinity'::double WHEN 3 THEN '-Infinity'::double
       WHEN 4 THEN l_extendedprice * 100 ELSE l_extendedprice END AS x FROM lineitem)"""


def dirty(spark, sf):
    n, x = F.col("l_linenumber"), F.col("l_extendedprice")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_returnflag",
        F.when(n == 1, float("nan")).when(n == 2, float("inf")).when(n == 3, float("-inf")).when(n == 4, x * 100).otherwise(x).alias("x"))


@plan("P10_sanitize_median", f"""
WITH {DIRTY_SQL}, ok AS (SELECT *, CASE WHEN isfinite(x) THEN x END AS y FROM dirty),
m AS (SELECT l_returnflag, quantile_cont(y, 0.5) AS med FROM ok GROUP BY 1)
SELECT l_orderkey, l_partkey, l_returnflag, {r6('greatest(-1e6, least(1e6, coalesce(y, med)))')} AS x FROM ok JOIN m USING (l_returnflag)
""")
def p10(spark, sf):
    return C.sanitize(dirty(spark, sf), ["x"], "median", by=["l_returnflag"]).withColumn("x", rounded("x"))


@plan("P11_sanitize_zero", f"""
WITH {DIRTY_SQL}
SELECT l_orderkey, l_partkey, l_returnflag, {r6('CASE WHEN isfinite(x) THEN greatest(-1e6, least(1e6, x)) ELSE 0 END')} AS clipped,
       {r6('CASE WHEN isfinite(x) THEN x ELSE 0 END')} AS plain FROM dirty
""")
def p11(spark, sf):
    d = dirty(spark, sf).withColumn("plain", F.col("x")).withColumnRenamed("x", "clipped")
    d = C.sanitize(C.sanitize(d, ["clipped"], 0.0), ["plain"], 0.0, limit=None)
    return d.withColumns({"clipped": rounded("clipped"), "plain": rounded("plain")})


@plan("P12_repair_vec", f"""
WITH d AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS dim, unnest(embedding)::double AS x FROM embeddings)
SELECT vec_id, dim, {r6('CASE WHEN (dim - 1) = vec_id % 64 THEN 0 WHEN (dim - 1) = (vec_id + 1) % 64 THEN 1e6 WHEN (dim - 1) = (vec_id + 2) % 64 THEN -1e6 ELSE x END')} AS value FROM d
""")
def p12(spark, sf):
    e = table(spark, sf, "embeddings")
    spoiled = F.transform(V.as_doubles("embedding"), lambda x, i: F.when(i == F.col("vec_id") % 64, float("nan"))
                          .when(i == (F.col("vec_id") + 1) % 64, float("inf"))
                          .when(i == (F.col("vec_id") + 2) % 64, float("-inf")).otherwise(x))
    return e.select("vec_id", F.posexplode(V.repair(spoiled)).alias("p", "x")).select(
        "vec_id", (F.col("p") + 1).cast("bigint").alias("dim"), rounded("x").alias("value"))


@plan("P13_audit_nonfinite", f"""
WITH {DIRTY_SQL}
SELECT 'x' AS "column", 'before' AS stage, 0::bigint AS n_null, count(*) FILTER (WHERE isnan(x)) AS n_nan, count(*) FILTER (WHERE isinf(x)) AS n_inf FROM dirty
UNION ALL SELECT 'x', 'after', 0, 0, 0
""")
def p13(spark, sf):
    d = dirty(spark, sf)
    return C.audit_nonfinite(d, ["x"], "before").unionByName(C.audit_nonfinite(C.sanitize(d, ["x"], 0.0), ["x"], "after"))


@plan("P14_log_targets", f"SELECT o_orderkey, {r6('ln(1 + o_totalprice)')} AS log_price, {r6('o_totalprice', 4)} AS back FROM orders")
def p14(spark, sf):
    o = table(spark, sf, "orders")
    log = N.log1p_target(F.col("o_totalprice"))
    return o.select("o_orderkey", rounded(log).alias("log_price"), rounded(N.expm1_target(log), 4).alias("back"))


@plan("P15_iqr_bounds", f"""
WITH e AS (SELECT event_type, value, {split_sql('event_id')} AS split FROM events),
q AS (SELECT event_type, quantile_cont(ln(1 + value), 0.25) AS q1, quantile_cont(ln(1 + value), 0.75) AS q3 FROM e WHERE split = 'train' GROUP BY 1),
b AS (SELECT event_type, exp(q1 - 1.5::double * (q3 - q1)) - 1 AS lo, exp(q3 + 1.5::double * (q3 - q1)) - 1 AS hi FROM q)
SELECT event_type, split, count(*) AS n_kept, {r6('any_value(lo)')} AS lo, {r6('any_value(hi)')} AS hi
FROM e JOIN b USING (event_type) WHERE value BETWEEN lo AND hi GROUP BY 1, 2
""")
def p15(spark, sf):
    e = table(spark, sf, "events").select("event_type", "value", split_of("event_id").alias("split"))
    bounds = C.iqr_bounds(e.where("split = 'train'"), ["event_type"], "value")
    kept = C.apply_bounds(e, bounds, ["event_type"], "value")
    return kept.groupBy("event_type", "split").agg(
        F.count("*").alias("n_kept"), rounded(F.first("lo")).alias("lo"), rounded(F.first("hi")).alias("hi"))


@plan("P16_encode_labels", f"""
WITH c AS (SELECT p_type, (dense_rank() OVER (ORDER BY p_type) - 1)::int AS code FROM
  (SELECT DISTINCT p_type FROM part WHERE p_partkey % 10 < 8 AND p_type <> 'PROMO'))
SELECT p_partkey, p_type, code FROM part LEFT JOIN c USING (p_type)
""")
def p16(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_type")
    fit = p.where((F.col("p_partkey") % 10 < 8) & (F.col("p_type") != "PROMO"))  # the train split, one class unseen
    return C.encode_labels(p, "p_type", "code", fit_on=fit)


@plan("P17_one_hot", """
SELECT doc_id, concat((lang = 'en')::int, (lang = 'fr')::int, (lang NOT IN ('en', 'fr'))::int) AS flags FROM documents
""")
def p17(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.concat_ws("", C.one_hot("lang", ["en", "fr"]).cast("array<string>")).alias("flags"))


@plan("P18_predict_class", f"""
WITH {inputs.BINARY_SQL}, {inputs.MULTI_SQL}
SELECT 'binary' AS task, model, seed, row_id, (score >= 0.5)::int AS pred FROM binary_rows
UNION ALL SELECT 'multi', 0, 0, row_id, (list_position(proba, list_max(proba)) - 1)::int FROM multi_rows
""")
def p18(spark, sf):
    b = inputs.binary_rows(spark, sf).select(F.lit("binary").alias("task"), "model", "seed", "row_id", (F.col("score") >= 0.5).cast("int").alias("pred"))
    m = inputs.multi_rows(spark, sf).select(F.lit("multi").alias("task"), F.lit(0).alias("model"), F.lit(0).alias("seed"), "row_id", N.argmax(F.col("proba")).alias("pred"))
    return b.unionByName(m)


@plan("P19_slice_vec", f"""
SELECT vec_id, {r6('list_sum(embedding[1:16]::double[])')} AS head, {r6('list_sum(embedding[17:]::double[])')} AS tail,
       {r6('list_sum(embedding::double[])')} AS whole FROM embeddings
""")
def p19(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("v", V.as_doubles("embedding"))
    total = lambda c: rounded(F.aggregate(c, F.lit(0.0), lambda a, x: a + x))
    return e.select("vec_id", total(V.slice_vec(F.col("v"), 0, 16)).alias("head"),
                    total(F.slice("v", 17, F.size("v"))).alias("tail"), total(F.col("v")).alias("whole"))


@plan("P20_filter_configs", """
SELECT DISTINCT c_mktsegment AS emb, o_orderstatus AS tree FROM orders JOIN customer ON c_custkey = o_custkey
WHERE NOT (c_mktsegment = 'BUILDING' OR (c_mktsegment = 'MACHINERY' AND o_orderstatus = 'F'))
  AND (o_orderstatus IN ('F', 'O') AND c_mktsegment IN ('MACHINERY') OR c_mktsegment IN ('HOUSEHOLD', 'BUILDING'))
""")
def p20(spark, sf):
    cfg = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_mktsegment").alias("emb"), F.col("o_orderstatus").alias("tree")).distinct()
    return C.filter_configs(cfg, "emb", "tree", skip=["BUILDING", "MACHINERY:F"],
                            only=["MACHINERY:F", "MACHINERY:O", "HOUSEHOLD", "BUILDING"])


@plan("P21_grid", """
SELECT arm, seed, model FROM (SELECT DISTINCT o_orderpriority AS arm FROM orders),
 (SELECT unnest([42, 43, 44, 45, 46]) AS seed), (SELECT unnest(['gbt', 'rf', 'linear']) AS model)
""")
def p21(spark, sf):
    arms = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("arm")).distinct()
    return C.grid(arms, [42, 43, 44, 45, 46], ["gbt", "rf", "linear"])


@plan("A1_class_stats", f"""
WITH l AS (SELECT quality, toxic FROM documents LEFT JOIN labels USING (doc_id)), n AS (SELECT count(*) AS t FROM l)
SELECT 'quality' AS label, quality AS class, count(*) AS n, {r6('count(*) * 100.0::double / any_value(t)')} AS pct FROM l, n GROUP BY quality
UNION ALL SELECT 'toxic', toxic, count(*), {r6('count(*) * 100.0::double / any_value(t)')} FROM l, n GROUP BY toxic
""")
def a1(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return C.class_stats(d, "quality").unionByName(C.class_stats(d, "toxic")).withColumn("pct", rounded("pct"))


@plan("A2_value_stats", f"""
SELECT o_orderpriority, {r6('avg(o_totalprice)', 3)} AS mean, {r6('stddev_samp(o_totalprice)', 3)} AS std,
       min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders GROUP BY 1
""")
def a2(spark, sf):
    return C.value_stats(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice").withColumns(
        {"mean": rounded("mean", 3), "std": rounded("std", 3)})


@plan("A3_audit", f"""
WITH {DOC_SQL}, s AS (SELECT *, {split_sql('doc_id')} AS split FROM docs),
valid AS (SELECT * FROM s WHERE regexp_matches(text, '[A-Za-z]{{3}}')),
uniq AS (SELECT split, key FROM valid GROUP BY 1, 2),
c AS (SELECT split, count(*) AS n_raw, (SELECT count(*) FROM valid v WHERE v.split = s.split) AS n_valid,
   (SELECT count(*) FROM uniq u WHERE u.split = s.split) AS n_dedup FROM s GROUP BY split)
SELECT split, n_raw, n_valid, n_dedup, n_raw - n_valid AS removed_valid, n_valid - n_dedup AS removed_dedup FROM c
""")
def a3(spark, sf):
    raw = text_table(spark, sf, "documents").withColumn("split", split_of("doc_id"))
    valid = C.valid_key(raw, "text", "[A-Za-z]{3}")
    dedup = C.dedup_first(valid.select("doc_id", "split", F.md5(C.normalise_key("text")).alias("k")), ["split", "k"], "doc_id")
    return C.audit({"raw": raw, "valid": valid, "dedup": dedup}, ["split"])


@plan("A13_class_weights", f"""
WITH c AS (SELECT quality AS label, count(*)::double AS n_c FROM labels GROUP BY 1),
t AS (SELECT sum(n_c) AS n, count(*) AS k, sum(1 / n_c) AS inv, sum(n_c) FILTER (WHERE label = 0) AS neg, sum(n_c) FILTER (WHERE label = 1) AS pos FROM c)
SELECT 'balanced' AS mode, label, {r6('n / (k * n_c)')} AS weight FROM c, t
UNION ALL SELECT 'complement', label, {r6('1 - n_c / n')} FROM c, t
UNION ALL SELECT 'inverse', label, {r6('1 / n_c / inv * k')} FROM c, t
UNION ALL SELECT 'neg_pos', label, {r6('CASE WHEN label = 1 THEN neg / pos ELSE 1 END')} FROM c, t
""")
def a13(spark, sf):
    from functools import reduce
    l = table(spark, sf, "labels").withColumnRenamed("quality", "label")
    parts = [C.class_weights(l, "label", m).select(F.lit(m).alias("mode"), "label", rounded("weight").alias("weight"))
             for m in ("balanced", "complement", "inverse", "neg_pos")]
    return reduce(lambda a, b: a.unionByName(b), parts)


@plan("M1_group_split", """
WITH RECURSIVE g AS (SELECT source || '/' || lang AS grp, count(*) AS size, min(doc_id) AS first FROM documents GROUP BY 1),
o AS (SELECT grp, size, row_number() OVER (ORDER BY size DESC, first) AS pos FROM g),
n AS (SELECT count(*) AS n FROM documents),
fill AS (
  SELECT 0::bigint AS pos, ''::varchar AS grp, 0::bigint AS t, 0::bigint AS v, ''::varchar AS split
  UNION ALL
  SELECT o.pos, o.grp,
    CASE WHEN t + size <= n * 0.8::double THEN t + size ELSE t END,
    CASE WHEN t + size > n * 0.8::double AND t + v + size <= n * (0.8::double + 0.1::double) THEN v + size ELSE v END,
    CASE WHEN t + size <= n * 0.8::double THEN 'train' WHEN t + v + size <= n * (0.8::double + 0.1::double) THEN 'valid' ELSE 'test' END
  FROM fill JOIN o ON o.pos = fill.pos + 1, n)
SELECT doc_id, d.source || '/' || d.lang AS grp, split FROM documents d JOIN fill f ON f.grp = d.source || '/' || d.lang
""")
def m1(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("grp"))
    return splits.group_split(d, "grp", "doc_id").select("doc_id", "grp", "split")


@plan("M2_folds", """
WITH h AS (SELECT doc_id, quality, concat('0x', substr(md5('42:' || doc_id), 1, 15))::bigint AS h FROM labels)
SELECT doc_id, ((row_number() OVER (ORDER BY h, doc_id) - 1) % 5)::int AS plain,
       ((row_number() OVER (PARTITION BY quality ORDER BY h, doc_id) - 1) % 5)::int AS stratified FROM h
""")
def m2(spark, sf):
    l = table(spark, sf, "labels").select("doc_id", "quality")
    plain = splits.folds(l, "doc_id").select("doc_id", F.col("fold").alias("plain"))
    strat = splits.folds(l, "doc_id", strata=["quality"]).select("doc_id", F.col("fold").alias("stratified"))
    return plain.join(strat, "doc_id")
