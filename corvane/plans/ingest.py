"""Queries for sources and sinks. Files are written by Spark from the given tables into the shared folder, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions.numeric import rounded
from corvane.plans import inputs
from corvane.plans.cleaning import split_of, split_sql
from corvane.plans.registry import plan, r6, table
from corvane.session import new_path
from corvane.sources import logs, readers, sinks

ORDER_SCHEMA = "o_orderkey bigint, o_totalprice double, o_orderpriority string"
SPLITS = ["train", "valid", "test"]


def _split_files(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", split_of("o_orderkey").alias("split"))
    root = new_path(spark, "splits")
    o.write.partitionBy("split").option("header", True).csv(root)
    return root


@plan("S1_read_splits", f"SELECT o_orderkey, o_totalprice, o_orderpriority, {split_sql('o_orderkey')} AS split FROM orders")
def s1(spark, sf):
    root = _split_files(spark, sf)
    return readers.read_splits(spark, {s: f"{root}/split={s}" for s in SPLITS}, ORDER_SCHEMA)


@plan("S2_read_aliased", """
SELECT p_partkey AS id, '"' || p_name || '"' AS entity, p_retailprice AS y FROM part UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier
""")
def s2(spark, sf):
    aliases = {"Drug_ID": "id", "ID": "id", "Drug": "entity", "X": "entity", "Y": "y"}
    types = {"id": "bigint", "entity": "string", "y": "double"}
    tsv = lambda d, p: d.write.option("header", True).option("sep", "\t").option("escape", '"').option("quoteAll", True).csv(p) or p
    quoted = F.concat(F.lit('"'), F.col("p_name"), F.lit('"')).alias("Drug")
    a = tsv(table(spark, sf, "part").select(F.col("p_partkey").alias("Drug_ID"), quoted, F.col("p_retailprice").alias("Y")), new_path(spark, "a"))
    b = tsv(table(spark, sf, "supplier").selectExpr("s_suppkey AS ID", "s_name AS X", "s_acctbal AS Y"), new_path(spark, "b"))
    return readers.read_aliased(spark, a, aliases, types).unionByName(readers.read_aliased(spark, b, aliases, types))


@plan("S3_read_if_exists", f"""
SELECT s.split, CASE WHEN s.split = 'holdout' THEN 'missing' ELSE 'read' END AS status, count(o_orderkey) AS n
FROM (SELECT unnest(['train', 'valid', 'test', 'holdout']) AS split) s LEFT JOIN (SELECT *, {split_sql('o_orderkey')} AS split FROM orders) USING (split) GROUP BY 1
""")
def s3(spark, sf):
    root = _split_files(spark, sf)
    data, status = readers.read_if_exists(spark, {s: f"{root}/split={s}" for s in [*SPLITS, "holdout"]}, ORDER_SCHEMA)
    n = data.groupBy("split").agg(F.count("*").alias("n"))
    return status.join(n, "split", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def metric_rows(spark, sf):
    return inputs.binary_rows(spark, sf).groupBy("lang", "model", "seed").agg(
        rounded(F.avg((F.col("y") == F.col("pred")).cast("double"))).alias("Accuracy"), F.count("*").alias("n_test"))


METRIC_SQL = f"""{inputs.BINARY_SQL}, metric_rows AS (SELECT lang, model, seed, {r6('avg((y = pred)::int)')} AS "Accuracy", count(*) AS n_test FROM binary_rows GROUP BY ALL)"""


@plan("S4_scan_metrics", f'WITH {METRIC_SQL} SELECT lang AS dataset, model::varchar AS model, seed, "Accuracy", n_test FROM metric_rows')
def s4(spark, sf):
    root = new_path(spark, "metrics")
    metric_rows(spark, sf).write.partitionBy("lang", "model").json(root)
    return readers.scan_metrics(spark, root, "seed int, Accuracy double, n_test bigint", ["dataset", "model"]).drop("stem")


@plan("S5_parse_stem", """
SELECT c_custkey, c_mktsegment || '_' || c_mktsegment || '_m' || c_nationkey AS stem, 'm' || c_nationkey AS model FROM customer
""")
def s5(spark, sf):
    c = table(spark, sf, "customer").withColumn(
        "stem", F.concat("c_mktsegment", F.lit("_"), "c_mktsegment", F.lit("_m"), F.col("c_nationkey").cast("string")))
    return c.select("c_custkey", "stem", readers.parse_stem(F.col("stem"), F.col("c_mktsegment")).alias("model"))


@plan("S6_attach_ci", f"""
WITH {inputs.CELL_SQL},
s AS (SELECT dataset, tree, avg(test) AS test, avg(cv) AS cv, stddev_pop(test) AS st, stddev_pop(cv) AS sc FROM cells GROUP BY 1, 2)
SELECT dataset, tree, {r6('test')} AS test, {r6('cv')} AS cv, {r6('st')} AS test_se, {r6('test - 1.96::double * st')} AS test_ci_lo, {r6('test + 1.96::double * st')} AS test_ci_hi,
  CASE WHEN tree <> 'P' THEN {r6('sc')} END AS cv_se, CASE WHEN tree <> 'P' THEN {r6('cv - 1.96::double * sc')} END AS cv_ci_lo, CASE WHEN tree <> 'P' THEN {r6('cv + 1.96::double * sc')} END AS cv_ci_hi FROM s
""")
def s6(spark, sf):
    long = inputs.cells(spark, sf).select("dataset", "tree", F.inline(F.array(
        F.struct(F.lit("test").alias("metric"), F.col("test").alias("v")), F.struct(F.lit("cv").alias("metric"), F.col("cv").alias("v")))))
    ci = long.groupBy("dataset", "tree", "metric").agg(F.avg("v").alias("point"), F.stddev_pop("v").alias("se"))
    ci = ci.withColumns({"ci_lo": F.col("point") - 1.96 * F.col("se"), "ci_hi": F.col("point") + 1.96 * F.col("se")})
    metrics = ci.groupBy("dataset", "tree").pivot("metric", ["test", "cv"]).agg(F.first("point"))
    side = ci.where(~((F.col("tree") == "P") & (F.col("metric") == "cv")))  # one interval file is absent
    out = readers.attach_ci(metrics, side, ["dataset", "tree"], ["test", "cv"])
    return out.select("dataset", "tree", *[rounded(c).alias(c) for c in out.columns if c not in ("dataset", "tree")])


@plan("S7_extract_text_tables", r"""
SELECT o_custkey AS doc, c_mktsegment AS label, o_orderkey::varchar AS "order", o_totalprice AS price FROM orders JOIN customer ON c_custkey = o_custkey
""")
def s7(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    has = o.select(F.col("o_custkey").alias("c_custkey")).distinct()
    head = c.join(has, "c_custkey", "left_semi").select(F.col("c_custkey").alias("doc"), F.inline(F.array(
        F.struct(F.lit(0).cast("bigint").alias("line_no"), F.concat(F.lit(r"\label{tab:"), "c_mktsegment", F.lit("}")).alias("line")),
        F.struct(F.lit(1).cast("bigint").alias("line_no"), F.lit(r"Order & Price \\").alias("line")),
        F.struct(F.lit(2).cast("bigint").alias("line_no"), F.lit(r"\midrule").alias("line")))))
    body = o.select(F.col("o_custkey").alias("doc"), (F.col("o_orderkey") + 3).alias("line_no"), F.concat(
        F.lit(r"\textbf{"), F.col("o_orderkey").cast("string"), F.lit("} & $"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(r"$ \\")).alias("line"))
    cells = logs.extract_text_tables(head.unionByName(body), r"\\label\{tab:(\w+)\}", r"^Order &", r"&.*\\\\$")
    return cells.groupBy("doc", "line_no", "label").agg(
        F.max(F.when(F.col("column") == "Order", F.col("value"))).alias("order"),
        F.max(F.when(F.col("column") == "Price", F.col("number"))).alias("price")).drop("line_no")


def log_lines(spark, sf):
    """A log per hundred users: one line per event, in time order; every seventh line lacks its timestamp."""
    e = table(spark, sf, "events")
    stamp = F.when(F.col("event_id") % 7 != 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("  ...")
    kind = F.when(F.col("event_type") == "signup", F.lit("Block start")).otherwise(F.col("event_type"))
    return e.select((F.col("user_id") % 100).alias("log"), F.col("event_id").alias("line_no"),
                    F.concat(stamp, F.lit(" | INFO | "), kind, F.lit(" dataset=u"), F.col("user_id").cast("string")).alias("line"))


LOG_SQL = """log AS (SELECT user_id % 100 AS log, event_id AS line_no, CASE WHEN event_id % 7 <> 0 THEN date_trunc('second', ts) END AS ts,
  'u' || user_id AS dataset, event_type = 'signup' AS is_marker FROM events)"""


@plan("S8_parse_log", f"WITH {LOG_SQL} SELECT log, line_no, ts, dataset, is_marker FROM log")
def s8(spark, sf):
    return logs.parse_log(log_lines(spark, sf), "Block start", "dataset").drop("line")


@plan("S9_write_splits", f"SELECT event_type AS dataset, {split_sql('event_id')} AS split, count(*) AS n FROM events GROUP BY 1, 2")
def s9(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("dataset"), split_of("event_id").alias("split"), "event_id", "value")
    return spark.read.parquet(sinks.write_splits(e, new_path(spark, "events"))).groupBy("dataset", "split").agg(F.count("*").alias("n"))


@plan("S10_manifest", f"""
WITH m AS (SELECT event_type AS dataset, count(*) FILTER (WHERE s = 'train') AS n_train, count(*) FILTER (WHERE s = 'valid') AS n_valid, count(*) FILTER (WHERE s = 'test') AS n_test
           FROM (SELECT event_type, {split_sql('event_id')} AS s FROM events) GROUP BY 1),
old AS (SELECT lang AS dataset, count(*) AS n_train, 0::bigint AS n_valid, 0::bigint AS n_test FROM documents GROUP BY 1
        UNION ALL SELECT DISTINCT event_type, 1, 1, 1 FROM events)
SELECT * FROM m UNION ALL SELECT * FROM old WHERE dataset NOT IN (SELECT dataset FROM m)
""")
def s10(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("dataset"), split_of("event_id").alias("split"))
    new = sinks.manifest(e, "dataset", "split", SPLITS)
    old = table(spark, sf, "documents").groupBy(F.col("lang").alias("dataset")).agg(F.count("*").alias("n_train")).select(
        "dataset", "n_train", F.lit(0).cast("bigint").alias("n_valid"), F.lit(0).cast("bigint").alias("n_test"))
    # entries of an earlier run for the same datasets, to be replaced
    stale = e.select("dataset").distinct().select("dataset", *[F.lit(1).cast("bigint").alias(f"n_{s}") for s in SPLITS])
    return sinks.upsert_by_key(old.unionByName(stale), new, ["dataset"])


@plan("S11_upsert_by_key", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 1)
UNION ALL SELECT l_orderkey, max(l_extendedprice) FROM lineitem WHERE l_quantity = 1 GROUP BY 1
""")
def s11(spark, sf):
    old = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    new = table(spark, sf, "lineitem").where("l_quantity = 1").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("o_totalprice"))
    return sinks.upsert_by_key(old, new, ["o_orderkey"])


@plan("S12_pending", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def s12(spark, sf):
    done = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return sinks.pending(table(spark, sf, "orders").select("o_orderkey"), done, ["o_orderkey"])


@plan("S13_unify_results", f"""
WITH {inputs.CONFIG_SQL}, u AS (
 SELECT dataset, emb || '-' || tree AS model, test AS "MCC", NULL::double AS "Spearman", NULL::double AS "AUPR" FROM configs WHERE tree = 'F'
 UNION ALL SELECT dataset, emb || '-' || tree, test, NULL, cv FROM configs WHERE tree = 'O'
 UNION ALL SELECT dataset, emb || '-' || tree, NULL, test, NULL FROM configs WHERE tree = 'P')
SELECT dataset, model, {r6('"MCC"')} AS "MCC", {r6('"Spearman"')} AS "Spearman", {r6('"AUPR"')} AS "AUPR", split_part(model, '-', 1) AS family FROM u
""")
def s13(spark, sf):
    c = inputs.configs(spark, sf).withColumn("name", F.concat_ws("-", "emb", "tree"))
    a = c.where("tree = 'F'").select("dataset", F.col("name").alias("Model"), F.col("test").alias("MCC"))
    b = c.where("tree = 'O'").select("dataset", F.col("name").alias("Configuration"), F.col("test").alias("MCC"), F.col("cv").alias("AUPR"))
    d = c.where("tree = 'P'").select("dataset", F.col("name").alias("Configuration"), F.col("test").alias("Spearman"))
    out = readers.unify_results([a, b, d], [{"Model": "model"}, {"Configuration": "model"}, {"Configuration": "model"}], "family", r"^(\w+)-")
    return out.withColumns({m: rounded(m) for m in ("MCC", "Spearman", "AUPR")})


@plan("S14_write_predictions", f"WITH {inputs.BINARY_SQL} SELECT lang AS exp, model AS cfg, count(*) AS n, sum(pred)::bigint AS n_pos FROM binary_rows GROUP BY 1, 2")
def s14(spark, sf):
    path = new_path(spark, "predictions")
    sinks.write_predictions(inputs.binary_rows(spark, sf).withColumnsRenamed({"lang": "exp", "model": "cfg"}), path)
    return spark.read.parquet(path).groupBy("exp", "cfg").agg(F.count("*").alias("n"), F.sum("pred").alias("n_pos"))


@plan("S15_changed_rows", """
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT p_partkey AS k, p_name AS name, p_size AS size FROM part WHERE p_partkey % 11 <> 0) a
FULL JOIN (SELECT p_partkey AS k, p_name AS name, CASE WHEN p_size > 40 THEN p_size + 1 ELSE p_size END AS size FROM part WHERE p_partkey % 13 <> 0) b ON a.k = b.k
WHERE a.k IS NULL OR b.k IS NULL OR a.name <> b.name OR a.size <> b.size
""")
def s15(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    # two versions of the table: each lacks some rows, and large sizes differ
    a = p.where("k % 11 <> 0")
    b = p.where("k % 13 <> 0").withColumn("size", F.when(F.col("size") > 40, F.col("size") + 1).otherwise(F.col("size")))
    return sinks.changed_rows(a, b, ["k"], ["name", "size"])
