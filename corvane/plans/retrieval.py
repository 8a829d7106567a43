"""Queries for top-k joins and neighbourhood features."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import vectors as V
from corvane.functions.numeric import rounded
from corvane.operators import context, retrieval
from corvane.plans import inputs
from corvane.plans.inputs import PROPS, VEC_SQL, bits_sql
from corvane.plans.registry import plan, r6, table
from corvane.session import cut_lineage


def _round_all(df, keys):
    return df.select(*keys, *[rounded(c).alias(c) for c in df.columns if c not in keys])


def profile_sql(props, ks):
    out = []
    for p in props:
        for k in ks:
            f = f"FILTER (WHERE rank <= {k})"
            out += [
                f"{r6(f'avg({p}) {f}')} AS {p}_mean_k{k}",
                f"{r6(f'stddev_pop({p}) {f}')} AS {p}_std_k{k}",
                f"{r6(f'sum({p} * greatest(sim, 0.0::double)) {f} / (sum(greatest(sim, 0.0::double)) {f} + 1e-9::double)')} AS {p}_wmean_k{k}",
            ]
    return ", ".join(out)


def density_sql(ks):
    out = [f"{r6('max(sim) FILTER (WHERE rank = 1)')} AS nearest_sim"]
    for k in ks:
        f = f"FILTER (WHERE rank <= {k})"
        out += [f"{r6(f'avg(sim) {f}')} AS k{k}_sim_mean", f"{r6(f'stddev_pop(sim) {f}')} AS k{k}_sim_std"]
    return ", ".join(out)


@plan("neighbour_profile", f"""
WITH {VEC_SQL}
SELECT query_id, {profile_sql(PROPS, [10, 20])}, {density_sql([10, 20])} FROM nb GROUP BY query_id
""")
def neighbour_profile(spark, sf):
    return _round_all(context.profile_and_density(inputs.neighbours(spark, sf), PROPS), ["query_id"])


@plan("J8_topk_cosine", f"WITH {VEC_SQL} SELECT query_id, rank, lib_id, {r6('sim')} AS sim FROM nb")
def topk_cosine(spark, sf):
    q, lib = inputs.queries_and_library(spark, sf)
    hits = retrieval.topk_cosine(q, lib, 20, exclude_self=True)
    return hits.select("query_id", F.col("rank").cast("bigint").alias("rank"), "lib_id", rounded("sim").alias("sim"))


DOC_BENCH = f"""
{bits_sql('documents', 'doc_id', 'query_id')}, {bits_sql('benchmark', 'item_id', 'lib_id')},
inv AS (SELECT lib_id, unnest(b) AS bit FROM bits_lib_id),
shared AS (SELECT q.query_id, inv.lib_id, count(*) AS n
           FROM (SELECT query_id, unnest(b) AS bit FROM bits_query_id) q JOIN inv USING (bit) GROUP BY ALL),
tan AS (SELECT q.query_id, l.lib_id,
               coalesce(s.n, 0)::double / greatest(len(q.b) + len(l.b) - coalesce(s.n, 0), 1) AS sim
        FROM bits_query_id q CROSS JOIN bits_lib_id l LEFT JOIN shared s ON s.query_id = q.query_id AND s.lib_id = l.lib_id)
"""


def _doc_bench(spark, sf):
    q = inputs.fingerprints(spark, sf, "documents", "doc_id", "query_id")
    lib = inputs.fingerprints(spark, sf, "benchmark", "item_id", "lib_id")
    return q, lib


@plan("J9_topk_tanimoto", f"""
WITH {DOC_BENCH}
SELECT query_id, rank, lib_id, {r6('sim')} AS sim
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, lib_id) AS rank FROM tan) WHERE rank <= 10
""")
def topk_tanimoto(spark, sf):
    hits = retrieval.topk_tanimoto(*_doc_bench(spark, sf), k=10)
    return hits.select("query_id", F.col("rank").cast("bigint").alias("rank"), "lib_id", rounded("sim").alias("sim"))


# Hybrid retrieval needs a vector and a fingerprint on one row: the fingerprint of an embedding is the set of
# 256 bits named by its entries' two-decimal roundings.
def _signed_bits(vec):
    return F.array_sort(F.array_distinct(F.transform(
        V.as_doubles(vec), lambda x, i: (F.floor(x * 100.0) + 128 + i * 3).cast("bigint") % 256)))


HYBRID_SQL = f"""
{VEC_SQL.rsplit('nb AS', 1)[0]}
bits AS (SELECT vec_id, list_distinct(list_transform(range(1, len(e) + 1),
            lambda i: (floor(e[i] * 100.0::double)::bigint + 128 + (i - 1) * 3) % 256)) AS b FROM v),
both_s AS (SELECT s.query_id, s.lib_id, s.sim AS cos, len(list_intersect(a.b, c.b)) AS n, len(a.b) AS na, len(c.b) AS nc
         FROM scored s JOIN bits a ON a.vec_id = s.query_id JOIN bits c ON c.vec_id = s.lib_id),
tan AS (SELECT *, n::double / greatest(na + nc - n, 1) AS tan FROM both_s),
z AS (SELECT query_id, lib_id,
        (cos - avg(cos) OVER w) / (stddev_samp(cos) OVER w + 1e-9::double)
      + (tan - avg(tan) OVER w) / (stddev_samp(tan) OVER w + 1e-9::double) AS sim
      FROM tan WINDOW w AS (PARTITION BY query_id))
"""


@plan("J10_topk_hybrid", f"""
WITH {HYBRID_SQL}
SELECT query_id, rank, lib_id, {r6('sim')} AS sim
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, lib_id) AS rank FROM z) WHERE rank <= 20
""")
def topk_hybrid(spark, sf):
    q, lib = inputs.queries_and_library(spark, sf)
    fp = lambda d: d.withColumn("fp", V.pack_bits(_signed_bits(F.col("vec")), 256))
    hits = retrieval.topk_hybrid(fp(q), fp(lib), 20, exclude_self=True)
    return hits.select("query_id", F.col("rank").cast("bigint").alias("rank"), "lib_id", rounded("sim").alias("sim"))


@plan("J11_topk_random", """
WITH lib AS (SELECT vec_id AS lib_id, row_number() OVER (ORDER BY vec_id) - 1 AS idx FROM embeddings),
n AS (SELECT count(*) AS m FROM embeddings),
drawn AS (SELECT vec_id AS query_id, list_reduce(range(m - 20, m), lambda acc, j: list_append(acc,
   CASE WHEN list_contains(acc, concat('0x', substr(md5('7:' || vec_id || ':' || j), 1, 15))::bigint % (j + 1)) THEN j
        ELSE concat('0x', substr(md5('7:' || vec_id || ':' || j), 1, 15))::bigint % (j + 1) END), []::bigint[]) AS pos
   FROM embeddings, n),
long AS (SELECT query_id, unnest(range(1, 21)) AS rank, unnest(pos) AS idx FROM drawn)
SELECT query_id, rank, lib_id FROM long JOIN lib USING (idx)
""")
def topk_random(spark, sf):
    e = table(spark, sf, "embeddings")
    hits = retrieval.topk_random(
        e.select(F.col("vec_id").alias("query_id")), e.select(F.col("vec_id").alias("lib_id")), k=20, seed=7)
    return hits.select("query_id", F.col("rank").cast("bigint").alias("rank"), "lib_id")


@plan("J12_gather", f"""
WITH {VEC_SQL} SELECT query_id, rank, lib_id, {r6('price')} AS price, size, name_len, lib_group FROM nb
""")
def gather(spark, sf):
    nb = inputs.neighbours(spark, sf)
    return nb.select("query_id", F.col("rank").cast("bigint").alias("rank"), "lib_id", rounded("price").alias("price"),
                     "size", "name_len", "lib_group")


@plan("N1_profile", f"WITH {VEC_SQL} SELECT query_id, {profile_sql(PROPS, [10, 20])} FROM nb GROUP BY query_id")
def n1(spark, sf):
    return _round_all(context.profile(inputs.neighbours(spark, sf), PROPS), ["query_id"])


@plan("N2_density", f"WITH {VEC_SQL} SELECT query_id, {density_sql([10, 20])} FROM nb GROUP BY query_id")
def n2(spark, sf):
    return _round_all(context.density(inputs.neighbours(spark, sf)), ["query_id"])


CENTROID_SQL = f"""
{VEC_SQL},
dims AS (SELECT query_id, unnest(range(1, len(le) + 1)) AS d, unnest(le) AS x FROM nb WHERE rank <= 10),
cent AS (SELECT query_id, d, avg(x) AS c FROM dims GROUP BY query_id, d)
"""


@plan("N3_centroid", f"WITH {CENTROID_SQL} SELECT query_id, d AS dim, {r6('c')} AS value FROM cent")
def n3(spark, sf):
    nb = inputs.neighbours(spark, sf).withColumn("vec", V.l2_normalise(V.as_doubles("vec")))
    c = context.centroid(nb)
    return c.select("query_id", F.posexplode("centroid").alias("p", "x")).select(
        "query_id", (F.col("p") + 1).cast("bigint").alias("dim"), rounded("x").alias("value"))


@plan("N4_centroid_stats", f"""
WITH {CENTROID_SQL},
cl AS (SELECT query_id, list(c ORDER BY d) AS c FROM cent GROUP BY query_id),
j AS (SELECT nb.query_id, qe, le, c FROM nb JOIN cl USING (query_id) WHERE rank <= 10)
SELECT query_id, {r6('any_value(list_dot_product(qe, c) / (sqrt(list_dot_product(c, c)) + 1e-9::double))')} AS sim_to_centroid,
       {r6('avg(list_distance(le, c))')} AS centroid_spread
FROM j GROUP BY query_id
""")
def n4(spark, sf):
    q, _ = inputs.queries_and_library(spark, sf)
    nb = inputs.neighbours(spark, sf).withColumn("vec", V.l2_normalise(V.as_doubles("vec")))
    return _round_all(context.centroid_stats(q, nb).drop("centroid"), ["query_id"])


STRUCT_SQL = f"""
{VEC_SQL},
bits AS (SELECT vec_id, list_distinct(list_transform(range(1, len(e) + 1),
            lambda i: (floor(e[i] * 100.0::double)::bigint + 128 + (i - 1) * 3) % 256)) AS b FROM v),
fs AS (SELECT nb.query_id, rank, query_group, lib_group,
         len(list_intersect(a.b, c.b))::double / greatest(len(a.b) + len(c.b) - len(list_intersect(a.b, c.b)), 1) AS fp_sim
       FROM nb JOIN bits a ON a.vec_id = nb.query_id JOIN bits c ON c.vec_id = nb.lib_id)
"""


@plan("N6_structure", f"""
WITH {STRUCT_SQL}
SELECT query_id, {r6('max(fp_sim) FILTER (WHERE rank = 1)')} AS fp_sim_k1,
       {r6('avg(fp_sim) FILTER (WHERE rank <= 5)')} AS fp_sim_k5_mean,
       {r6('avg(CASE WHEN query_group = lib_group THEN 1.0::double ELSE 0.0::double END) FILTER (WHERE rank <= 10)')} AS same_group_frac_k10
FROM fs GROUP BY query_id
""")
def n6(spark, sf):
    q, _ = inputs.queries_and_library(spark, sf)
    bits = V.pack_bits(_signed_bits(F.col("vec")), 256)
    nb = inputs.neighbours(spark, sf).withColumn("l_fp", bits).drop("vec")
    both = nb.join(q.select("query_id", "query_group", bits.alias("q_fp")), "query_id")
    both = both.withColumn("fp_sim", V.tanimoto(F.col("q_fp"), F.col("l_fp")))
    return _round_all(context.structure(both), ["query_id"])


def _single_sql(k):
    return f"SELECT {k} AS k, query_id, " + (profile_sql(inputs.PROPS, [k]) + ", " + density_sql([k])).replace(
        f"_k{k}", "").replace(f"AS k{k}_", "AS ") + " FROM nbk GROUP BY query_id"


KS = [1, 5, 10, 20, 50, 100]


@plan("N7_single_k", f"""
WITH {VEC_SQL.replace('rank <= 20', 'rank <= 100').replace('nb AS', 'nbk AS')}
{' UNION ALL '.join(_single_sql(k) for k in KS)}
""")
def n7(spark, sf):
    nb = inputs.neighbours(spark, sf, k=max(KS)).select("query_id", "rank", "sim", *inputs.PROPS)
    # one retrieval at the largest k serves the whole sweep: each neighbour feeds every k it belongs to
    long = nb.withColumn("k", F.explode(F.array(*[F.lit(k) for k in KS]))).where(F.col("rank") <= F.col("k"))
    w = F.greatest(F.col("sim"), F.lit(0.0))
    per = [c for p in inputs.PROPS for c in (
        F.avg(p).alias(f"{p}_mean"), F.stddev_pop(p).alias(f"{p}_std"), (F.sum(F.col(p) * w) / (F.sum(w) + 1e-9)).alias(f"{p}_wmean"))]
    out = long.groupBy("k", "query_id").agg(
        *per,
        F.max(F.when(F.col("rank") == 1, F.col("sim"))).alias("nearest_sim"),
        F.avg("sim").alias("sim_mean"), F.stddev_pop("sim").alias("sim_std"))
    return _round_all(out, ["k", "query_id"])


@plan("N7_single_k_groups")
def n7_groups(spark, sf):
    """The sweep with all four groups, one array per group; N7_single_k has the columns of its SQL (groups A and B)."""
    from corvane.plans.models import sweep

    out = None
    for k, f in sweep(spark, sf, KS).items():
        f = f.select(F.lit(k).alias("k"), "query_id", *[F.transform(g, lambda x: rounded(x)).alias(g) for g in "ABCD"])
        out = f if out is None else out.unionByName(f)
    return out


WIDE = ["price", "size", "name_len", "price_per_size"]


@plan("N8_wide_profile", f"""
WITH {VEC_SQL},
med AS (SELECT quantile_cont(price / size, 0.5) AS m FROM lib WHERE size >= 5),
w AS (SELECT nb.*, coalesce(CASE WHEN size >= 5 THEN price / size END, m) AS price_per_size FROM nb CROSS JOIN med)
SELECT query_id, {profile_sql(WIDE, [10, 20])} FROM w GROUP BY query_id
""")
def n8(spark, sf):
    from corvane.operators.ordered import exact_quantiles

    lib = inputs.library_properties(spark, sf)
    # a property that is missing for small parts; missing values take the library median
    extra = lib.select("lib_id", F.when(F.col("size") >= 5, F.col("price") / F.col("size")).alias("price_per_size"))
    median = exact_quantiles(extra, [], "price_per_size", {"m": 0.5}).select("m").scalar()
    nb = inputs.neighbours(spark, sf).drop("vec").join(extra.withColumn("_m", median), "lib_id")
    nb = nb.withColumn("price_per_size", F.coalesce("price_per_size", "_m"))
    return _round_all(context.profile(nb, WIDE), ["query_id"])


COV_SQL = f"""
{DOC_BENCH},
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, lib_id) AS rank FROM tan),
cov AS (SELECT query_id, max(sim) AS max_sim, avg(sim) AS topk_mean_sim, any_value(lib_id) FILTER (WHERE rank = 1) AS nearest_id
        FROM top WHERE rank <= 5 GROUP BY query_id)
"""


@plan("N9_coverage", f"""
WITH {COV_SQL}
SELECT query_id, {r6('max_sim')} AS max_sim, {r6('topk_mean_sim')} AS topk_mean_sim, nearest_id FROM cov
""")
def n9(spark, sf):
    cov = retrieval.coverage(*_doc_bench(spark, sf))
    return cov.select("query_id", rounded("max_sim").alias("max_sim"), rounded("topk_mean_sim").alias("topk_mean_sim"), "nearest_id")


def _cov_sql(name, where):
    return f"""{name} AS (SELECT coalesce(lang, 'ALL') AS lang, count(*) AS n, quantile_cont(max_sim, 0.5) AS median, avg(max_sim) AS mean,
      avg((max_sim >= 0.3)::int) AS ge_30, avg((max_sim >= 0.4)::int) AS ge_40,
      avg((max_sim >= 0.6)::int) AS ge_60, avg((max_sim >= 0.8)::int) AS ge_80
      FROM cov JOIN documents d ON d.doc_id = cov.query_id {where} GROUP BY GROUPING SETS ((lang), ()))"""


@plan("N10_coverage_table", f"""
WITH {COV_SQL}, {_cov_sql('everything', '')}, {_cov_sql('test_only', 'WHERE d.doc_id % 10 = 9')}
SELECT e.lang, e.n, {r6('e.median')} AS median, {r6('e.mean')} AS mean, {r6('e.ge_30')} AS ge_30, {r6('e.ge_40')} AS ge_40,
       {r6('e.ge_60')} AS ge_60, {r6('e.ge_80')} AS ge_80, t.n AS n_test, {r6('t.median')} AS median_test, {r6('t.mean')} AS mean_test
FROM everything e LEFT JOIN test_only t USING (lang)
""")
def n10(spark, sf):
    # the per-row coverage is read several times below, so it is written once
    cov = cut_lineage(retrieval.coverage(*_doc_bench(spark, sf)).join(
        table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), "lang"), "query_id"))
    everything = context.coverage_table(cov, "lang")
    test = context.coverage_table(cov.where(F.col("query_id") % 10 == 9), "lang")  # the test split of the table
    t = test.select("lang", F.col("n").alias("n_test"), F.col("median").alias("median_test"), F.col("mean").alias("mean_test"))
    return _round_all(everything.join(t, "lang", "left"), ["lang", "n", "n_test"])
