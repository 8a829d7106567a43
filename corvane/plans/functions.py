"""Queries for scalar functions and feature arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import fingerprints as FP, numeric as N, text as T, vectors as V
from corvane.functions.numeric import rounded
from corvane.plans import inputs
from corvane.plans.inputs import bits_sql
from corvane.plans.metrics import show
from corvane.plans.registry import plan, r6, table, text_table

total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def vector_text(spark, sf):
    """Embeddings as text in several spellings, some unreadable."""
    e = table(spark, sf, "embeddings")
    body = F.concat_ws(",", F.transform(V.as_doubles("embedding"), lambda x: F.format_string("%.6f", x)))
    kind = F.col("vec_id") % 7
    text = (F.when(kind == 0, F.concat(F.lit("["), body, F.lit("]"))).when(kind == 1, body)
            .when(kind == 2, F.concat(F.lit("["), body, F.lit(",...]"))).when(kind == 3, F.lit("no vector"))
            .when(kind == 4, F.concat(F.lit("[1., NaN,"), body, F.lit("]"))).when(kind == 5, F.concat(F.lit(" [Infinity, -Infinity, "), body, F.lit("] ")))
            .otherwise(F.lit("[]")))
    return e.select("vec_id", text.alias("text"))


@plan("F1_parse_vector", f"""
WITH t AS (SELECT vec_id, list_transform(embedding::double[], lambda x: round(x, 6)) AS v FROM embeddings)
SELECT vec_id, CASE WHEN vec_id % 7 IN (0, 1) THEN len(v) WHEN vec_id % 7 IN (4, 5) THEN len(v) + 2 END::int AS dims,
  CASE WHEN vec_id % 7 IN (0, 1, 4, 5) THEN {r6('list_sum(v) + CASE WHEN vec_id % 7 = 4 THEN 1 ELSE 0 END')} END AS total FROM t
""")
def f1(spark, sf):
    p = vector_text(spark, sf).select("vec_id", V.parse_vector(F.col("text")).alias("v"))
    return p.select("vec_id", F.when(F.col("v").isNotNull(), F.size("v")).alias("dims"), rounded(total(F.col("v"))).alias("total"))


@plan("F2_format_vector", "SELECT vec_id, md5('[' || list_aggregate(list_transform(embedding::double[], lambda x: printf('%.8f', x)), 'string_agg', ',') || ']') AS text_md5 FROM embeddings")
def f2(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.md5(V.format_vector(V.as_doubles("embedding"))).alias("text_md5"))


@plan("F3_dimension_check", """
WITH d AS (SELECT 'raw' AS what, len(embedding)::int AS n FROM embeddings
  UNION ALL SELECT 'parsed', (len(embedding) + CASE WHEN vec_id % 7 IN (4, 5) THEN 2 ELSE 0 END)::int FROM embeddings WHERE vec_id % 7 IN (0, 1, 4, 5))
SELECT what, count(DISTINCT n) AS n_dims, min(n) AS min_dim, max(n) AS max_dim FROM d GROUP BY what
""")
def f3(spark, sf):
    check = lambda d, what: d.where("v IS NOT NULL").agg(F.count_distinct(F.size("v")).alias("n_dims"), F.min(F.size("v")).alias("min_dim"), F.max(F.size("v")).alias("max_dim")).withColumn("what", F.lit(what))
    raw = table(spark, sf, "embeddings").select(F.col("embedding").alias("v"))
    parsed = vector_text(spark, sf).select(V.parse_vector(F.col("text")).alias("v"))
    return check(raw, "raw").unionByName(check(parsed, "parsed"))


@plan("F4_vector_math", f"""
WITH a AS (SELECT a.vec_id, a.embedding::double[] AS x, b.embedding::double[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, {r6('list_dot_product(x, y)')} AS dot, {r6('sqrt(list_dot_product(x, x))')} AS norm, {r6('list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y)))')} AS cosine,
 {r6('list_distance(x, y)')} AS distance, {r6('list_max(x) / (sqrt(list_dot_product(x, x)) + 1e-12::double)')} AS unit_max FROM a
""")
def f4(spark, sf):
    e = table(spark, sf, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), V.as_doubles("embedding").alias("y"))
    j = e.select("vec_id", V.as_doubles("embedding").alias("x")).join(b, "vec_id")
    x, y = F.col("x"), F.col("y")
    return j.select("vec_id", rounded(V.dot(x, y)).alias("dot"), rounded(V.norm(x)).alias("norm"), rounded(V.cosine(x, y)).alias("cosine"),
                    rounded(V.distance(x, y)).alias("distance"), rounded(F.array_max(V.l2_normalise(x))).alias("unit_max"))


@plan("F5_tanimoto", f"""
WITH {bits_sql('benchmark', 'item_id', 'a')}, p AS (SELECT x.a, x.b AS p, y.b AS q FROM bits_a x JOIN bits_a y ON y.a = x.a + 1)
SELECT a AS item_id, {r6('len(list_intersect(p, q))::double / greatest(len(p) + len(q) - len(list_intersect(p, q)), 1)')} AS sim FROM p
""")
def f5(spark, sf):
    fp = inputs.fingerprints(spark, sf, "benchmark", "item_id", "item_id")
    nxt = fp.select((F.col("item_id") - 1).alias("item_id"), F.col("fp").alias("other"))
    return fp.join(nxt, "item_id").select("item_id", rounded(V.tanimoto(F.col("fp"), F.col("other"))).alias("sim"))


@plan("F6_pack_bits", f"WITH {bits_sql('documents', 'doc_id', 'd')} SELECT d AS doc_id, len(b)::int AS n_bits, md5(array_to_string(b, ',')) AS bits_md5 FROM bits_d")
def f6(spark, sf):
    fp = inputs.fingerprints(spark, sf, "documents", "doc_id", "doc_id")
    back = V.unpack_bits(F.col("fp"))
    return fp.select("doc_id", V.popcount(F.col("fp")).alias("n_bits"), F.md5(F.concat_ws(",", back.cast("array<string>"))).alias("bits_md5"))


@plan("F7_slug", """
SELECT page_id, regexp_replace(url, '[^A-Za-z0-9]', '__', 'g') AS slug, regexp_extract(url || '/page' || page_id || '_metrics.json', '([^/]+?)_metrics\\.json$', 1) AS metric FROM pages
""")
def f7(spark, sf):
    path = F.concat("url", F.lit("/page"), F.col("page_id").cast("string"), F.lit("_metrics.json"))
    return table(spark, sf, "pages").select("page_id", T.slug(F.col("url")).alias("slug"), T.metric_from_path(path).alias("metric"))


@plan("F8_clean_cell", """
SELECT o_orderkey, o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN ' 5%' ELSE '' END AS cell, round(o_totalprice, 2) AS number FROM orders
""")
def f8(spark, sf):
    o = table(spark, sf, "orders")
    marked = F.concat(F.lit(r" \textbf{"), "o_orderpriority", F.when(F.col("o_orderkey") % 2 == 0, r" 5\%").otherwise(""), F.lit(r"}\textsuperscript{a}$^*$ "))
    priced = F.concat(F.lit(r"\text{$"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("$}$^{*}$ "))
    return o.select("o_orderkey", T.clean_cell(marked).alias("cell"), F.round(T.to_number(T.clean_cell(priced)), 2).alias("number"))


@plan("F9_tag_tokens", r"""
WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM conversations),
t AS (SELECT conv_id, turn, list_transform(w, lambda x: CASE WHEN len(regexp_extract_all(x, 'th|er|on|an|[a-z]')) >= 5 AND array_to_string(regexp_extract_all(x, 'th|er|on|an|[a-z]'), '') = x
   THEN '<sm_' || array_to_string(regexp_extract_all(x, 'th|er|on|an|[a-z]'), '><sm_') || '>' ELSE x END) AS o FROM w)
SELECT conv_id, turn, md5(array_to_string(o, ' ')) AS tagged_md5 FROM t
""")
def f9(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.md5(T.tag_tokens(F.col("text"), "th|er|on|an|[a-z]")).alias("tagged_md5"))


@plan("F10_prompt", """
SELECT conv_id, turn, md5('Possible labels: user, assistant. Classify the speaker of turn ' || turn || '. Text: ' || text || ' Label:') AS prompt_md5 FROM conversations
""")
def f10(spark, sf):
    c = table(spark, sf, "conversations")
    p = T.prompt("Possible labels: user, assistant. Classify the speaker of turn %d. Text: %s Label:", F.col("turn"), F.col("text"))
    return c.select("conv_id", "turn", F.md5(p).alias("prompt_md5"))


@plan("F11_strip_special", "SELECT conv_id, turn, md5(trim(replace(text, '>', ''))) AS clean_md5 FROM conversations")
def f11(spark, sf):
    raw = F.concat(F.lit(" <sm_"), F.col("text"), F.lit("> sm_</s>"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(T.strip_special(raw, ["</s>", "<sm_", " sm_", ">"])).alias("clean_md5"))


@plan("F12_first_label", """
SELECT conv_id, turn, CASE WHEN contains(lower(text), 'thei') THEN 'thei' WHEN contains(lower(text), 'ein') THEN 'ein' WHEN contains(lower(text), 'eaux') THEN 'eaux' ELSE 'unknown' END AS label FROM conversations
""")
def f12(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.first_label(F.col("text"), ["thei", "ein", "eaux"]).alias("label"))


@plan("F13_to_seconds", f"""
SELECT event_id, {r6("CASE event_id % 3 WHEN 0 THEN value / 1000 WHEN 1 THEN value ELSE value * 3600 END")} AS seconds FROM events
""")
def f13(spark, sf):
    unit = F.when(F.col("event_id") % 3 == 0, "ms").when(F.col("event_id") % 3 == 1, "s").otherwise("h")
    said = F.concat(F.lit("took "), F.col("value").cast("decimal(18,2)").cast("string"), F.lit(" "), unit)
    return table(spark, sf, "events").select("event_id", rounded(T.to_seconds(said)).alias("seconds"))


@plan("F14_time_differences", """
SELECT event_id, (epoch_us(ts) - epoch_us(timestamp '2024-01-01 00:00:00')) AS micros, date_trunc('second', ts) AS whole FROM events
""")
def f14(spark, sf):
    e = table(spark, sf, "events")
    whole = F.to_timestamp_ntz(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("yyyy-MM-dd HH:mm:ss"))
    start = F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return e.select("event_id", (micros(F.col("ts")) - micros(start)).alias("micros"), whole.alias("whole"))


@plan("F15_numeric", f"""
WITH {inputs.MULTI_SQL}, z AS (SELECT row_id, list_transform(proba, lambda x: x * 20.0::double) AS z FROM multi_rows),
l AS (SELECT row_id, list_transform(z, lambda s: s - list_max(z) - ln(list_sum(list_transform(z, lambda q: exp(q - list_max(z)))))) AS l, z FROM z)
SELECT row_id, {r6('list_max(l)')} AS top, {r6('list_min(l)')} AS low, {r6('greatest(0.5, least(2.5, z[1]))')} AS clipped, {r6('z[2]', 3)} AS r3, {r6('ln(1 + z[3])')} AS lp, {r6('exp(z[4]) - 1', 3)} AS em FROM l
""")
def f15(spark, sf):
    m = inputs.multi_rows(spark, sf).select("row_id", F.transform("proba", lambda x: x * 20.0).alias("z"))
    l = N.log_softmax(F.col("z"))
    z = lambda i: F.element_at("z", i)
    return m.select("row_id", rounded(F.array_max(l)).alias("top"), rounded(F.array_min(l)).alias("low"), rounded(N.clip(z(1), 0.5, 2.5)).alias("clipped"),
                    rounded(z(2), 3).alias("r3"), rounded(N.log1p_target(z(3))).alias("lp"), rounded(N.expm1_target(z(4)), 3).alias("em"))


@plan("F16_token_hits", r"""
WITH h AS (SELECT doc_id, text, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9.]+@[A-Za-z0-9.]+'))) AS hit FROM documents)
SELECT doc_id, hit, substr(text, greatest(strpos(text, hit) - 20, 1), length(hit) + 40) AS context FROM h
""")
def f16(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.inline(T.token_hits(F.col("text"), "[A-Za-z0-9.]+@[A-Za-z0-9.]+")))


@plan("F17_lint_counts", r"""
SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[.!?]+\s*'), lambda s: trim(s) <> ''))::int AS n_sentences,
 len(list_filter(regexp_split_to_array(text, '\s+'), lambda s: s <> ''))::int AS n_words, len(regexp_extract_all(lower(text), '\bthe\b'))::int AS n_the, len(regexp_extract_all(lower(text), '\band\b'))::int AS n_and FROM documents
""")
def f17(spark, sf):
    counts = T.lint_counts(F.col("text"), ["the", "and"])
    return text_table(spark, sf, "documents").select("doc_id", *[c.alias(n) for n, c in counts.items()])


@plan("G1_hashed_fingerprint", f"""
WITH {bits_sql('documents', 'doc_id', 'b2048')}, {bits_sql('documents', 'doc_id', 'b128', 128)}
SELECT b2048 AS doc_id, len(x.b)::int AS n_2048, len(y.b)::int AS n_128, list_sum(x.b)::bigint AS sum_2048 FROM bits_b2048 x JOIN bits_b128 y ON b2048 = b128
""")
def g1(spark, sf):
    d = text_table(spark, sf, "documents")
    long = d.select("doc_id", FP.hashed_fingerprint(F.col("text"), 2048, hasher="md5").alias("a")).withColumn("b", FP.narrower(F.col("a"), 128))
    spots = F.aggregate(V.unpack_bits(F.col("a")), F.lit(0).cast("bigint"), lambda s, x: s + x)
    some = F.when(V.popcount(F.col("a")) > 0, spots)
    return long.select("doc_id", V.popcount(F.col("a")).alias("n_2048"), V.popcount(F.col("b")).alias("n_128"), some.alias("sum_2048"))


KEYS = ["[0-9]", "@", "http", "the", "eau", "sch", r"\n", "[A-Z]{3}", "copyright|license", r"\?"]


@plan("G2_key_fingerprint", "SELECT doc_id, concat(" + ", ".join(f"regexp_matches(text, '{k}')::int" for k in KEYS) + ") AS flags FROM documents")
def g2(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.concat_ws("", FP.key_fingerprint(F.col("text"), KEYS).cast("array<string>")).alias("flags"))


@plan("G3_fingerprint_arms", f"""
WITH {bits_sql('documents', 'doc_id', 'd', 128)}, k AS (SELECT doc_id, {' + '.join(f"regexp_matches(text, '{k}')::int" for k in KEYS)} AS n FROM documents)
SELECT doc_id, 'hashed' AS arm, 128 AS width, len(b)::int AS n_set FROM k JOIN bits_d ON d = doc_id
UNION ALL SELECT doc_id, 'keys', {len(KEYS)}, n FROM k UNION ALL SELECT doc_id, 'both', 128 + {len(KEYS)}, (len(b) + n)::int FROM k JOIN bits_d ON d = doc_id
""")
def g3(spark, sf):
    def flags(words):  # packed words as 0/1 entries
        return V.let(V.unpack_bits(words), lambda on: F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: F.array_contains(on, i).cast("int")))

    d = text_table(spark, sf, "documents").select("doc_id", flags(FP.hashed_fingerprint(F.col("text"), 128, hasher="md5")).alias("hashed"), FP.key_fingerprint(F.col("text"), KEYS).alias("keys"))
    arms = d.withColumn("both", F.concat("hashed", "keys"))
    ones = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)
    return arms.select("doc_id", F.inline(F.array(*[F.struct(F.lit(a).alias("arm"), F.size(a).alias("width"), ones(F.col(a)).alias("n_set")) for a in ("hashed", "keys", "both")])))


@plan("G14_concat_vector", f"""
WITH {bits_sql('documents', 'doc_id', 'd', 128)}
SELECT d AS doc_id, len(embedding) + 128 AS width, {r6('list_sum(embedding::double[]) + len(b)')} AS total FROM bits_d JOIN embeddings ON vec_id = d
""")
def g14(spark, sf):
    fp = inputs.fingerprints(spark, sf, "documents", "doc_id", "doc_id", 128)
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), V.as_doubles("embedding").alias("v"))
    bits = V.let(V.unpack_bits(F.col("fp")), lambda on: F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: F.array_contains(on, i).cast("double")))
    j = fp.join(e, "doc_id").select("doc_id", F.concat("v", bits).alias("x"))
    return j.select("doc_id", F.size("x").cast("bigint").alias("width"), rounded(total(F.col("x"))).alias("total"))
