"""One registered query per operator: production parameters, whole tables, full results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.llm import jaccard_join, language_model, license_scan, merkle, mixing, negatives, neighbours, packing, quality, secret_scan, simhash, substring_dedup, url_filters
from corvane.llm.common import documents
from corvane.plans.registry import table

TOKENIZER = "word_bpe_49k.json"


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    spans, kinds = F.col("secret_spans"), [r.kind for r in secret_scan.BASE_RULES]
    base = F.filter(spans, lambda s: s["kind"].isin(kinds))
    return found.select(
        "doc_id", *[_count(spans, k).alias(f"n_{k}") for k in kinds],
        F.sha2(secret_scan.joined(base).cast("binary"), 256).alias("base_sha256"), secret_scan.joined(spans).alias("spans"),
        (F.size(spans) - F.size(base)).cast("long").alias("n_more"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.filter_urls(pages, url_filters.rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(documents(spark, sf_dir).select("doc_id", "text"))
    sure = F.filter("license_hits", lambda h: h["confirmed"])
    return found.select(
        "doc_id", "n_paragraphs", F.size(sure).cast("long").alias("n_licenses"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda h: h["family"]))), ",").alias("families"),
        (F.size("license_hits") - F.size(sure)).cast("long").alias("n_unconfirmed"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(documents(spark, sf_dir))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), TOKENIZER, payload="crc32")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(documents(spark, sf_dir), size=4, percent=85)


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(documents(spark, sf_dir), word_pairs=True)


def op10_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    text = F.when(tampered, merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))
    return merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "source", {"text": text}).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = simhash.compare_with_next(documents(spark, sf_dir).select("doc_id", "text"))
    return simhash.count_within(compared, F.col("doc_id") % 50 == 0)


QUERIES = {f.__name__: f for f in (
    op1_secret_scan, op2_quality_rules, op3_url_filters, op4_license_scan, op5_substring_dedup, op6_best_fit_packing, op7_mix_sources, op8_jaccard_join,
    op9_language_model, op10_nearest_vectors, op11_merkle_manifest, op12_hard_negatives, op13_document_fingerprints)}

_HOST = r"""regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)"""
ORACLES = {
    "op3_url_filters": rf"""
with parts as (
  select page_id, translate({_HOST}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
rules as (select * from (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) r(action, rh, rp)),
best as (
  select page_id, arg_max(rh || rp, length(rh) * 1000 + length(rp)) as rule, arg_max(action, length(rh) * 1000 + length(rp)) as action
  from parts, rules where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by 1)
select parts.page_id, host, path, rule, coalesce(action, 'allow') as verdict from parts left join best using (page_id)""",
    "op7_mix_sources": r"""
with recursive sized as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as h from documents),
totals as (
  select source, sum(size) as source_size, row_number() over (order by source nulls last) - 1 as place from sized group by source),
weighted as (
  select source, source_size, 2.0::double * source_size as cap, ([5.0, 2.0, 1.0])[1 + place % 3]::double as weight from totals),
rates as (
  select 0 as step, 1.5::double * sum(source_size) / sum(weight) as rate, 0::bigint as over from weighted
  union all
  select step + 1, (1.5::double * (select sum(source_size) from weighted) - (select coalesce(sum(cap), 0) from weighted where cap < weight * rate))
    / (select sum(weight) from weighted where cap >= weight * rate), (select count(*) from weighted where cap < weight * rate)
  from rates where (select count(*) from weighted where cap < weight * rate) > over),
goals as (
  select source, source_size, least(cap, weight * (select rate from rates order by step desc limit 1)) as target from weighted),
budgets as (
  select *, floor(target / greatest(source_size, 1)) as passes, floor(target - floor(target / greatest(source_size, 1)) * source_size) as budget from goals),
placed as (
  select d.*, sum(size) over (partition by source order by h range between unbounded preceding and current row) as upto from sized d)
select doc_id, size, cast(source_size as bigint) as source_size, target,
       cast(size * (passes + case when upto <= budget then 1 else 0 end) as bigint) as taken
from placed join budgets on placed.source is not distinct from budgets.source""",
    "op11_merkle_manifest": r"""
with recursive base as (
  select doc_id, source, lang, n_chars, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low, cast(doc_id as varchar) as name from documents),
hashed as (
  select doc_id, coalesce('=' || source, '') as g,
    coalesce(strlen(name) || ':' || name, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head,
    coalesce(strlen(text) || ':' || text, '-') as body, coalesce(strlen(low) || ':' || low, '-') as low_body,
    list_reduce(list_concat([4294967295::bigint], flatten(list_transform(range(1, length(name) + 1), lambda i: [ascii(name[i])::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384 * (c & 1)) end) as crc from base),
leaves as (
  select doc_id, g, sha256(head || body) as leaf, case when xor(crc, 4294967295) % 5 = 0 then sha256(head || low_body) else sha256(head || body) end as found from hashed),
ranked as (
  select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by g) as n from leaves),
tree as (
  select 0 as level, g, place, n, leaf as digest from ranked
  union all
  select any_value(level) + 1, g, place // 16, (any_value(n) + 15) // 16, sha256(string_agg(digest, '' order by place)) from tree where n > 1 group by g, place // 16),
subroots as (
  select g, digest as subroot, level as height, row_number() over (order by g) - 1 as place, count(*) over () as n from tree where n = 1),
crown as (
  select 0 as level, place, n, subroot as digest from subroots
  union all
  select any_value(level) + 1, place // 16, (any_value(n) + 15) // 16, sha256(string_agg(digest, '' order by place)) from crown where n > 1 group by place // 16),
steps as (
  select level, g, place, digest,
    coalesce(string_agg(digest, '' ) over (partition by level, g, place // 16 order by place rows between unbounded preceding and 1 preceding), '') as before,
    coalesce(string_agg(digest, '') over (partition by level, g, place // 16 order by place rows between 1 following and unbounded following), '') as after
  from tree where n > 1),
crown_steps as (
  select level, place,
    coalesce(string_agg(digest, '') over (partition by level, place // 16 order by place rows between unbounded preceding and 1 preceding), '') as before,
    coalesce(string_agg(digest, '') over (partition by level, place // 16 order by place rows between 1 following and unbounded following), '') as after
  from crown where n > 1),
path as (
  select r.doc_id, r.g, r.place as own, s.level, s.before, s.after from ranked r join steps s on s.g = r.g and s.place = r.place // (16 ** s.level)::bigint
  union all
  select r.doc_id, r.g, r.place, b.height + s.level, s.before, s.after from ranked r join subroots b using (g) join crown_steps s on s.place = b.place // (16 ** s.level)::bigint),
folds as (
  select doc_id, g, place as own, 0 as level, found as node from ranked
  union all
  select f.doc_id, f.g, f.own, f.level + 1, sha256(p.before || f.node || p.after) from folds f join path p on p.g = f.g and p.own = f.own and p.level = f.level),
folded as (select g, own, arg_max(node, level) as folded_root from folds group by all),
proofs as (select g, own, sha256(string_agg(before || after, '' order by level)) as proof_sha256 from path group by all),
root as (select digest as root from crown where n = 1)
select r.doc_id, r.leaf, b.subroot, root, coalesce(proof_sha256, sha256('')) as proof_sha256, folded_root, folded_root = root as verified
from ranked r join subroots b using (g) join folded f on f.g = r.g and f.own = r.place left join proofs p on p.g = r.g and p.own = r.place cross join root""",
    "op12_hard_negatives": r"""
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.e, b.e)::bigint as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id)::int as rank, vec_id as negative_id, positive_score, score as negative_score
from p join s on s.anchor_id = p.anchor_id and not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) <= 3""",
}
