"""One registered query for each operator: thin digests over whole tables.

``ORACLE`` holds DuckDB SQL where SQL can express the result; the others are
tested against brute force in ``tests/llm``.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (cover_tree, exact_dedup, hard_negatives, katz_lm, license_scan, mixing, ngram_join, periodic_runs,
               quality_crf, sentencepiece_codec, sharding, suffix_merge, token_counts)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SHARDS = 40

#: Topics of the mixing query: the first rule that a text meets.
TOPICS = (
    ("legal", r"(?i)\blicen[cs]ed? |copyright"),
    ("contact", r"@|https?://|[0-9]{3}[-. ][0-9]{3}"),
    ("listing", r" \| "),
)
#: Target marginals: sources and topics flattened, languages by share.
MIX_TARGETS = {
    "source": 0.85,
    "lang": {"en": 0.66, "de": 0.13, "fr": 0.12, "es": 0.09},
    "topic": 0.95,
}
MIX_SEED = 7


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ 1 sharding
@query("op1_jump_sharding")
def op1(spark, sf_dir):
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    return (sharding.assign(rows, SHARDS, ties=("text_crc32", "size"))
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"))


# ------------------------------------------------------------------ 2 licenses
@query("op2_license_scan")
def op2(spark, sf_dir):
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])

    def joined(hits):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda m: m["label"]))), ",")

    return found.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"),
        joined(F.col("matches")).alias("labels"), "score")


# ------------------------------------------------------------------ 7 mixing
def _mix_sql() -> str:
    topic = "case " + " ".join(
        f"when regexp_matches(coalesce(text, ''), '{p}') then '{n}'" for n, p in TOPICS) + " else 'other' end"
    ctes = [f"""docs as (select doc_id, len(regexp_extract_all(coalesce(text, ''), '{mixing.TOKENS}'))::bigint as n_tokens,
  coalesce(source, '<null>') as source, coalesce(lang, '<null>') as lang, {topic} as topic from documents)""",
            "cells as (select source, lang, topic, sum(n_tokens)::double as tokens from docs group by all)"]
    for dim, spec in MIX_TARGETS.items():
        if isinstance(spec, dict):
            pairs = " ".join(f"when '{k}' then {v}::double" for k, v in spec.items())
            # values without a listed share keep the one they have, the listed ones share the rest
            want = f"""select {dim}, coalesce(share * (1 - coalesce(others, 0) / coalesce(nullif(total, 0), 1)) / coalesce(nullif(listed, 0), 1),
    held / coalesce(nullif(total, 0), 1)) as want
  from (select *, sum(held) over () as total, sum(case when share is null then held end) over () as others, sum(share) over () as listed
    from (select {dim}, sum(tokens)::double as held, case {dim} {pairs} end as share from cells group by {dim}))"""
        else:
            want = f"select {dim}, pow(sum(tokens), {spec}) as want from cells group by {dim}"
        ctes.append(f"t_{dim} as (select {dim}, want / sum(want) over () as target from ({want}))")
    last, k = "(select *, tokens as weight from cells)", 0
    for _ in range(mixing.SWEEPS):
        for dim in MIX_TARGETS:
            k += 1
            ctes.append(f"""r{k} as materialized (select source, lang, topic, tokens,
  weight * case when s > 0 then target / s else 0 end as weight
  from (select *, sum(weight) over (partition by {dim}) as s from {last}) join t_{dim} using ({dim}))""")
            last = f"r{k}"
    ctes.append(f"""p as (select *, case when tokens > 0 then weight / tokens else 0 end
  / (select max(case when tokens > 0 then weight / tokens else 0 end) from {last}) as probability from {last})""")
    return "with " + ",\n".join(ctes) + f"""
select doc_id, n_tokens, source, lang, topic, round(weight, 9) as weight, round(probability, 9) as probability,
  ('0x' || substr(md5(doc_id::varchar || ':{MIX_SEED}'), 1, 8))::bigint / 4294967296.0::double < probability as drawn
from docs join p using (source, lang, topic)"""


MIX_DIMS = {"source": F.col, "lang": F.col, "topic": lambda _: mixing.topic(F.col("text"), TOPICS)}


def mix_arguments() -> dict:
    """What the query and the pipeline mix by."""
    return {"dims": {d: f(d) for d, f in MIX_DIMS.items()}, "tokens": mixing.token_count(F.col("text")),
            "targets": MIX_TARGETS, "seed": MIX_SEED}


@query("op7_mixing_ipf", _mix_sql())
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    out = mixing.mix(docs, **mix_arguments()).withColumnRenamed("tokens", "n_tokens")
    return out.withColumns({c: F.round(c, 9) for c in ("weight", "probability")})


# ------------------------------------------------------------------ 9 exact dedup
@query("op9_digest_index", """
with n as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
             as text_sha256 from documents)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
       doc_id = max(doc_id) over g as kept, text_sha256
from n window g as (partition by text_sha256)""")
def op9(spark, sf_dir):
    out = exact_dedup.dedupe(table(spark, sf_dir, "documents"), exact_dedup.fresh_index(spark))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


# ------------------------------------------------------------------ 6 n-gram join
@query("op6_ngram_join")
def op6(spark, sf_dir):
    return ngram_join.join(table(spark, sf_dir, "documents"))


# ------------------------------------------------------------------ 10 sentencepiece
@query("op10_sentencepiece")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepiece_codec.decode(spark, sentencepiece_codec.encode(spark, docs))
    return coded.select("doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"), "token_ids",
                        (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))


# ------------------------------------------------------------------ 8 quality classifier
def quality_model(spark: SparkSession, sf_dir: str) -> quality_crf.Crf | None:
    """Fitted on the labelled documents outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").where(quality_crf.fold(F.col("doc_id")) != 1)
    return quality_crf.train(table(spark, sf_dir, "documents"), labels)


@query("op8_quality_crf")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_crf.score(docs, quality_model(spark, sf_dir))
    return scored.select("doc_id", (quality_crf.fold(F.col("doc_id")) == 1).alias("held_out"),
                         F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


# ------------------------------------------------------------------ 4 cover tree
@query("op4_cover_tree")
def op4(spark, sf_dir):
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"))


# ------------------------------------------------------------------ 3 Katz language model
@query("op3_katz_lm")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = katz_lm.train(docs)
    return katz_lm.score(docs, model, passes=4).select(
        "doc_id", katz_lm.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


# ------------------------------------------------------------------ 5 suffix merge
@query("op5_suffix_merge")
def op5(spark, sf_dir):
    out = suffix_merge.remove(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
                      F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


# ------------------------------------------------------------------ 11 token counts
TOKEN_LIMIT = 4096


@query("op11_digest_counts")
def op11(spark, sf_dir):
    out = token_counts.count(table(spark, sf_dir, "documents"), token_counts.fresh_cache(spark))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


# ------------------------------------------------------------------ 12 hard negatives
@query("op12_hard_negatives", """
with base as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    [floor(256 * x::double) for x in embedding] as v from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and coalesce(list_bool_and([x is not null and isfinite(x) for x in embedding]), true)),
scored as (
  select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id,
    coalesce(list_sum([p[1] * p[2] for p in list_zip(a.v, b.v)]), 0)::bigint as score
  from base a join base b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.v) = len(b.v)),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, row_number() over w as rank, s.vec_id as negative_id, positive_score, s.score as negative_score
from positives join scored s using (anchor_id)
where not s.same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score
window w as (partition by anchor_id, positive_id order by s.score desc, s.vec_id)
qualify rank <= 10""")
def op12(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    scaled = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), F.when(finite, scaled).alias("v"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


# ------------------------------------------------------------------ 13 periodic runs
def with_tandem_repeats(docs: DataFrame) -> DataFrame:
    """The contract's texts: of documents whose id has a crc32 divisible by 10, words
    from one on repeat with a period that the id decides."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    g, n = F.floor(h / 10), F.size("words").cast("bigint")
    a = g % n
    p = 1 + F.call_function("div", n - a, 3 + g % 8)
    repeated = F.transform("words", lambda w, i: F.when(i < a, w).otherwise(F.get(F.col("words"), (a + (i - a) % p).cast("int"))))
    return (docs.withColumn("words", F.when(h % 10 == 0, words))
            .select("doc_id", F.when(F.size("words") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text")))


@query("op13_periodic_runs")
def op13(spark, sf_dir):
    docs = with_tandem_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return periodic_runs.runs(docs).select("doc_id", *periodic_runs.digests())
