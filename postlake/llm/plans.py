"""Registered queries of the text-preparation operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postlake.llm.decontaminate import find_leaks
from postlake.llm.exactdedup import exact_duplicates
from postlake.llm.hardnegatives import hard_negatives
from postlake.llm.licences import scan_licences
from postlake.llm.minhash import near_duplicates
from postlake.llm.packing import pack
from postlake.llm.repetition import measure_repetition, with_verdict
from postlake.llm.secrets import scan_secrets, span_text
from postlake.llm.sharding import DIGITS, SHARDS, SLOTS, fill_table, place
from postlake.llm.toxicity import score_toxicity
from postlake.llm.transducer import count_tokens
from postlake.llm.urlfilter import Rule, judge_urls
from postlake.llm.whitening import whiten
from postlake.plans.registry import query

URL_RULES = [
    Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"),
]
SHARD_NAMES = [f"shard-{n:03d}" for n in range(SHARDS)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file, the same on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op1_minhash_near_dedup")
def minhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query("op2_benchmark_decontamination")
def benchmark_decontamination(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_license_scans")
def license_scans(spark, sf_dir):
    return scan_licences(table(spark, sf_dir, "documents"))


@query("op4_url_filters")
def url_filters(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query("op5_quality_rules")
def quality_rules(spark, sf_dir):
    return with_verdict(measure_repetition(table(spark, sf_dir, "documents")))


@query("op6_sharding", f"""
    WITH slots AS (SELECT string_split('{",".join(map(str, fill_table(SHARD_NAMES)))}', ',') AS shards),
    placed AS (
        SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {DIGITS}) AS BIGINT)
            % {SLOTS} AS INTEGER) AS slot
        FROM documents)
    SELECT doc_id, slot, CAST(shards[slot + 1] AS INTEGER) AS shard FROM placed, slots""")
def sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return place(docs, F.col("doc_id"), SHARD_NAMES).select("doc_id", "slot", "shard")


@query("op7_token_counts")
def token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), limit=2048)


@query("op8_secret_scans")
def secret_scans(spark, sf_dir):
    found = scan_secrets(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = span_text(F.filter("spans", lambda s: s["kind"] != "entropy"))
    return found.select(
        "doc_id", of("assign"), of("access"), of("hex"), F.sha2(base, 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"))


@query("op9_packing")
def packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), window=2048)


@query("op10_toxicity")
def toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted", "n_tokens")


@query("op11_exact_dedup", r"""
    WITH t AS (
        SELECT doc_id, length(coalesce(text, '')) AS n_points,
               regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
        FROM documents),
    g AS (
        SELECT doc_id, norm,
               first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_points DESC, doc_id ASC NULLS LAST) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size
        FROM t)
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
    FROM g""")
def exact_dedup(spark, sf_dir):
    return exact_duplicates(table(spark, sf_dir, "documents"))


@query("op13_embedding_whitening")
def embedding_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"), components=16)


@query("op12_hard_negative_mining", """
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
          AND list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c)))),
    a AS (SELECT vec_id AS anchor_id, label AS alabel, x AS ax FROM v WHERE vec_id % 100 = 0),
    s AS (
        SELECT a.anchor_id, a.alabel, v.vec_id, v.label,
               CAST(list_sum(list_transform(range(len(v.x)), lambda i: a.ax[i + 1] * v.x[i + 1])) AS BIGINT) AS score
        FROM a JOIN v ON len(v.x) = len(a.ax)),
    p AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score
        FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n
              FROM s WHERE label = alabel AND vec_id <> anchor_id)
        WHERE n <= 5),
    n AS (
        SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
               row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
        FROM p JOIN s ON s.anchor_id = p.anchor_id
        WHERE s.label <> s.alabel AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score)
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
    FROM n WHERE rank <= 5""")
def hard_negative_mining(spark, sf_dir):
    return hard_negatives(table(spark, sf_dir, "embeddings"))
