"""The queries of this subpackage, opN_<name>, and the SQL of those that SQL can express."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, mixing, near_dedup, packing, pii, quality, sharding, substring_dedup, topk, warc
from .common import table


#: Target weights of languages.
MIX = {"de": 0.25, "en": 0.4, "es": 0.15, "fr": 0.2}


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    return sharding.shard_rows(docs, 24, stable=True).select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), words=3, num=85, den=100)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.quillgraph.pii.key", None) or secrets.token_hex(32)  # without a key of the user's, one that is forgotten
    out = pii.pseudonymize(table(spark, sf_dir, "documents"), key)
    return out.select("doc_id", *[F.col(f"pii.{k}").cast("long").alias(f"n_{k}") for k in pii.KINDS], "text")


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    labelled = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("domain")).join(labels.select(F.col("doc_id").alias("id")), "id", "left_semi")
    out = mixing.mixing_rates(docs, labelled, MIX)
    return out.select("doc_id", "tokens", *[F.get("posterior", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(sorted(MIX))], "rate", "copies")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve_revisits(warc.page_records(table(spark, sf_dir, "pages")))
    lines = F.transform("headers", lambda p: F.concat(p["name"], F.lit(": "), p["value"]))
    return out.select("record_id", "ts", "canonical_url", "refers_to", "refers_ts", "status", "digest", F.array_join(lines, "\n").alias("headers"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_shard": op2_shard,
    "op3_near_dedup": op3_near_dedup,
    "op4_pii": op4_pii,
    "op5_pack": op5_pack,
    "op6_topk": op6_topk,
    "op7_mix": op7_mix,
    "op8_quality": op8_quality,
    "op9_warc_revisits": op9_warc_revisits,
    "op10_exact_dedup": op10_exact_dedup,
}
ORACLE_SQL: dict[str, str] = {"op6_topk": topk.ORACLE_SQL, "op9_warc_revisits": warc.ORACLE_SQL, "op10_exact_dedup": exact_dedup.ORACLE_SQL}
