"""Corpus preparation in stages: each stage takes what its predecessor kept, and is written and read again in between.

quality (documents that the classifier rejects go), exact duplicates, near duplicates (five words, 0.8; one of each group stays), mixing of
languages to target weights (nothing goes: what is short is repeated), packing into sequences of 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import exact_dedup, mixing, near_dedup, packing, quality
from quillgraph.llm.common import Written, table

WEIGHTS = {"de": 0.2, "en": 0.5, "es": 0.15, "fr": 0.15}


def labelled_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of the documents that `labels` covers."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("domain")).join(labels.select(F.col("doc_id").alias("id")), "id", "left_semi")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def distinct_enough(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(docs, words=5, num=80, den=100)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, labelled_languages(spark, sf_dir), WEIGHTS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", good), ("exact_dedup", distinct), ("near_dedup", distinct_enough), ("mixing", mix), ("packing", sequences)]

#: Classifier, hashes of shingles and packing are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = Written(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = kept.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
