"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, secrets are masked, domains
are mixed to target weights, and what is left is packed. Each stage's result is written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marginalia.llm.common import kept_last, made, stored
from marginalia.llm.mixing import mix, mixed, quality_domains
from marginalia.llm.neardup import deduplicated
from marginalia.llm.packing import pack
from marginalia.llm.secrets import masked
from marginalia.llm.toxicity import not_toxic

WEIGHTS = {"clean_high": 0.85, "clean_low": 0.15}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return not_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicated(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return masked(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = quality_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixed(docs, mix(docs, labels, WEIGHTS))


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_domains),
    ("packing", pack_batches),
]
ORACLE_SQL = None  # the classifier and the network are not SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; a stage's own tables, and the result before, are deleted once its result is written."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), made()
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        kept_last(spark, since)
    return docs
