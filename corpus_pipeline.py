"""A training-data pipeline over ``documents``: quality rules, near-duplicates, decontamination, mixing, token shards.

Each stage takes (spark, docs, sf_dir), works on all that the one before it
kept, and returns the columns of documents; the last returns what reading the
token shards back gives.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontam, mixing, near_copies, quality_rules, token_store
from tessera.llm.queries import table, tokenizer
from tessera.session import ship
from tessera.sources.tables import own_dir


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality_rules.kept(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_copies.without_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def store_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return token_store.token_store(docs, tokenizer()).drop("stored_bytes")


STAGES = [
    ("quality rules", keep_good),
    ("SimHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", store_tokens),
]
#: SQL can't express the fingerprints or the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet to this application's part of the shared folder and read again."""
    docs, own = table(spark, sf_dir, "documents"), f"{own_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for nth, (_, stage) in enumerate(STAGES):
        path = f"{own}/{nth}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
