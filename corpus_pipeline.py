"""Training-data pipeline over ``documents``: each stage is one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rategrid.llm import langid, mixing, pieces, pii, simhash
from rategrid.llm.common import stage


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the language models reject go."""
    return langid.keep_known(docs, langid.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays (3-word shingles, 2 bits)."""
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and with as many words, as the source mix takes them."""
    return mixing.apply_mix(docs)


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece counts, N-best scores and the id digest of every mixed document."""
    return pieces.segment(docs)


STAGES = [
    ("known_language", known_language),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("segmentation", segmentation),
]

# The language model, the fingerprints (XXH64) and the segmentation have no
# SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
