"""Registered queries of the subpackage and the SQL of those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rategrid.llm import (
    cleaning,
    codes,
    langid,
    mixing,
    packing,
    pieces,
    pii,
    resample,
    simhash,
    tokencount,
    topk,
    warc,
    whitening,
)
from rategrid.llm.common import table


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every hundredth vector with all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents (3-word shingles, 2 bits)."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document (byte-level BPE)."""
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


def op4_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures and the line-first verdict of every document."""
    return cleaning.measures(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back in chunks."""
    return warc.roundtrip(spark, table(spark, sf_dir, "pages"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document from models learnt on its training folds."""
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix of all sources takes of every document."""
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal-data spans of every document."""
    return pii.find(table(spark, sf_dir, "documents"))


def op9_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight and Gumbel top-k verdict of every document."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-best segmentation of every document and its decoding."""
    return pieces.segment(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first four whitened components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tokenised document in sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of every vector after two Lloyd rounds."""
    return codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_topk": op1_topk,
    "op2_simhash": op2_simhash,
    "op3_tokens": op3_tokens,
    "op4_cleaning": op4_cleaning,
    "op5_warc": op5_warc,
    "op6_langid": op6_langid,
    "op7_mixing": op7_mixing,
    "op8_pii": op8_pii,
    "op9_resample": op9_resample,
    "op10_pieces": op10_pieces,
    "op11_whitening": op11_whitening,
    "op12_packing": op12_packing,
    "op13_codes": op13_codes,
}

SQL: dict[str, str] = {
    "op1_topk": topk.SQL,
    "op7_mixing": mixing.TAKEN_SQL,
    "op13_codes": codes.SQL,
}
