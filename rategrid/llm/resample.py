"""Quality by importance resampling over hashed n-grams.

Words (ASCII lower case) and word pairs are hashed into ``buckets``.  Two
generative models, target (documents labelled as good) and raw (all
documents), are smoothed bucket frequencies.  A document's log weight is the sum
over its n-grams of ``log p_target - log p_raw``.  Adding Gumbel noise from a hash
of the id and taking the ``k`` largest keys samples ``k`` documents without
replacement in proportion to their weights.

Raw counts cover all documents.  The target model is fitted on the documents of
at most ``max_labels`` labelled ids (the smallest hashes), which bounds the
broadcast id list; both models are ``buckets`` numbers.  ``k`` defaults to the
share of good labels times the number of documents.  The exact ``k``-th largest
key is found by refining a histogram of keys, so nothing is sorted whole.

Cases: null or blank text has no n-grams and weight 1 (log 0); labels for unknown
ids are ignored; repeated labels: good if any is; without a usable label the
models are equal and sampling is uniform over everything; rows repeating an id
share their noise; equal keys are sampled together; a null id takes the noise of
the empty string; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rategrid.llm.common import prepare, stage

BUCKETS = 20_000
MAX_LABELS = 50_000
SMOOTHING = 1.0
_BINS = 4096
_PIECE = 1 << 20                 # words of a text hashed at a time


def buckets_of(text: str | None, buckets: int = BUCKETS) -> tuple[int, list[np.ndarray]]:
    """``(words, bucket arrays)`` of the words and word pairs of a whole text."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()
    out, digest, last = [], xxhash.xxh64_intdigest, None
    with np.errstate(over="ignore"):
        for at in range(0, len(words), _PIECE):
            h = np.array([digest(w) for w in words[at:at + _PIECE]], dtype=np.uint64)
            out.append(((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64))
            h = h if last is None else np.concatenate((last, h))
            pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ h[1:]
            pair = pair * np.uint64(0xD6E8FEB86659FD93)
            out.append(((pair >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64))
            last = h[-1:]
    return len(words), out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", good: str = "quality",
        buckets: int = BUCKETS, max_labels: int = MAX_LABELS) -> np.ndarray:
    """Log ratio of the target and raw models per bucket."""
    prepare(docs.sparkSession)
    ids = (labels.where((F.col(good) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct()
           .orderBy(F.xxhash64("_id"), "_id").limit(max_labels))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).join(
        F.broadcast(ids), F.col("id") == F.col("_id"), "left").select("text", F.col("_id").isNotNull().alias("target"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((2, buckets), np.int64)
        for b in batches:
            for t, target in zip(b.column(0), b.column(1).to_pylist()):
                for part in buckets_of(t.as_py(), buckets)[1]:
                    c = np.bincount(part, minlength=buckets)
                    count[0] += c
                    if target:
                        count[1] += c
        used = np.nonzero(count[0])[0]
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(count[0][used]), pa.array(count[1][used])],
                              names=["bucket", "raw", "target"])

    total = rows.mapInArrow(run, "bucket int, raw long, target long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.full(buckets, SMOOTHING), np.full(buckets, SMOOTHING)
    for r in total:
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    if target.sum() == SMOOTHING * buckets:
        return np.zeros(buckets)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weigh(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text: str = "text",
          seed: str = "gumbel") -> DataFrame:
    """``doc_id, n_words, log_weight, mean_log_ratio, key`` per row."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(ratio)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        for b in batches:
            n, w, g = [], [], []
            for t in b.column(1):
                words, parts = buckets_of(t.as_py(), len(r))
                n.append(words)
                w.append(float(sum(r[p].sum() for p in parts)))
                g.append(sum(len(p) for p in parts))
            w = np.array(w)
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(w),
                                   pa.array(w / np.maximum(1, np.array(g)))],
                                  names=["doc_id", "n_words", "log_weight", "mean_log_ratio"])

    u = (F.shiftrightunsigned(F.xxhash64(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 11)
         + F.lit(0.5)) / F.lit(float(2**53))
    return src.mapInArrow(run, "doc_id long, n_words long, log_weight double, mean_log_ratio double").withColumn(
        "key", F.col("log_weight") - F.log(-F.log(u)))


def kth_largest(rows: DataFrame, key: str, k: int) -> float | None:
    """Exact ``k``-th largest value of a staged column (None if ``k`` is 0): a
    histogram is refined around it until a bounded number of keys is left."""
    part = rows.select(F.col(key).alias("x"))
    if k <= 0:
        return None
    while True:
        r = part.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n")).first()
        if not r["n"] or k >= r["n"]:
            return r["lo"]
        if r["lo"] == r["hi"]:
            return r["hi"]
        if r["n"] <= _BINS:
            return sorted((x["x"] for x in part.collect()), reverse=True)[k - 1]
        width = (r["hi"] - r["lo"]) / _BINS
        b = F.least(F.floor((F.col("x") - F.lit(r["lo"])) / F.lit(width)), F.lit(_BINS - 1)).cast("int")
        for bin_, n in sorted(((x["b"], x["n"]) for x in part.groupBy(b.alias("b")).agg(
                F.count(F.lit(1)).alias("n")).collect()), reverse=True):
            if k <= n:
                part = part.where(b == bin_)
                break
            k -= n


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", good: str = "quality",
             share: float | None = None, buckets: int = BUCKETS, max_labels: int = MAX_LABELS) -> DataFrame:
    """Per row: ``doc_id, n_words, log_weight, mean_log_ratio, key, kept``;
    ``kept`` rows are the Gumbel top-k sample of ``share`` of all rows (default:
    the share of good labels)."""
    scored = stage(weigh(docs, fit(docs, labels, id_col, text, good, buckets, max_labels), id_col, text), "weights")
    if share is None:
        r = labels.agg(F.avg(F.coalesce(F.col(good), F.lit(0)).cast("double")).alias("s")).first()
        share = 1.0 if r["s"] is None else r["s"]
    limit = kth_largest(scored, "key", round(share * scored.count()))
    kept = F.lit(False) if limit is None else F.col("key") >= F.lit(limit)
    return scored.withColumn("kept", kept)
