"""Exact top-k inner products with an impact-ordered, score-at-a-time index.

Components become integers ``floor(scale * x)``.  The rows are dealt into blocks
of a bounded number of vectors by a hash of their id, and every block is
indexed for itself: per dimension its postings in order of quantised value,
cut into segments (one quantised value each).  For a query with component
``q > 0`` a posting's impact is ``q * (v - min)``, for ``q < 0`` it is ``|q| * (max - v)``;
both are non-negative and differ from ``q * v`` by a constant of the query, so
scores are sums of impacts.

A block processes the segments of all dimensions in order of descending
quantised impact.  After each round a vector's score is at least its
accumulated lower bounds and at most the accumulated upper bounds plus, for
every dimension whose posting of it is still unread, the highest impact left
there.  A vector whose upper bound is below the
``k``-th best lower bound (or the threshold proven on the seed block) cannot be a
member; the block stops once few others remain (or all segments are read) and
rescores them exactly in integers.  The per-block results (at most ``k`` a query) are merged by
a top-k per query.

Cases: vectors that are null or hold null or non-finite components, and rows
without an id, take no part; rows repeating an id count once (the smallest
vector); vectors of unequal length are padded with zeros; ties go to the
smaller id; fewer than ``k`` candidates give fewer rows; an empty table gives an
empty result; extra columns are ignored.  Vectors with components too large for
exact floating-point bounds are kept out of the index and scored by themselves in
Python integers, as every vector is for such a query; integers beyond 64 bits, and
scores beyond them, saturate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rategrid.llm.common import prepare, stage

K = 10
SCALE = 1024
EVERY = 100                      # queries: ids divisible by this
BLOCK = 8192                     # expected vectors of a block
QUERY_BLOCK = 64                 # queries that meet a block at a time
LEVELS = 128                     # quantised values per dimension
ROUNDS = (0.2, 0.4, 0.5, 0.6, 0.75, 1.0)   # shares of the postings after which the bounds are looked at
RESCORE = 4                      # rescoring a quarter of a block costs less than reading on


def largest_indexed(width: int) -> int:
    """Largest component for which sums of ``width`` impacts are exact in doubles."""
    return int((2.0**51 / max(1, width)) ** 0.5)


def exact_scores(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in Python integers, saturated at 64 bits."""
    low, high = -2**63, 2**63 - 1
    return np.array([min(high, max(low, int(s))) for s in rows.astype(object) @ q.astype(object)], np.int64)


class Block:
    """A block's vectors: those with ordinary components indexed, the others apart."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        # compared as numbers, not by abs(): the least 64-bit integer has none
        self.limit = largest_indexed(vectors.shape[1])
        wide = ((vectors > self.limit) | (vectors < -self.limit)).any(axis=1)
        self.ids, self.v = ids, vectors
        self.index = BlockIndex(ids[~wide], vectors[~wide]) if not wide.all() else None
        self.wide_ids, self.wide = ids[wide], vectors[wide]

    def search(self, q: np.ndarray, own: int, k: int, threshold: int | None) -> tuple[np.ndarray, np.ndarray]:
        if ((q > self.limit) | (q < -self.limit)).any():
            ids, scores = self.ids, exact_scores(self.v, q)
        elif len(self.wide_ids):
            found = self.index.search(q, own, k, threshold)[:2] if self.index is not None else (self.ids[:0], self.ids[:0])
            ids = np.concatenate([found[0], self.wide_ids])
            scores = np.concatenate([found[1], exact_scores(self.wide, q)])
        else:
            return self.index.search(q, own, k, threshold)[:2]
        keep = ids != own
        if threshold is not None:
            keep &= scores >= threshold
        ids, scores = ids[keep], scores[keep]
        best = np.lexsort((ids, [-int(s) for s in scores] if len(scores) and scores.min() == -2**63 else -scores))[:k]
        return ids[best], scores[best]


class BlockIndex:
    """Impact-ordered postings of one block of integer vectors: per dimension the
    rows in order of quantised value, cut into one segment per value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: int = LEVELS):
        self.ids, self.v, self.levels = ids, vectors, levels
        n, dims = vectors.shape
        self.low, self.high = vectors.min(axis=0), vectors.max(axis=0)
        width = np.maximum(1, -(-(self.high - self.low + 1) // levels))
        self.level = ((vectors - self.low) // width).astype(np.int16)               # 0 .. levels - 1
        self.postings = np.argsort(self.level.T, axis=1, kind="stable").astype(np.int32).ravel()
        self.size = np.stack([np.bincount(self.level[:, d], minlength=levels) for d in range(dims)], axis=1)
        self.start = np.cumsum(self.size, axis=0) - self.size + n * np.arange(dims)  # of (level, dimension)
        edges = np.arange(levels + 1)[:, None] * width + self.low                    # values at level borders
        self.lower = np.minimum(np.maximum(edges[:-1], self.low), self.high)
        self.upper = np.minimum(edges[1:] - 1, self.high)

    def search(self, q: np.ndarray, own: int, k: int, threshold: int | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Exact ``k`` best ``(ids, scores)`` of the block for query vector ``q``
        that can reach ``threshold``, without the row ``own``; and the postings read."""
        n = len(self.ids)
        alive = self.ids != own
        dims = np.nonzero(q)[0]
        read = 0
        if len(dims):
            up = q[dims] > 0
            w = np.abs(q[dims]).astype(float)
            base = float((np.where(up, self.low[dims], self.high[dims]) * q[dims]).sum())
            # impact bounds of every segment (level, dimension)
            lo = np.where(up, self.lower[:, dims] - self.low[dims], self.high[dims] - self.upper[:, dims]) * w
            hi = np.where(up, self.upper[:, dims] - self.low[dims], self.high[dims] - self.lower[:, dims]) * w
            loose = np.maximum((hi - lo).max(axis=0), 0)
            order = np.argsort(-hi, axis=None, kind="stable")
            size, start = self.size[:, dims], self.start[:, dims]
            read_by = np.cumsum(size.ravel()[order])
            level = self.level if len(dims) == self.level.shape[1] else self.level[:, dims]
            acc, at = np.zeros(n), 0
            done = np.zeros(len(dims), np.int64)          # segments read per dimension, from the high-impact end
            for share in ROUNDS:
                to = min(len(order), int(np.searchsorted(read_by, share * read_by[-1])) + 1)
                lev, c = np.divmod(order[at:to], len(dims))
                at = to
                count = size[lev, c]
                rows = self.postings[np.repeat(start[lev, c] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
                acc += np.bincount(rows, weights=np.repeat(lo[lev, c], count), minlength=n)
                read += len(rows)
                done += np.bincount(c, minlength=len(dims))
                # highest impact left per dimension; rows whose posting of a dimension is read
                nxt = np.where(up, self.levels - 1 - done, done)
                more = done < self.levels
                left = np.where(more, hi[np.clip(nxt, 0, self.levels - 1), np.arange(len(dims))], 0.0)
                seen = (level >= np.where(up, self.levels - done, done)) ^ ~up
                lower = base + acc
                upper = lower + left.sum() + seen.astype(float) @ (loose - left)
                live = np.nonzero(alive)[0]
                if not len(live):
                    break
                bound = -np.inf if threshold is None else float(threshold)
                if len(live) >= k:
                    bound = max(bound, np.partition(lower[live], len(live) - k)[len(live) - k])
                alive[live] = upper[live] >= bound
                if alive.sum() <= max(4 * k, n // RESCORE):
                    break
        live = np.nonzero(alive)[0]
        exact = self.v[live] @ q
        if threshold is not None:
            keep = exact >= threshold
            live, exact = live[keep], exact[keep]
        best = np.lexsort((self.ids[live], -exact))[:k]
        return self.ids[live][best], exact[best], read


def vectors(table: DataFrame, id_col: str = "vec_id", vec: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id, v`` (array of long) of the rows that take part, one per id."""
    x = F.transform(F.col(vec), lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return (table.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
            .where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & finite)
            .select("vec_id", F.transform("x", lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("v"))
            .groupBy("vec_id").agg(F.min("v").alias("v")))


def _matrix(column, width: int) -> np.ndarray:
    rows = column.to_pylist()
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def pack(rows: DataFrame, block: str, width: int) -> DataFrame:
    """One row per block: ids and a matrix as binary (a block has a bounded
    expected number of vectors)."""

    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("vec_id").to_numpy(), kind="stable")
        ids = t.column("vec_id").to_numpy()[order]
        m = _matrix(t.column("v"), width)[order]
        return pa.table({"block": t.column("block")[:1], "ids": pa.array([ids.tobytes()], pa.binary()),
                         "m": pa.array([m.tobytes()], pa.binary())})

    return rows.select(F.col(block).alias("block"), "vec_id", "v").groupBy("block").applyInArrow(
        run, "block int, ids binary, m binary")


def search(blocks: DataFrame, asked: DataFrame, width: int, k: int) -> DataFrame:
    """Top ``k`` of every (vector block, query block) pair.

    ``asked`` names the vector block a query block is sent to.  A block moves once
    and the (small) query blocks follow it in the same partition, so its index is
    built once and no task holds more than one index and one batch of queries."""
    rows = blocks.select("block", F.lit(0).alias("kind"), "ids", "m", F.lit(None).cast("binary").alias("limits")).unionByName(
        asked.select("block", F.lit(1).alias("kind"), F.col("q_ids").alias("ids"), F.col("q").alias("m"), "limits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, index = None, None
        for b in batches:
            for i in range(b.num_rows):
                block = b.column(0)[i].as_py()
                ids = np.frombuffer(b.column(2)[i].as_py(), np.int64)
                m = np.frombuffer(b.column(3)[i].as_py(), np.int64).reshape(len(ids), width)
                if b.column(1)[i].as_py() == 0:
                    held, index = block, (ids, m)
                    continue
                if block != held:
                    continue                                  # a block without vectors
                if isinstance(index, tuple):
                    index = Block(*index)
                limit = b.column(4)[i].as_py()
                limit = np.frombuffer(limit, np.int64) if limit is not None else None
                yield hits(index, ids, m, limit, k)

    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(parts, "block").sortWithinPartitions("block", "kind")
    return ordered.mapInArrow(run, "query_id long, vec_id long, score long")


def hits(block: Block, ids: np.ndarray, queries: np.ndarray, limit: np.ndarray | None, k: int) -> pa.RecordBatch:
    """Top ``k`` of a block for a batch of queries, as (query_id, vec_id, score)."""
    out_q, out_v, out_s = [], [], []
    for j, own in enumerate(ids.tolist()):
        t = None if limit is None or limit[j] == np.iinfo(np.int64).min else int(limit[j])
        v, s = block.search(queries[j], own, k, t)
        out_q.append(np.full(len(v), own, np.int64))
        out_v.append(v)
        out_s.append(s)
    return pa.record_batch([pa.array(np.concatenate(x), pa.int64()) for x in (out_q, out_v, out_s)],
                           names=["query_id", "vec_id", "score"])


def search_seed(block: tuple[bytes, bytes], asked: DataFrame, width: int, k: int) -> DataFrame:
    """Top ``k`` of one block (its ids and matrix) for all queries: the block, bounded
    in size, goes to the query blocks, wherever they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.frombuffer(block[0], np.int64)
        index = Block(ids, np.frombuffer(block[1], np.int64).reshape(len(ids), width))
        for b in batches:
            for i in range(b.num_rows):
                own = np.frombuffer(b.column(0)[i].as_py(), np.int64)
                yield hits(index, own, np.frombuffer(b.column(1)[i].as_py(), np.int64).reshape(len(own), width), None, k)

    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return asked.select("q_ids", "q").repartition(parts).mapInArrow(run, "query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(table: DataFrame, id_col: str = "vec_id", vec: str = "embedding", k: int = K, every: int = EVERY,
          scale: int = SCALE, block_rows: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows for every query."""
    spark = prepare(table.sparkSession)
    v = stage(vectors(table, id_col, vec, scale), "vectors")
    s = v.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("w")).first()
    n, width = s["n"], s["w"] or 0
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n_blocks = -(-n // block_rows)
    blocks = stage(pack(v.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int")), "block",
                        max(1, width)), "vector-blocks")
    queries = v.where(F.col("vec_id") % every == 0)
    n_queries = queries.count()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    q_blocks = -(-n_queries // QUERY_BLOCK)
    q = stage(pack(queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(q_blocks)).cast("int")),
                   "block", max(1, width)), "query-blocks")
    asked = q.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("m").alias("q"))
    first, *seed_block = blocks.orderBy("block").limit(1).first()

    # seed block: its k-th best score is a proven threshold for the other blocks
    seed = stage(search_seed((bytes(seed_block[0]), bytes(seed_block[1])), asked, max(1, width), k), "seed-hits")
    kth = seed.groupBy("query_id").agg(F.min("score").alias("t"), F.count(F.lit(1)).alias("c"))
    limits = kth.where(F.col("c") == k).select("query_id", "t")

    def pack_limits(t: pa.Table) -> pa.Table:
        ids = np.frombuffer(t.column("q_ids")[0].as_py(), np.int64)
        known = dict(zip(t.column("query_id").to_pylist(), t.column("t").to_pylist()))
        low = np.iinfo(np.int64).min
        values = np.array([known.get(i, low) if known.get(i) is not None else low for i in ids.tolist()], np.int64)
        return pa.table({"q_block": t.column("q_block")[:1], "q_ids": t.column("q_ids")[:1], "q": t.column("q")[:1],
                         "limits": pa.array([values.tobytes()], pa.binary())})

    slot = F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(q_blocks)).cast("int")
    with_limits = stage(asked.join(limits.withColumn("q_block", slot), "q_block", "left").groupBy("q_block").applyInArrow(
        pack_limits, "q_block int, q_ids binary, q binary, limits binary"), "query-limits")
    targets = blocks.where(F.col("block") != first)
    # every query block meets every vector block; the query blocks, a small part of the data, are repeated
    sent = with_limits.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).where(F.col("block") != first)
    rest = search(targets, sent, max(1, width), k)
    return _ranked(seed.unionByName(rest), k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
