"""Vector code compression (product codes) by dual-tree Lloyd rounds.

Components become integers ``floor(scale * x)``; a vector is cut into equal
consecutive parts, and every part position has a codebook, which starts as that
part of the vectors with the smallest ids.

Vectors are kept in blocks of a bounded number of rows.  For every part position
a block holds a balanced tree over its parts (split at the median of the widest
component, built once, stored as an order of the rows); the boxes and the cached
sums and counts of its nodes follow from that order.  A second such tree is built
over the codebook's entries.  A round descends both trees together: a pair of
nodes whose smallest possible distance exceeds the smallest of the largest
possible distances of the same part node is pruned.  A part node left with a
single entry is assigned whole, through its cached sum and count; parts of leaves
with several entries left are compared in integers, ties to the lower index.
Distances, sums and the floor of sum over count are whole numbers throughout.

A task adds up its blocks and sends one row per used entry and component; the
driver holds the codebooks only (``parts * entries`` short integer vectors).

Cases: vectors that are null or hold null or non-finite components take no part;
shorter vectors are padded with zeros, and all up to a multiple of ``parts``; rows
repeating an id, and rows with a null id, keep their rows; of a repeated id the
smallest vector may start an entry, a null id never does; fewer ids than entries
give a smaller codebook (none at all: no rows, if every id is null); integers
beyond 64 bits saturate, and an error or label error beyond 64 bits is null; labels
are compared as text, nulls together; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rategrid.llm.common import prepare, stage
from rategrid.llm.whitening import integers, padded
from rategrid.operators.skew import key_join

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
BLOCK = 4096                     # vectors of a block at most
LEAF = 16                        # parts of a leaf at most
_HALF = 10**18


def halvings(n: int, leaf: int) -> list[np.ndarray]:
    """Node borders of every level of a balanced tree over ``n`` rows."""
    levels = [np.array([0, n])]
    while n and np.diff(levels[-1]).max() > leaf:
        b = levels[-1]
        mid = (b[:-1] + b[1:]) // 2
        levels.append(np.concatenate([np.stack([b[:-1], mid], axis=1).ravel(), b[-1:]]))
    return levels


def tree_order(points: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Order of the rows that makes every node of ``levels`` one run of rows: nodes
    are halved at the median of their widest component."""
    order = np.arange(len(points))
    for upper, lower in zip(levels, levels[1:]):
        for k in range(len(upper) - 1):
            a, b, mid = upper[k], upper[k + 1], lower[2 * k + 1]
            rows = order[a:b]
            p = points[rows]
            axis = np.argmax(p.max(axis=0) - p.min(axis=0))
            order[a:b] = rows[np.argpartition(p[:, axis], mid - a)]
    return order


class Tree:
    """Boxes, sums and counts of the nodes of every level (level 0: the root)."""

    def __init__(self, points: np.ndarray, levels: list[np.ndarray]):
        self.points, self.levels = points, levels            # points in tree order
        last = levels[-1][:-1]
        self.low = [np.minimum.reduceat(points, last, axis=0)]
        self.high = [np.maximum.reduceat(points, last, axis=0)]
        self.sum = [np.add.reduceat(points, last, axis=0)]
        for _ in levels[1:]:
            self.low.insert(0, np.minimum(self.low[0][::2], self.low[0][1::2]))
            self.high.insert(0, np.maximum(self.high[0][::2], self.high[0][1::2]))
            self.sum.insert(0, self.sum[0][::2] + self.sum[0][1::2])
        self.count = [np.diff(b) for b in levels]
        self.depth = len(levels) - 1


class EntryTree(Tree):
    """Tree over codebook entries down to single ones.  The number of leaves is a
    power of two, so the last entry may stand in several."""

    def __init__(self, entries: np.ndarray):
        k = len(entries)
        full = 1 << max(0, k - 1).bit_length()
        levels = halvings(full, 1)
        repeated = entries[np.minimum(np.arange(full), k - 1)]
        order = tree_order(repeated, levels)
        super().__init__(repeated[order], levels)
        self.index = np.minimum(order, k - 1)


def assign(tree: Tree, entries: EntryTree) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Nearest entries of all parts of ``tree``: whole nodes as (level, nodes, entry
    of each), and the rows compared one by one with their entries."""
    whole = []
    p, e = np.zeros(1, np.int64), np.zeros(1, np.int64)
    lp = le = 0
    while True:
        low = np.maximum(tree.low[lp][p] - entries.high[le][e], entries.low[le][e] - tree.high[lp][p])
        low = np.maximum(low, 0)
        high = np.maximum(tree.high[lp][p] - entries.low[le][e], entries.high[le][e] - tree.low[lp][p])
        near, far = (low * low).sum(axis=1), (high * high).sum(axis=1)
        start = np.nonzero(np.r_[True, p[1:] != p[:-1]])[0]
        bound = np.repeat(np.minimum.reduceat(far, start), np.diff(np.r_[start, len(p)]))
        keep = near <= bound
        p, e = p[keep], e[keep]
        if le == entries.depth:
            start = np.nonzero(np.r_[True, p[1:] != p[:-1]])[0]
            size = np.diff(np.r_[start, len(p)])
            single = np.repeat(size == 1, size)
            if single.any():
                whole.append((lp, p[single], entries.index[e[single]]))
                p, e = p[~single], e[~single]
            if not len(p) or lp == tree.depth:
                break
        if lp < tree.depth:
            p, e = np.repeat(2 * p, 2), np.repeat(e, 2)
            p[1::2] += 1
            lp += 1
        if le < entries.depth:
            p, e = np.repeat(p, 2), np.repeat(2 * e, 2)
            e[1::2] += 1
            le += 1
        order = np.lexsort((e, p))
        p, e = p[order], e[order]
    if not len(p):
        return whole, np.zeros(0, np.int64), np.zeros(0, np.int64)
    # uncertain leaves: every row against the entries its leaf has left, in integers
    start = np.nonzero(np.r_[True, p[1:] != p[:-1]])[0]
    size = np.diff(np.r_[start, len(p)])
    leaf = p[start]
    border = tree.levels[-1]
    n_rows = border[leaf + 1] - border[leaf]
    rows = np.repeat(border[leaf] - (np.cumsum(n_rows) - n_rows), n_rows) + np.arange(n_rows.sum())
    width, first = np.repeat(size, n_rows), np.repeat(start, n_rows)
    at = np.cumsum(width) - width
    pair = np.repeat(first - at, width) + np.arange(width.sum())
    diff = np.repeat(tree.points[rows], width, axis=0) - entries.points[e[pair]]
    index = entries.index[e[pair]]
    best = np.minimum.reduceat((diff * diff).sum(axis=1) * ENTRY_KEY + index, at)
    return whole, rows, best % ENTRY_KEY


ENTRY_KEY = 256                  # entries of a codebook at most; distance * ENTRY_KEY + index orders the pairs


def fits(points: np.ndarray, entries: np.ndarray) -> bool:
    """Whether keyed squared distances stay within 64 bits."""
    if points.dtype == object or entries.dtype == object:
        return False
    top = max(float(np.abs(points.astype(float)).max(initial=0)), float(np.abs(entries.astype(float)).max(initial=0)))
    return 4 * top * top * max(1, points.shape[1]) * ENTRY_KEY < 2.0**62


def nearest_plain(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Nearest entries in Python integers, for components too large for 64-bit squares."""
    out = []
    e = entries.astype(object)
    for x in points.astype(object):
        d = ((e - x) ** 2).sum(axis=1)
        out.append(min(range(len(e)), key=lambda k: (d[k], k)))
    return np.array(out, np.int64)


class Block:
    """A block of vectors with the tree order of every part position."""

    def __init__(self, m: np.ndarray, orders: np.ndarray, parts: int):
        self.m, self.orders, self.parts = m, orders, parts
        self.w = m.shape[1] // parts
        self.levels = halvings(len(m), LEAF)

    @staticmethod
    def order(m: np.ndarray, parts: int) -> np.ndarray:
        w, levels = m.shape[1] // parts, halvings(len(m), LEAF)
        return np.stack([tree_order(m[:, p * w:(p + 1) * w].astype(float), levels) for p in range(parts)]).astype(np.int32)

    def part(self, p: int) -> np.ndarray:
        return self.m[:, p * self.w:(p + 1) * self.w][self.orders[p]]

    def totals(self, p: int, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum and number of the parts nearest to each entry."""
        points = self.part(p)
        if not fits(points, entries):
            label = nearest_plain(points, entries)
            sums = np.zeros((len(entries), self.w), object)
            np.add.at(sums, label, points.astype(object))
            return sums, np.bincount(label, minlength=len(entries))
        sums, counts = np.zeros((len(entries), self.w), np.int64), np.zeros(len(entries), np.int64)
        tree = Tree(points, self.levels)
        whole, rows, label = assign(tree, EntryTree(entries))
        for level, nodes, entry in whole:
            np.add.at(sums, entry, tree.sum[level][nodes])
            np.add.at(counts, entry, tree.count[level][nodes])
        np.add.at(sums, label, points[rows])
        np.add.at(counts, label, 1)
        return sums, counts

    def labels(self, p: int, entries: np.ndarray) -> np.ndarray:
        """Nearest entry of every row (in the block's own order)."""
        points = self.part(p)
        found = np.zeros(len(points), np.int64)
        if not fits(points, entries):
            found = nearest_plain(points, entries)
        else:
            whole, rows, label = assign(Tree(points, self.levels), EntryTree(entries))
            for level, nodes, entry in whole:
                border = self.levels[level]
                for k, v in zip(nodes, entry):
                    found[border[k]:border[k + 1]] = v
            found[rows] = label
        out = np.zeros(len(points), np.int64)
        out[self.orders[p]] = found
        return out


def blocks(rows: DataFrame, width: int, parts: int, block_rows: int) -> DataFrame:
    """One row per block of at most ``block_rows`` vectors: ids, label keys, the
    matrix and the tree orders as binary.  Blocks are cut from the rows as a task
    reads them; nothing is shuffled."""

    def flush(ids: list, labels: list, held: list) -> pa.RecordBatch:
        m = np.concatenate(held)
        return pa.record_batch([pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(pa.string())),
                                pa.array([m.tobytes()], pa.binary()),
                                pa.array([Block.order(m, parts).tobytes()], pa.binary())],
                               names=["ids", "labels", "m", "orders"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, held = [], [], []
        for b in batches:
            m = b.column(2).flatten().to_numpy().reshape(b.num_rows, width)
            at = 0
            while at < b.num_rows:
                to = min(b.num_rows, at + block_rows - len(ids))
                ids += b.column(0)[at:to].to_pylist()
                labels += b.column(1)[at:to].to_pylist()
                held.append(m[at:to])
                at = to
                if len(ids) == block_rows:
                    yield flush(ids, labels, held)
                    ids, labels, held = [], [], []
        if ids:
            yield flush(ids, labels, held)

    return rows.select("vec_id", "label", "x").mapInArrow(
        run, "ids array<long>, labels array<string>, m binary, orders binary")


def _block(b: pa.RecordBatch, i: int, width: int, parts: int) -> Block:
    m = np.frombuffer(b.column("m")[i].as_py(), np.int64).reshape(-1, width)
    orders = np.frombuffer(b.column("orders")[i].as_py(), np.int32).reshape(parts, len(m))
    return Block(m, orders, parts)


def lloyd_round(staged: DataFrame, books: np.ndarray, width: int, parts: int) -> np.ndarray:
    """Codebooks (parts x entries x components) after one assignment: the floor
    of the mean of each entry's parts; unused entries stay."""
    w = width // parts
    k = books.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, k, w), object), np.zeros((parts, k), np.int64)
        for b in batches:
            for i in range(b.num_rows):
                block = _block(b, i, width, parts)
                for p in range(parts):
                    s, c = block.totals(p, books[p])
                    sums[p] += s
                    counts[p] += c
        at = np.nonzero(counts.ravel())[0]
        values = [[int(v) for v in row] for row in sums.reshape(parts * k, w)[at]]
        halves = [[[Decimal(h(v, _HALF)) for v in row] for row in values] for h in (int.__floordiv__, int.__mod__)]
        kind = pa.decimal128(38, 0)
        slots = [int(a) * w + j for a in at for j in range(w)]
        yield pa.record_batch([pa.array(slots, pa.int64()), *(pa.array(sum(h, []), kind) for h in halves),
                               pa.array(np.repeat(counts.ravel()[at], w))], names=["slot", "high", "low", "n"])

    got = (staged.select("m", "orders").mapInArrow(run, "slot long, high decimal(38,0), low decimal(38,0), n long")
           .groupBy("slot").agg(F.sum("high").alias("h"), F.sum("low").alias("l"), F.sum("n").alias("n")).collect())
    new = books.astype(object).ravel()
    for r in got:
        new[r["slot"]] = (int(r["h"]) * _HALF + int(r["l"])) // r["n"]
    return _narrow(new.reshape(books.shape))


def _narrow(books: np.ndarray) -> np.ndarray:
    return books.astype(np.int64) if all(-2**63 <= v < 2**63 for v in books.ravel()) else books


def encode(staged: DataFrame, books: np.ndarray, width: int, parts: int) -> DataFrame:
    """``vec_id, label, code, error`` of every vector of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block = _block(b, i, width, parts)
                n, w = len(block.m), block.w
                labels = np.stack([block.labels(p, books[p]) for p in range(parts)], axis=1)
                near = np.concatenate([books[p][labels[:, p]] for p in range(parts)], axis=1)
                if fits(block.m, near):
                    d = block.m - near
                else:
                    d = block.m.astype(object) - near.astype(object)
                text = labels.astype(np.uint8).tobytes().hex()
                error = (d * d).sum(axis=1)
                yield pa.record_batch([
                    b.column("ids")[i].values, b.column("labels")[i].values,
                    pa.array([text[j * 2 * parts:(j + 1) * 2 * parts] for j in range(n)], pa.string()),
                    pa.array([int(v) if v < 2**63 else None for v in error], pa.int64())],
                    names=["vec_id", "label", "code", "error"])

    return staged.mapInArrow(run, "vec_id long, label string, code string, error long")


def first_entries(rows: DataFrame, width: int, parts: int, entries: int) -> np.ndarray:
    """Starting codebooks: the parts of the vectors with the smallest ids (a
    top-``entries``, so the driver gets that many vectors)."""
    ids = [r["vec_id"] for r in rows.select("vec_id").where(F.col("vec_id").isNotNull()).distinct()
           .orderBy("vec_id").limit(entries).collect()]
    first = rows.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("x").alias("x")).collect() if ids else []
    m = np.array([r["x"] for r in sorted(first, key=lambda r: r["vec_id"])], np.int64).reshape(len(first), width)
    return m.reshape(len(first), parts, width // parts).transpose(1, 0, 2).copy()


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' decimal components, comma-joined."""
    return hashlib.sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()


def compress(table: DataFrame, id_col: str = "vec_id", vec: str = "embedding", label: str = "label",
             scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             block_rows: int = BLOCK) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every row that
    takes part.  Eager: rows, blocks and codes are staged."""
    spark = prepare(table.sparkSession)
    if not 0 < entries <= ENTRY_KEY:
        raise ValueError(f"entries must be in 1 .. {ENTRY_KEY}")
    key = F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit(""))
    rows = stage(integers(table.select(F.col(id_col).alias("vec_id"), F.col(vec).alias("_v"), key.alias("label")),
                          "vec_id", "_v", scale, ("label",)), "code-rows")
    sizes = rows.agg(F.min(F.size("x")).alias("lo"), F.max(F.size("x")).alias("hi")).first()
    width = -(-max(1, sizes["hi"] or 0) // parts) * parts
    if sizes["lo"] != width:
        rows = padded(rows, width)
    books = first_entries(rows, width, parts, entries)
    if not books.shape[1]:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    # one block of vectors and its orders is the unit a task holds
    staged = stage(blocks(rows, width, parts, block_rows), "code-blocks")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        for _ in range(rounds):
            books = lloyd_round(staged, books, width, parts)
        codes = stage(encode(staged, books, width, parts), "codes")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    totals = codes.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    out = key_join(codes, totals, None, "label", by=["vec_id", "code"])
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _assignment(books: str) -> str:
    return f"""
  SELECT x.vec_id, x.p, arg_min(b.k, d * {ENTRY_KEY} + b.k) AS k, min(d) AS d
  FROM (SELECT q.vec_id, q.p, q.x, b.k,
               list_sum(list_transform(list_zip(q.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM parts q JOIN {books} b ON q.p = b.p) x JOIN {books} b ON b.p = x.p AND b.k = x.k
  GROUP BY x.vec_id, x.p"""


def _update(books: str, labels: str) -> str:
    return f"""
  SELECT b.p, b.k, coalesce(u.c, b.c) AS c
  FROM {books} b LEFT JOIN (
    SELECT p, k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c
    FROM (SELECT a.p, a.k, t.i, sum(q.x[t.i])::BIGINT AS s, count(*)::BIGINT AS n
          FROM {labels} a JOIN parts q ON q.vec_id = a.vec_id AND q.p = a.p, (SELECT unnest(range(1, (SELECT max(w) FROM v) + 1)) AS i) t
          GROUP BY a.p, a.k, t.i)
    GROUP BY p, k) u ON u.p = b.p AND u.k = b.k"""


SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS e, len(embedding) // 16 AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, p, list_slice(e, p * w + 1, (p + 1) * w) AS x
  FROM v, (SELECT unnest(range(0, 16)) AS p) t),
c0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, x AS c
  FROM parts WHERE vec_id IN (SELECT vec_id FROM v WHERE vec_id IS NOT NULL ORDER BY vec_id LIMIT 64)),
a0 AS MATERIALIZED ({_assignment("c0")}),
c1 AS MATERIALIZED ({_update("c0", "a0")}),
a1 AS MATERIALIZED ({_assignment("c1")}),
c2 AS MATERIALIZED ({_update("c1", "a1")}),
a2 AS MATERIALIZED ({_assignment("c2")}),
coded AS (
  SELECT v.vec_id, any_value(v.label) AS label, string_agg(printf('%02x', a2.k), '' ORDER BY a2.p) AS code,
         sum(a2.d)::BIGINT AS error
  FROM a2 JOIN v ON v.vec_id = a2.vec_id GROUP BY v.vec_id),
h AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded, h
"""
