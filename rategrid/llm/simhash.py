"""SimHash near-duplicates by anchor-point covering.

Fingerprint: 64 bits over the XXH64 (seed 42) of all 3-word shingles of a
text, repeats included; a bit is 1 if it is set in over half the hashes.

Linking: a covering code supplies anchors.  Bits 0-22 and 23-45 each use the
perfect binary Golay code (covering radius 3), the remaining 18 bits the code
with one word.  Every fingerprint has one home anchor (the codewords within
radius 3 of its blocks).  A partner at distance ``t`` or less lies within
``3 + t_i`` of that anchor's word in block ``i``, with the ``t_i`` summing to
``t`` at most, so every fingerprint is replicated to the anchors whose total
excess over the covering radius is ``t`` or less (about 61 of 2^24).  Home and
replicated fingerprints of one anchor are then compared exactly.  Any two
fingerprints at distance ``t`` or less meet: no candidate is capped or dropped.

Cases: null or blank text has fingerprint zero and links like any other; one
or two words are a single shingle; equal texts share a fingerprint and are
compared once; rows repeating a doc_id each keep their row; a null doc_id
never becomes a component id unless the whole component has none (then it is
null); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rategrid.llm.common import connected_components, prepare, stage

BITS = 64
BLOCK = 23                       # length of the Golay code
RADIUS = 3                       # its covering radius
GOLAY_POLY = 0b101011100011      # x^11+x^9+x^7+x^6+x^5+x+1
MAX_DISTANCE = 2
SHINGLE = 3
_CHUNK = 1 << 15                 # shingle hashes counted at a time
_BUFFER = 1 << 19                # replicated rows compared at a time
_SMALL_CELL = 48                 # cells up to this size are compared by shifts
_FLIP_CELL = 30_000              # cells above this size look flipped words up
_PAIRS = 1 << 22                 # distances computed at a time in larger cells


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a whole text."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    k = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - k + 1
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, _CHUNK):
        a, b = starts[at:min(at + _CHUNK, n)].tolist(), ends[k - 1:][at:min(at + _CHUNK, n)].tolist()
        h = np.array([digest(joined[i:j], 42) for i, j in zip(a, b)], dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    set_bits = np.nonzero(2 * ones > n)[0].tolist()
    return sum(1 << b for b in set_bits)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` per row of ``docs``, ``fp`` as a signed long."""
    prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x.as_py(), shingle) for x in b.column(1)], dtype=np.uint64)
            yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return src.mapInArrow(run, "doc_id long, fp long")


@lru_cache(maxsize=4)
def covering_tables(t: int):
    """Error patterns of the Golay code by syndrome: ``(low, high, start, patterns)``.

    ``low``/``high`` give the syndrome of a block from its low 12 and high 11
    bits; ``start[e][s]:start[e][s+1]`` are the patterns of excess ``e`` (weight
    over the radius) whose removal from a block with syndrome ``s`` leaves a
    codeword.  Excess 0 has exactly one: the code is perfect."""
    def rem(x: int) -> int:
        for i in range(BLOCK - 1, 10, -1):
            if x >> i & 1:
                x ^= GOLAY_POLY << (i - 11)
        return x

    col = [rem(1 << i) for i in range(BLOCK)]
    low, high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
    for i in range(12):
        low[1 << i:2 << i] = low[:1 << i] ^ col[i]
    for i in range(11):
        high[1 << i:2 << i] = high[:1 << i] ^ col[12 + i]
    start, patterns = [], []
    for e in range(t + 1):
        syn, pat = [], []
        for w in (range(RADIUS + 1) if e == 0 else (RADIUS + e,)):
            for bits in combinations(range(BLOCK), w):
                s = p = 0
                for i in bits:
                    s ^= col[i]
                    p |= 1 << i
                syn.append(s)
                pat.append(p)
        syn, pat = np.array(syn), np.array(pat, dtype=np.int64)
        order = np.argsort(syn, kind="stable")
        start.append(np.concatenate(([0], np.cumsum(np.bincount(syn, minlength=1 << 11)))))
        patterns.append(pat[order])
    return low, high, start, patterns


def anchors(fp: np.ndarray, t: int = MAX_DISTANCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, anchor, home)``: each fingerprint at every anchor within covering
    radius plus ``t`` (excess summed over both blocks); ``home`` marks the
    anchor within the radius itself."""
    low, high, start, patterns = covering_tables(t)
    u = fp.astype(np.uint64)
    blocks = [((u >> np.uint64(s)) & np.uint64((1 << BLOCK) - 1)).astype(np.int64) for s in (0, BLOCK)]
    syn = [low[b & 0xFFF] ^ high[b >> 12] for b in blocks]

    def words(i: int, e: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = syn[i][rows]
        first, n = start[e][s], start[e][s + 1] - start[e][s]
        at = np.repeat(np.arange(len(rows)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        code = blocks[i][rows][at] ^ patterns[e][first[at] + k]
        return at, code >> 11  # the message bits name the codeword

    out = []
    every = np.arange(len(u))
    for e1 in range(t + 1):
        at1, c1 = words(0, e1, every)
        for e2 in range(t + 1 - e1):
            at2, c2 = words(1, e2, at1)
            out.append((at1[at2], (c1[at2] << 12) | c2, np.full(len(at2), e1 + e2 == 0)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges reduced to one edge per node: (node, smallest node of its component)."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = ends[:len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        m = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], m)
        np.minimum.at(new, label[j], m)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _flips(t: int) -> np.ndarray:
    return np.array([sum(1 << i for i in c) for w in range(1, t + 1) for c in combinations(range(BITS), w)],
                    dtype=np.uint64)


def _cell(fp: np.ndarray, home: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one large cell: home fingerprints against all, in blocks of
    distances, or (linear in the cell) by looking every flipped word up."""
    own = fp[home]
    a, b = np.empty(0, np.uint64), np.empty(0, np.uint64)

    def add(x, y):
        nonlocal a, b
        a, b = _stars(np.concatenate((a, x)), np.concatenate((b, y)))

    if len(fp) > _FLIP_CELL:
        ordered = np.sort(fp)
        for f in _flips(t):
            want = own ^ f
            at = np.minimum(np.searchsorted(ordered, want), len(ordered) - 1)
            hit = ordered[at] == want
            if hit.any():
                add(own[hit], want[hit])
        return a, b
    step = max(1, _PAIRS // max(1, len(fp)))
    for s in range(0, len(own), step):
        x, y = np.nonzero(np.bitwise_count(own[s:s + step, None] ^ fp[None, :]) <= t)
        if len(x):
            add(own[s:s + step][x], fp[y])
    return a, b


def compare_cells(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the fingerprints of each anchor (rows sorted by anchor):
    those at distance ``t`` or less, reduced to one edge per fingerprint."""
    n = len(anchor)
    cut = np.concatenate(([0], np.nonzero(anchor[1:] != anchor[:-1])[0] + 1, [n]))
    size = np.diff(cut)
    found_a, found_b = [], []
    small = np.repeat((size <= _SMALL_CELL) & (size > 1), size)
    a, f, h = anchor[small], fp[small], home[small]
    live = np.arange(len(a))
    for k in range(1, _SMALL_CELL):
        live = live[live + k < len(a)]
        live = live[a[live] == a[live + k]]
        if not len(live):
            break
        near = live[(h[live] | h[live + k]) & (np.bitwise_count(f[live] ^ f[live + k]) <= t)]
        found_a.append(f[near])
        found_b.append(f[near + k])
    for c in np.nonzero(size > _SMALL_CELL)[0]:
        s = slice(cut[c], cut[c + 1])
        if home[s].any():
            x, y = _cell(fp[s], home[s], t)
            found_a.append(x)
            found_b.append(y)
    if not found_a:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return _stars(np.concatenate(found_a), np.concatenate(found_b))


def links(distinct_fps: DataFrame, t: int = MAX_DISTANCE) -> DataFrame:
    """Edges ``(a, b)`` that connect all fingerprints at distance ``t`` or less
    (their components equal those of all such pairs)."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for s in range(0, len(fp), 5000):
                part = fp[s:s + 5000]
                row, anchor, home = anchors(part, t)
                yield pa.record_batch([pa.array(anchor.astype(np.int32)), pa.array(part[row].view(np.int64)),
                                       pa.array(home)], names=["anchor", "fp", "home"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def flush(last: bool):
            nonlocal held, rows
            anchor, fp, home = (np.concatenate([h[i] for h in held]) for i in range(3))
            end = len(anchor) if last else int(np.searchsorted(anchor, anchor[-1]))
            held = [] if end == len(anchor) else [(anchor[end:], fp[end:], home[end:])]
            rows = len(anchor) - end
            a, b = compare_cells(anchor[:end], fp[:end], home[:end], t)
            return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        limit = _BUFFER
        for x in batches:
            held.append((x.column(0).to_numpy(), x.column(1).to_numpy().view(np.uint64),
                         x.column(2).to_numpy(zero_copy_only=False)))
            rows += x.num_rows
            if rows >= limit:
                yield flush(False)
                limit = max(_BUFFER, 2 * rows)
        if rows:
            yield flush(True)

    spark = distinct_fps.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    spread = distinct_fps.mapInArrow(replicate, "anchor int, fp long, home boolean")
    return (spread.repartition(parts, "anchor").sortWithinPartitions("anchor")
            .mapInArrow(compare, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest doc_id reachable over links of
    ``max_distance`` or fewer differing bits."""
    fps = stage(fingerprints(docs, id_col, text, shingle), "fingerprints")
    return components_of(fps, max_distance).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def components_of(fps: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``(doc_id, fp, root, component_id)`` from staged ``(doc_id, fp)`` rows;
    ``root`` is the smallest fingerprint of the component.

    Copies are reduced to distinct fingerprints (map-side combined) before any
    comparison; the final join attaches the component per fingerprint, with
    adaptive skew splitting for a fingerprint that many rows share."""
    nodes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "distinct-fps")
    roots = connected_components(links(nodes.select("fp"), max_distance))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    component = rooted.select("fp", "root").join(ids, "root").select("fp", "root", "component_id")
    return fps.join(component, "fp").select("doc_id", "fp", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
             max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``docs`` with one row per component: the one with the smallest id (null
    ids count as larger than any other).  If rows repeat that id, the one with
    the component's text stays, one row of equal ones.

    The decision is one narrow row per component; documents meet it in one
    join on their unique id.  Only rows whose id is repeated are looked at
    again by fingerprint."""
    last = F.lit(2**63 - 1)
    key = F.coalesce(F.col(id_col).cast("long"), last)
    narrow = docs.select(key.alias("doc_id"), F.col(text).alias("text"))
    fps = stage(fingerprints(narrow, shingle=shingle), "fingerprints")
    best = components_of(fps, max_distance).groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("m"))
    repeated = fps.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.col("doc_id").alias("_rep"))
    keepers = stage(best.select(F.col("m.doc_id").alias("_keep"), F.col("m.fp").alias("_keep_fp"))
                    .join(repeated, F.col("_keep") == F.col("_rep"), "left")
                    .select("_keep", "_keep_fp", F.col("_rep").isNotNull().alias("_again")), "keepers")
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), key.alias("_key"))
    once = rows.join(keepers.where("NOT _again"), F.col("_key") == F.col("_keep"), "left_semi").select("_row")
    if keepers.where("_again").isEmpty():
        return once.select("_row.*")
    some = stage(rows.join(keepers.where("_again").select("_keep").distinct(), F.col("_key") == F.col("_keep"),
                           "left_semi"), "repeated-ids")
    more = (with_fingerprint(some, f"_row.{text}", "_fp", shingle)
            .join(keepers.where("_again"), (F.col("_key") == F.col("_keep")) & (F.col("_fp") == F.col("_keep_fp")),
                  "left_semi")
            .groupBy("_key", "_fp").agg(F.min("_row").alias("_row")).select("_row"))
    return once.unionByName(more).select("_row.*")


def with_fingerprint(df: DataFrame, text: str, name: str, shingle: int = SHINGLE) -> DataFrame:
    """``df`` with the signed fingerprint of ``text`` (a vectorised function of
    the column; for the few rows that need it beside their other columns)."""
    @F.pandas_udf("long")
    def f(x: pd.Series) -> pd.Series:
        v = np.array([fingerprint(None if t is None else t, shingle) for t in x], dtype=np.uint64)
        return pd.Series(v.view(np.int64))

    return df.withColumn(name, f(F.col(text).cast("string")))
