"""Best-fit packing of tokenised documents by large-item matching.

Every document becomes its token ids and an end id; only documents longer than
``capacity`` are cut, into pieces of ``capacity`` ids (the first piece takes the
remainder).  How pieces of equal length are placed does not depend on which
piece is which, so the packing is planned on the histogram of lengths alone: at
most ``capacity`` counts, whatever the size of the corpus.

* Large items (above a third of the capacity) share a sequence with at most one
  other large item.  From the longest down, each is matched with the longest
  unmatched one that still fits, whole counts at a time.
* Smaller items, longest first, go to the smallest gap that holds them (best fit)
  and open a sequence where no gap does.

A placement names a length, a range of ranks among the pieces of that length, the
first of a run of sequence numbers, how many items each of these takes, and the
offset.  The plan has a few thousand placements at most.  The pieces get their
rank within their length from their place in the staged table (file and row, in
blocks of bounded size), so equal rows and a hot length need no group sorted in
one task; a binary search in the plan gives sequence and offset.

Token ids equal those of the ``tokenizers`` library for the vocabulary file.  The
file's own vocabulary is given to a faster engine (merging the pair whose union
has the lowest id is the same thing where ids ascend with the merges and every
token is what the merges make of its bytes).  Texts that hold a character whose
class differs between Unicode versions are left to the library.

Cases: null or empty text is the end id alone; rows repeating an id each keep
their pieces; a null id keeps its row; a special string inside a text is one
token, as the library does by default; a very long text is encoded in cuts
before white space, where a pre-token ends whatever follows; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rategrid.llm.common import prepare, stage
from rategrid.llm.tokencount import PATTERN, byte_symbols, default_vocabulary

CAPACITY = 1024
END_ID = 2
CUT = 1 << 18                    # characters encoded at once
LONG_WORD = 1 << 12              # texts with a longer run without white space go to the library
ROW_BLOCK = 4096                 # rows ranked together

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids of whole texts as the ``tokenizers`` library gives them."""

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, sym = spec["model"]["vocab"], byte_symbols()
        specials = spec["added_tokens"]
        self.special = {t["content"]: t["id"] for t in specials}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [ids[a + b] for a, b in merges]
        plain = (spec["model"]["type"] == "BPE" and spec["normalizer"] is None
                 and spec["pre_tokenizer"].get("type") == "ByteLevel" and not spec["pre_tokenizer"]["add_prefix_space"]
                 and all(x < y for x, y in zip(made, made[1:]))
                 and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in specials))
        self.fast = None
        if plain:
            ranks = {bytes(sym[c] for c in t): i for t, i in ids.items() if t not in self.special}
            self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut_special = regex.compile("(" + "|".join(
            map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.settled = settled_characters()
        self.sync = regex.compile(r"(?<=\S)\s")

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.cuts(text):
            if self.fast is None or has_long_word(part) or not (part.isascii() or self.settled.issuperset(part)):
                out += self.library.encode(part, add_special_tokens=False).ids
            elif self.cut_special is not None and any(s in part for s in self.special):
                for x in self.cut_special(part):
                    if x in self.special:
                        out.append(self.special[x])
                    elif x:
                        out += self.fast.encode_ordinary(x)
            else:
                out += self.fast.encode_ordinary(part)
        return out

    def cuts(self, text: str) -> Iterator[str]:
        """The text in parts of about ``CUT`` characters, cut only before white
        space that follows another character."""
        at = 0
        while len(text) - at > 2 * CUT:
            m = self.sync.search(text, at + CUT)
            if m is None:
                break
            yield text[at:m.start()]
            at = m.start()
        yield text[at:] if at else text


def has_long_word(text: str) -> bool:
    return len(text) > LONG_WORD and max(map(len, text.split()), default=0) > LONG_WORD


def settled_characters() -> frozenset[str]:
    """Characters that every Unicode version since 3.2 puts in the same class
    (letter, number, white space, other)."""
    import unicodedata

    old = unicodedata.ucd_3_2_0

    def kind(db, c: str) -> str:
        cat = db.category(c)
        return cat if cat == "Cn" else cat[0] if cat[0] in "LNZ" else "x"

    # U+0085 and U+180E count as white space in some versions and engines only
    return frozenset(c for c in map(chr, range(0x30000)) if c not in "\x85\u180e" and not 0xD800 <= ord(c) < 0xE000
                     and kind(old, c) != "Cn" and kind(old, c) == kind(unicodedata, c))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
           id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece of every document."""
    prepare(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                      F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.array([*enc.encode(t.as_py()), end_id], dtype="<u4")
                first = (len(ids) - 1) % capacity + 1
                at = 0
                for k in range(-(-len(ids) // capacity)):
                    to = first + k * capacity
                    doc.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(ids[at:to].tobytes()))
                    at = to
            yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                                   pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                                  names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return src.mapInArrow(run, _PIECES)


class Plan:
    """Placements of all pieces, from the number of pieces of every length.

    Placement: pieces ``rank .. rank + items`` of a ``length`` fill the sequences from
    ``first`` on, ``per`` in each, side by side from ``offset``."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        if any(not 0 < s <= capacity for s in counts):
            raise ValueError("a length outside 1 .. capacity")
        self.capacity, self.sequences = capacity, 0
        self.left = [counts.get(s, 0) for s in range(capacity + 1)]
        self.rank = [0] * (capacity + 1)
        self.gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]   # gap -> runs (first, number)
        self.placements: list[tuple[int, int, int, int, int, int]] = []
        third = capacity // 3
        for s in range(capacity, third, -1):
            self._match(s, third)
        for s in range(third, 0, -1):
            self._best_fit(s)

    def _open(self, n: int) -> int:
        first = self.sequences
        self.sequences += n
        return first

    def _place(self, s: int, items: int, first: int, per: int, offset: int) -> None:
        self.placements.append((s, self.rank[s], items, first, per, offset))
        self.rank[s] += items
        self.left[s] -= items

    def _match(self, a: int, third: int) -> None:
        """Pair the items of length ``a`` with the longest large items that fit."""
        cap = self.capacity
        b = min(a, cap - a)
        while self.left[a]:
            while b > third and self.left[b] < (2 if b == a else 1):
                b -= 1
            if b <= third:
                n = self.left[a]
                first = self._open(n)
                self._place(a, n, first, 1, 0)
                gap = cap - a
            elif b == a:
                n = self.left[a] // 2
                first = self._open(n)
                self._place(a, 2 * n, first, 2, 0)
                gap = cap - 2 * a
            else:
                n = min(self.left[a], self.left[b])
                first = self._open(n)
                self._place(a, n, first, 1, 0)
                self._place(b, n, first, 1, a)
                gap = cap - a - b
            self.gaps[gap].append((first, n))

    def _best_fit(self, s: int) -> None:
        """Put the items of length ``s`` into the smallest gaps that hold them."""
        cap = self.capacity
        for gap in range(s, cap + 1):
            if not self.left[s]:
                return
            runs, self.gaps[gap] = self.gaps[gap], []
            for first, n in runs:
                self._fill(s, gap, first, n)
        if self.left[s]:
            n = -(-self.left[s] // (cap // s))
            self._fill(s, cap, self._open(n), n)

    def _fill(self, s: int, gap: int, first: int, n: int) -> None:
        """Items of length ``s`` into a run of ``n`` sequences with equal ``gap``."""
        per, offset = gap // s, self.capacity - gap
        full = min(n, self.left[s] // per)
        if full:
            self._place(s, full * per, first, per, offset)
            self.gaps[gap - per * s].append((first, full))
        first, n = first + full, n - full
        rest = self.left[s]
        if n and rest:                                     # fewer than ``per`` are left: one sequence
            self._place(s, rest, first, rest, offset)
            self.gaps[gap - rest * s].append((first, 1))
            first, n = first + 1, n - 1
        if n:
            self.gaps[gap].append((first, n))

    def lookup(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Placements in order of (length, rank), where each length starts, and
        their starting ranks."""
        p = np.array(sorted(self.placements), dtype=np.int64).reshape(-1, 6)
        return p, np.searchsorted(p[:, 0], np.arange(self.capacity + 2)), p[:, 1]

    @staticmethod
    def assign(table: tuple, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces given by length and rank."""
        p, begin, starts = table
        at = np.zeros(len(length), np.int64)
        for s in np.unique(length):
            rows = length == s
            at[rows] = begin[s] + np.searchsorted(starts[begin[s]:begin[s + 1]], rank[rows], side="right") - 1
        k = rank - p[at, 1]
        return p[at, 3] + k // p[at, 4], p[at, 5] + (k % p[at, 4]) * length


def ranked(staged: DataFrame, rows_per_block: int = ROW_BLOCK) -> DataFrame:
    """Staged pieces with ``rank``: their number (from 0) among those of their
    length, by file and row.  Rows are numbered within blocks of bounded size; the
    counts of blocks are summed within a file and over the files."""
    where = ["length", "_file", "_block"]
    rows = staged.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    rows = rows.withColumn("_block", F.expr(f"_row div {rows_per_block}"))
    per_block = rows.groupBy(*where).agg(F.count(F.lit(1)).alias("_n"))

    def before(*group: str, order: str):
        w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_n").over(w), F.lit(0))

    in_file = per_block.select(*where, before("length", "_file", order="_block").alias("_b"))
    files = per_block.groupBy("length", "_file").agg(F.sum("_n").alias("_n"))
    over_files = files.select("length", "_file", before("length", order="_file").alias("_f"))
    base = in_file.join(over_files, ["length", "_file"]).select(*where, (F.col("_b") + F.col("_f")).alias("_base"))
    own = F.row_number().over(Window.partitionBy(*where).orderBy("_row")) - 1
    return (rows.withColumn("_own", own).join(base, where)
            .withColumn("rank", (F.col("_base") + F.col("_own")).cast("long")).drop("_file", "_row", "_block", "_own", "_base"))


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
         id_col: str = "doc_id", text: str = "text", rows_per_block: int = ROW_BLOCK) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset``.

    Eager: the pieces are staged (each text is encoded once) and their lengths
    counted (at most ``capacity`` rows reach the driver)."""
    staged = stage(pieces(docs, vocabulary, capacity, end_id, id_col, text), "pieces")
    counts = {r["length"]: r["n"] for r in staged.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = Plan(counts, capacity).lookup()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = Plan.assign(table, length, rank)
            yield pa.record_batch([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                                   pa.array(seq), pa.array(off)],
                                  names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked(staged, rows_per_block).mapInArrow(run, _PIECES + ", sequence_id long, offset long")
