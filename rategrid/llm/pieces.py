"""SentencePiece encoding and decoding with N-best segmentation.

The model file gives pieces with scores.  The piece lattice of a text has a
node per character and an edge per piece; a character without a piece has one
edge of byte pieces.  Forward Viterbi gives every node its best score from the
start, which is the exact heuristic of a backward A* search: the search pops
complete segmentations in order of score.

The file holds BPE merge ranks (``-rank``), not log-probabilities, so a sum of
them does not rank segmentations.  Zipf's law turns a rank into one: a piece of
rank ``r`` scores ``-ln(r + 10)``; a byte piece scores a little below the worst
piece.  Pieces the file disables (score of -1e9 or less) are left out.

No usable piece crosses a word boundary (the space symbol occurs only at the
start of usable pieces, a line break only as a byte), so the lattice of a text is
the chain of its words' lattices.  Distinct words of a batch, of all lengths
together, get forward and backward Viterbi as array operations, which also give
the gap between the best and the second-best segmentation of each word.  The N best of a whole text can
only differ from the best in the N - 1 words of the smallest gaps; A* runs on
those, and their lists are merged exactly.

Encoding follows the file's normalisation: a space is put before the text, every
space becomes the symbol U+2581, nothing else changes.  Decoding joins the
pieces, turns byte pieces into bytes and U+2581 into spaces, and takes the
first one off; the text comes back exactly (U+2581 inside a text comes back as
a space).

Cases: null or empty text has no pieces, one segmentation of score 0, and
decodes to the empty text; texts with one segmentation have no second score;
equal scores are ordered by longer last pieces first; rows repeating an id each
keep their row; long texts are taken in blocks; extra columns are ignored (the
pipeline's last stage keeps id and digest columns).
"""

import hashlib
import heapq
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rategrid.llm.common import prepare

SPACE = "▁"
N_BEST = 4
ZIPF = 10
DISABLED = -1e8
_MUL = np.uint64(0x100000001B3)
_LONGEST = 32                    # words up to this length take the array path
_GROUP = 5_000                   # words of one array step
_CACHE = 250_000                 # distinct words kept by a worker
_BLOCK = 1 << 20                 # characters of a text handled at a time


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _hash_step(h, c):
    return h * _MUL + c + np.uint64(1)


class Pieces:
    """Scored pieces of a model file with the N-best search over their lattice."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.name = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte_id = {}
        self.ids: dict[str, int] = {}
        self.score = np.full(len(self.name), -np.inf)
        self.bytes = [b""] * len(self.name)
        for i, p in enumerate(self.name):
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.bytes[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and sp.get_score(i) > DISABLED:
                self.ids[p] = i
                self.score[i] = -math.log(max(0.0, -sp.get_score(i)) + ZIPF)
                self.bytes[i] = p.replace(SPACE, " ").encode("utf-8")
        self.byte_score = min(self.score[i] for i in self.ids.values()) - 1.0
        if any(SPACE in p[1:] or "\n" in p for p in self.ids):
            raise ValueError("a usable piece crosses a word boundary")
        self.max_len = max(map(len, self.ids))
        prefix: dict[int, int] = {}
        with np.errstate(over="ignore"):
            for p, i in self.ids.items():
                h = np.uint64(0)
                for k, c in enumerate(p):
                    h = _hash_step(h, np.uint64(ord(c)))
                    if k == len(p) - 1:
                        if prefix.get(int(h), -1) >= 0:
                            raise ValueError("hash collision")
                        prefix[int(h)] = i
                    else:
                        prefix.setdefault(int(h), -1)
        keys = np.array(list(prefix), dtype=np.uint64)
        order = np.argsort(keys)
        self.keys, self.piece_at = keys[order], np.array(list(prefix.values()))[order]
        # by code point: the piece of one character, -1 for a mere prefix, -3 for neither
        self.single = np.full(max(ord(p[0]) for p in self.ids) + 2, -3)
        for p in self.ids:
            self.single[ord(p[0])] = prefix[ord(p[0]) + 1]
        self.is_byte = np.zeros(len(self.name), bool)
        self.is_byte[list(self.byte_id.values())] = True
        self.reset()

    # ---- one word, exact search

    def edges(self, unit: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """Per end position the edges ``(start, score, ids)``, longest first."""
        n = len(unit)
        out: list[list] = [[] for _ in range(n + 1)]
        for j in range(1, n + 1):
            for i in range(max(0, j - self.max_len), j):
                k = self.ids.get(unit[i:j])
                if k is not None:
                    out[j].append((i, float(self.score[k]), (k,)))
            if not out[j] or out[j][-1][0] != j - 1:
                raw = unit[j - 1].replace(SPACE, " ").encode("utf-8")
                out[j].append((j - 1, self.byte_score * len(raw), tuple(self.byte_id[b] for b in raw)))
        return out

    def n_best(self, unit: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best segmentations ``(score, ids)``, best first: backward A*
        with the forward Viterbi scores as exact heuristic."""
        edges = self.edges(unit)
        best = [0.0] + [-math.inf] * len(unit)
        for j in range(1, len(unit) + 1):
            best[j] = max(best[i] + s for i, s, _ in edges[j])
        heap = [(-best[-1], len(unit), 0, 0.0, None)]
        found, seq = [], 0
        while heap and len(found) < n:
            _, at, _, tail, path = heapq.heappop(heap)
            if at == 0:
                ids: list[int] = []
                node = path
                while node is not None:
                    ids.extend(node[0])
                    node = node[1]
                found.append((tail, tuple(ids)))
                continue
            for i, s, k in edges[at]:
                seq += 1
                heapq.heappush(heap, (-(best[i] + s + tail), i, seq, s + tail, (k, path)))
        return found

    # ---- many words, arrays

    def reset(self) -> None:
        self.index = _Index()
        self.best = np.empty(0)
        self.gap = np.empty(0)
        self.hits = np.empty(0, np.int64)
        self.first = np.empty(0, np.int64)
        self.count = np.empty(0, np.int64)
        self.flat = np.empty(0, np.int32)
        self.lists: dict[tuple[str, int], list] = {}

    def learn(self, units: list[str]) -> None:
        """Add the segmentations of new distinct words to the table."""
        best, gap, count = np.zeros(len(units)), np.zeros(len(units)), np.zeros(len(units), np.int64)
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        parts = []                                         # (words, their ids one after another)
        for i in np.nonzero(lengths > _LONGEST)[0].tolist():
            two = self.n_best(units[i], 2)
            best[i], ids = two[0]
            gap[i] = two[0][0] - two[1][0] if len(two) > 1 else np.inf
            count[i] = len(ids)
            parts.append((np.array([i]), np.array(ids, np.int32)))
        short = np.nonzero(lengths <= _LONGEST)[0]
        for s in range(0, len(short), _GROUP):
            at = short[s:s + _GROUP]
            best[at], gap[at], count[at], ids = self._viterbi([units[i] for i in at.tolist()], lengths[at])
            parts.append((at, ids))
        first = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), np.int32)
        for at, ids in parts:
            flat[_spans(first[at], count[at])] = ids
        self.first = np.concatenate((self.first, len(self.flat) + first))
        self.count = np.concatenate((self.count, count))
        self.flat = np.concatenate((self.flat, flat))
        self.hits = np.concatenate((self.hits, np.zeros(len(units), np.int64)))
        self.best = np.concatenate((self.best, best))
        self.gap = np.concatenate((self.gap, gap))

    def _viterbi(self, units: list[str], lengths: np.ndarray):
        """Per word the best score, the gap to the second best and the number of
        ids, and the ids of all best segmentations one after another.

        The words lie in one array of nodes, each with a node behind its last
        character.  Edges of one length are looked up for all words at once, then
        taken in the order of their start and length: no word has two edges of
        the same start and length."""
        n = len(units)
        ends = np.cumsum(lengths + 1) - 1                  # last node of every word
        starts = ends - lengths
        word = np.repeat(np.arange(n), lengths + 1)
        cp = np.zeros(len(word), np.uint64)
        chars = np.ones(len(word), bool)
        chars[ends] = False
        cp[chars] = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        # edges by length
        node = np.nonzero(chars)[0]
        c = cp[node]
        piece = self.single[np.minimum(c, len(self.single) - 1).astype(np.int64)]
        width = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
        width[c == ord(SPACE)] = 1
        found = [(node, 1, np.where(piece >= 0, piece, -2),
                  np.where(piece >= 0, self.score[piece], self.byte_score * width))]
        with np.errstate(over="ignore"):
            live = node[piece != -3]
            h = _hash_step(np.uint64(0), cp[live])
            for k in range(2, self.max_len + 1):
                inside = chars[live + (k - 1)] & (word[live + (k - 1)] == word[live])
                live, h = live[inside], h[inside]
                h = _hash_step(h, cp[live + (k - 1)])
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                ok = self.keys[at] == h
                live, h, at = live[ok], h[ok], at[ok]
                if not len(live):
                    break
                piece = self.piece_at[at]
                use = piece >= 0
                if use.any():
                    found.append((live[use], k, piece[use], self.score[piece[use]]))
        start = np.concatenate([x[0] for x in found])
        size = np.concatenate([np.full(len(x[0]), x[1]) for x in found])
        group = (start - starts[word[start]]) * (self.max_len + 1) + size
        order = np.argsort(group.astype(np.uint16) if _LONGEST * (self.max_len + 2) < 1 << 16 else group, kind="stable")
        start, size, group = start[order], size[order], group[order]
        end = start + size
        piece = np.concatenate([x[2] for x in found])[order]
        weight = np.concatenate([x[3] for x in found])[order]
        cuts = [0, *(np.nonzero(np.diff(group))[0] + 1).tolist(), len(group)]
        steps = [slice(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]
        # forward and backward Viterbi
        fwd = np.full(len(word), -np.inf)
        fwd[starts] = 0.0
        back = np.full(len(word), -1)                      # edge of the best path to a node
        for x in steps:
            e = end[x]
            s = fwd[start[x]] + weight[x]
            better = np.nonzero(s > fwd[e])[0]
            e = e[better]
            fwd[e] = s[better]
            back[e] = better + x.start
        rev = np.full(len(word), -np.inf)
        rev[ends] = 0.0
        for x in reversed(steps):
            s = start[x]
            rev[s] = np.maximum(rev[s], weight[x] + rev[end[x]])
        # best paths, from the ends
        used = np.zeros(len(start), bool)
        at = ends[lengths > 0]
        while len(at):
            e = back[at]
            used[e] = True
            at = start[e]
            at = at[back[at] >= 0]
        total = fwd[ends]
        off = np.nonzero(~used)[0]
        lost = total[word[start[off]]] - (fwd[start[off]] + weight[off] + rev[end[off]])
        gap = np.full(n, np.inf)
        np.minimum.at(gap, word[start[off]], lost)
        # their ids, byte pieces for characters without a piece
        path = np.nonzero(used)[0]
        path = path[np.argsort(start[path], kind="stable")]
        ids = np.full((len(path), 4), -1, np.int32)
        ids[:, 0] = piece[path]
        for r in np.nonzero(ids[:, 0] < 0)[0].tolist():
            raw = chr(int(cp[start[path[r]]])).replace(SPACE, " ").encode("utf-8")
            ids[r, :len(raw)] = [self.byte_id[b] for b in raw]
        count = np.bincount(word[start[path]], weights=(ids >= 0).sum(axis=1), minlength=n).astype(np.int64)
        return total, np.maximum(gap, 0.0), count, ids[ids >= 0]

    def lookup(self, keys: list[list[str]]) -> list[np.ndarray]:
        """Rows of the table for lists of keys; words it does not hold are learnt
        in one step."""
        if len(self.index) > _CACHE:
            self.shrink()
        known, get = len(self.index), self.index.__getitem__
        rows = [np.fromiter(map(get, x), np.int64, len(x)) for x in keys]
        if len(self.index) > known:
            self.learn([unit_of(k) for k in list(self.index)[known:]])
        return rows

    def shrink(self) -> None:
        """Keep the most often used quarter of a full table."""
        keep = np.sort(np.argsort(-self.hits, kind="stable")[:_CACHE // 4])
        keys = list(self.index)
        self.index = _Index((keys[i], k) for k, i in enumerate(keep.tolist()))
        first, count = self.first[keep], self.count[keep]
        self.flat = self.flat[_spans(first, count)]
        self.first, self.count = np.cumsum(count) - count, count
        self.best, self.gap, self.hits = self.best[keep], self.gap[keep], self.hits[keep] // 2

    # ---- texts

    def encode(self, text: str | None, n: int = N_BEST) -> dict:
        return self.encode_many([text], n)[0]

    def encode_many(self, texts: list[str | None], n: int = N_BEST) -> list[dict]:
        """Digests of the N best segmentations of texts: ``scores`` (best first),
        ``n_pieces``, ``n_bytes`` (byte pieces), ``sha256`` of the best ids
        (little-endian 32-bit), ``alternatives`` (per further segmentation the
        words that differ and their ids), ``round_trip``."""
        states = [_State() for _ in texts]
        held, size = [], 0
        for state, text in zip(states, texts):
            for block in blocks(text or ""):
                held.append((state, block, keys_of(block)))
                size += len(block)
                if size >= _BLOCK:
                    self._take(held, n)
                    held, size = [], 0
        self._take(held, n)
        return [self._finish(x, n) for x in states]

    def _take(self, held, n: int) -> None:
        if not held:
            return
        rows = self.lookup([keys for _, _, keys in held])
        every = np.concatenate(rows)
        self.hits += np.bincount(every, minlength=len(self.hits))
        empty = self.index.get(_EMPTY, -1)
        for (x, block, keys), at in zip(held, rows):
            where = None
            if empty >= 0:
                where = np.nonzero(at != empty)[0]
                at = at[where]
            x.total += float(self.best[at].sum())
            ids = self.flat[_spans(self.first[at], self.count[at])]
            x.sha.update(ids)
            x.n_pieces += len(ids)
            x.n_bytes += int(np.count_nonzero(self.is_byte[ids]))
            x.same &= b"".join(map(self.bytes.__getitem__, ids.tolist())) == block.replace(SPACE, " ").encode("utf-8")
            gaps = self.gap[at]
            k = min(n - 1, len(gaps))
            if k > 0:
                x.near.extend((float(gaps[i]), x.words + int(i), unit_of(keys[i if where is None else where[i]]))
                              for i in _least(gaps, k))
                x.near = sorted(x.near, key=lambda y: y[:2])[:n - 1]
            x.words += len(at)

    def _finish(self, x, n: int) -> dict:
        combos = [(0.0, ())]
        for _, where, unit in x.near:
            base = self.word_list(unit, n)
            combos = sorted(((lost + base[0][0] - s, used + (((where, ids),) if r else ()))
                             for lost, used in combos for r, (s, ids) in enumerate(base)),
                            key=lambda y: (y[0], [w for w, _ in y[1]]))[:n]
        return {"n_words": x.words, "n_pieces": x.n_pieces, "n_bytes": x.n_bytes, "sha256": x.sha.hexdigest(),
                "scores": [x.total - lost for lost, _ in combos],
                "alternatives": [[(w, list(i)) for w, i in used] for _, used in combos[1:]], "round_trip": x.same}

    def word_list(self, unit: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        key = (unit, n)
        if key not in self.lists:
            if len(self.lists) > _CACHE // 10:
                self.lists = {}
            self.lists[key] = self.n_best(unit, n)
        return self.lists[key]

    def ids_of(self, text: str | None) -> list[int]:
        """Ids of the best segmentation of a whole text."""
        out: list[int] = []
        for block in blocks(text or ""):
            at = self.lookup([keys_of(block)])[0]
            out.extend(self.flat[_spans(self.first[at], self.count[at])].tolist())
        return out

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8")
        return raw[1:] if raw.startswith(" ") else raw


class _State:
    """Running digest of one text."""

    def __init__(self):
        self.sha, self.n_pieces, self.n_bytes, self.total, self.words = hashlib.sha256(), 0, 0, 0.0, 0
        self.near: list[tuple[float, int, str]] = []
        self.same = True


def _least(x: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` smallest values, earlier positions first on ties."""
    limit = np.partition(x, k - 1)[k - 1]
    at = np.nonzero(x <= limit)[0]
    return at[np.lexsort((at, x[at]))][:k]


class _Index(dict):
    """Rows of the word table by key; a new key gets the next row."""

    def __missing__(self, key: str) -> int:
        self[key] = row = len(self)
        return row


def _spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Positions ``first, first + 1, ...`` of ``count`` each, one after another."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


_BREAK, _EMPTY = "\n\n", "\n"


def keys_of(block: str) -> list[str]:
    """Keys of the words of a block (a space, then anything): what follows a space
    or the space symbol, ``_BREAK`` for a line break, and a line break with what
    follows it up to the next space or break (``_EMPTY`` if nothing does)."""
    return block.replace(SPACE, " ").replace("\n", f" {_BREAK} \n")[1:].split(" ")


def unit_of(key: str) -> str:
    """The word a key stands for: with its space symbol, a line break, or neither."""
    return "\n" if key == _BREAK else key[1:] if key[:1] == "\n" else SPACE + key


def blocks(text: str) -> Iterator[str]:
    """The text with a space before it, cut at spaces into bounded blocks (a
    word longer than a block stays whole)."""
    if not text:
        return
    text = " " + text
    at = 0
    while at < len(text):
        end = text.find(" ", at + _BLOCK)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


FIELDS = ("n_words long, n_pieces long, n_byte_pieces long, ids_sha256 string, scores array<double>, "
          "round_trip boolean")


def segment(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text: str = "text",
            n_best: int = N_BEST) -> DataFrame:
    """Per row: ``doc_id``, counts, the digest of the best ids, the scores of the
    N best segmentations (best first) and whether decoding gives the text back."""
    prepare(docs.sparkSession)
    path = model or default_model()
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for b in batches:
            r = p.encode_many(b.column(1).to_pylist(), n_best)
            yield pa.record_batch(
                [b.column(0)] + [pa.array([x[k] for x in r], t) for k, t in (
                    ("n_words", pa.int64()), ("n_pieces", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string()),
                    ("scores", pa.list_(pa.float64())), ("round_trip", pa.bool_()))],
                names=["doc_id", "n_words", "n_pieces", "n_byte_pieces", "ids_sha256", "scores", "round_trip"])

    return src.mapInArrow(run, f"doc_id long, {FIELDS}")


def encode(docs: DataFrame, model: str | None = None, text: str = "text", out: str = "piece_ids") -> DataFrame:
    """``docs`` with the ids of the best segmentation as ``out``."""
    prepare(docs.sparkSession)
    path = model or default_model()

    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: pieces(path).ids_of(t))

    return docs.withColumn(out, F.pandas_udf(run, "array<int>")(F.col(text).cast("string")))


def decode(rows: DataFrame, model: str | None = None, ids: str = "piece_ids", out: str = "text") -> DataFrame:
    """``rows`` with the text of a column of piece ids as ``out`` (null ids: null)."""
    prepare(rows.sparkSession)
    path = model or default_model()

    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else pieces(path).decode([int(k) for k in v]))

    return rows.withColumn(out, F.pandas_udf(run, "string")(F.col(ids)))
