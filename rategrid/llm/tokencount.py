"""Token counts from a compiled byte-level BPE transducer.

A byte-level BPE vocabulary is compiled, state by state as texts need them, to a
deterministic transducer.  A state holds every token that may still be growing
at the current byte: its trie node, the last token before it and the token
count there relative to the current one.  Among the tokens that end at a byte
exactly one may follow the token before it (a pair that BPE leaves apart), which
fixes the last token of every prefix; so a transition is deterministic and is
annotated with the number of tokens it emits (a count, possibly negative when a
longer token swallows earlier ones).  The count of a string is the sum along its
path.

Texts are cut into chunks.  A chunk's state map is kept in closed form: the part
before its first synchronising position (a change from non-space to white space,
where a pre-token ends whatever came before), the tokens between, and the part
after its last one.  Composing two maps counts the joined middle part; the
composition is associative, so the maps of a text are combined pairwise in a
prefix-scan tree.

The added special string of the vocabulary file counts as one token where it
occurs in a text, as the library does by default.

Cases: null or empty text has 0 bytes and 0 tokens; rows repeating an id each
keep their row; a null id keeps its row; a chunk without a synchronising
position is joined whole; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rategrid.llm.common import prepare

LIMIT = 512
CHUNK = 1 << 16                  # characters per chunk
_STATES = 200_000                # transducer states kept by a worker
_WORDS = 400_000                 # pre-tokens whose count a worker keeps
# fixed value: how the vocabulary's library cuts a text before its merges
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> dict[str, int]:
    """The printable character of each byte in byte-level vocabularies: itself
    for visible Latin-1, the next code points from 256 on for the others."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {**{chr(b): b for b in seen}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Transducer:
    """Lazily compiled token-count transducer of a byte-level BPE vocabulary."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("a byte-level BPE vocabulary without normaliser is needed")
        sym = byte_symbols()
        raw = {t: bytes(sym[c] for c in t) for t in spec["model"]["vocab"]}
        ids = spec["model"]["vocab"]
        self.raw = {ids[t]: raw[t] for t in raw}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank.setdefault((ids[a], ids[b]), (r, ids[a + b]))
        self.single = {b: ids[c] for c, b in sym.items()}
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.split = regex.compile(PATTERN).findall
        self.newer, self.split_newer = self._newer_letters(path, regex)
        self.sync = regex.compile(r"(?<=\S)\s")
        # trie of the tokens that BPE itself produces
        self.child: list[dict[int, int]] = [{}]
        self.token = [-1]
        for i, b in self.raw.items():
            if self.merge(b) == [i]:
                at = 0
                for x in b:
                    at = self.child[at].setdefault(x, len(self.child))
                    if at == len(self.child):
                        self.child.append({})
                        self.token.append(-1)
                self.token[at] = i
        self.apart: dict[tuple[int, int], bool] = {}
        self.clear()

    @staticmethod
    def _newer_letters(path: str, regex):
        """Letters and digits of newer Unicode versions that the library's own
        pre-tokenizer takes for other characters: a search for them and the
        splitting pattern without them (None if there are none)."""
        from tokenizers import Tokenizer

        pre = Tokenizer.from_file(path).pre_tokenizer
        known = regex.findall(r"[\p{L}\p{N}]", "".join(
            chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000))
        other = []
        for at in range(0, len(known), 8192):
            part = known[at:at + 8192]
            cuts = {a for _, (a, _) in pre.pre_tokenize_str("".join(f"a{c}1" for c in part))}
            other += [c for i, c in enumerate(part) if 3 * i + 1 in cuts and 3 * i + 2 in cuts]
        if not other:
            return None, None
        cls = "".join(f"\\U{ord(c):08X}" for c in other)
        pattern = PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{cls}])")
        pattern = pattern.replace(r"?\p{L}+", rf"?(?:(?![{cls}])\p{{L}})+").replace(
            r"?\p{N}+", rf"?(?:(?![{cls}])\p{{N}})+")
        return regex.compile(f"[{cls}]").search, regex.compile(pattern).findall

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text."""
        if self.newer is not None:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                if self.newer(text):
                    return self.split_newer(text)
        return self.split(text)

    def merge(self, b: bytes) -> list[int]:
        """BPE of a byte string by its definition (lowest rank, leftmost first)."""
        t = [self.single[x] for x in b]
        while len(t) > 1:
            best = min(((self.rank[p][0], i) for i, p in enumerate(zip(t, t[1:])) if p in self.rank), default=None)
            if best is None:
                break
            i = best[1]
            t[i:i + 2] = [self.rank[t[i], t[i + 1]][1]]
        return t

    def follows(self, a: int, b: int) -> bool:
        """BPE of the two tokens' bytes leaves exactly this pair."""
        if a < 0:
            return True
        got = self.apart.get((a, b))
        if got is None:
            if len(self.apart) > 4 * _STATES:
                self.apart.clear()
            got = self.apart[a, b] = self.merge(self.raw[a] + self.raw[b]) == [a, b]
        return got

    def clear(self) -> None:
        start = ((0, -1, 0),)
        self.state = {start: 0}
        self.live = [start]
        self.next: list[dict[int, tuple[int, int]]] = [{}]
        self.known: dict[str, int] = {}

    def step(self, s: int, byte: int) -> tuple[int, int]:
        """Compile the transition of state ``s`` on ``byte``: (state, emitted)."""
        live = self.live[s]
        grown, last, emitted = [], None, 0
        for node, before, count in live:
            n = self.child[node].get(byte)
            if n is None:
                continue
            t = self.token[n]
            if last is None and t >= 0 and self.follows(before, t):
                last, emitted = t, count + 1
            if self.child[n]:
                grown.append((n, before, count))
        if last is None:
            raise ValueError("a byte without a token")
        key = tuple((n, b, c - emitted) for n, b, c in grown) + ((0, last, 0),)
        to = self.state.get(key)
        if to is None:
            to = self.state[key] = len(self.live)
            self.live.append(key)
            self.next.append({})
        out = self.next[s][byte] = (to, emitted)
        return out

    def count_word(self, word: str) -> int:
        """Tokens of one pre-token: the emitted counts along its path."""
        if len(self.live) > _STATES:
            self.clear()
        s = total = 0
        table, step = self.next, self.step
        for x in word.encode("utf-8"):
            t = table[s].get(x)
            if t is None:
                t = step(s, x)
            s = t[0]
            total += t[1]
        return total

    def count(self, text: str) -> int:
        """Tokens of a text that starts and ends at synchronising positions."""
        total = 0
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self.count, parts))
        known = self.known
        words = self.words(text)
        counts = list(map(known.get, words))
        if None in counts:
            if len(known) > _WORDS:
                known.clear()
            for i, c in enumerate(counts):
                if c is None:
                    w = words[i]
                    c = known.get(w)
                    if c is None:
                        c = self.count_word(w)
                        if len(w) <= 64:
                            self.known[w] = c
                    counts[i] = c
        total += sum(counts)
        return total

    def chunk_map(self, chunk: str) -> tuple[str, int | None, str]:
        """State map of a chunk: (head, tokens between, tail); no synchronising
        position: (whole chunk, None, '')."""
        first = self.sync.search(chunk)
        if first is None:
            return chunk, None, ""
        a = first.start()
        b = a
        back = chunk.rfind(" ")
        # the last synchronising position: a white-space character after another character
        while back > a:
            if not chunk[back - 1].isspace():
                b = back
                break
            back = chunk.rfind(" ", 0, back)
        return chunk[:a], self.count(chunk[a:b]), chunk[b:]

    def compose(self, x: tuple, y: tuple) -> tuple:
        if x[1] is None and y[1] is None:
            return self.chunk_map(x[0] + y[0])
        if x[1] is None:
            head = self.chunk_map(x[0] + y[0])
            if head[1] is None:
                return head[0], y[1], y[2]
            return head[0], head[1] + self.count(head[2]) + y[1], y[2]
        if y[1] is None:
            tail = self.chunk_map(x[2] + y[0])
            if tail[1] is None:
                return x[0], x[1], tail[0]
            return x[0], x[1] + self.count(tail[0]) + tail[1], tail[2]
        return x[0], x[1] + self.count(x[2] + y[0]) + y[1], y[2]

    def count_text(self, text: str | None, chunk: int = CHUNK) -> int:
        """Tokens of a whole text through its chunk maps."""
        if not text:
            return 0
        if len(text) <= chunk:
            return self.count(text)
        maps = [self.chunk_map(text[i:i + chunk]) for i in range(0, len(text), chunk)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, middle, tail = maps[0]
        return self.count(head) + (middle or 0) + self.count(tail)


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def token_counts(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_tokens, over_limit``."""
    prepare(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
                      F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for b in batches:
            n = np.array([t.count_text(x.as_py()) for x in b.column(1)], dtype=np.int64)
            yield pa.record_batch([b.column(0), b.column(2), pa.array(n), pa.array(n > limit)],
                                  names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return src.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
