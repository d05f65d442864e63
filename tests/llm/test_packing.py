import random
import zlib

import numpy as np
import pytest

from rategrid.llm import packing

from .data import LONG, documents, frame


def encoder():
    return packing.encoder(packing.default_vocabulary())


def library_ids(text):
    return encoder().library.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


def check(rows, got, capacity=1024):
    """Every piece of every document, cut as stated, gapless and disjoint."""
    want = []
    for i, t in rows:
        ids = library_ids(t)
        first = (len(ids) - 1) % capacity + 1
        at = 0
        for k, to in enumerate(range(first, len(ids) + 1, capacity)):
            want.append((i, k, at, to - at, zlib.crc32(np.array(ids[at:to], "<u4").tobytes())))
            at = to
        assert at == len(ids)
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for off, n in sorted(spans):
            assert off == at
            at += n
        assert at <= capacity
    return bins


def test_documents(spark):
    docs = frame(spark, extra=True)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    bins = check(rows, packing.pack(docs, rows_per_block=7).collect())
    total = sum(len(library_ids(t)) for _, t in rows)
    assert len(bins) <= -(-total // 1024) + 1


def test_long_documents_are_cut_first_piece_short(spark):
    docs = frame(spark, [(1, "word " * 5000, None, None, None), (2, None, None, None, None), (3, "", None, None, None)])
    got = packing.pack(docs).collect()
    long = sorted((r.piece, r.length) for r in got if r.doc_id == 1)
    assert all(n == 1024 for k, n in long if k) and len(long) > 4
    assert [r.length for r in got if r.doc_id == 2] == [1] and [r.length for r in got if r.doc_id == 3] == [1]


def test_empty_table(spark):
    assert packing.pack(frame(spark, []).limit(0)).count() == 0


def lower_bound(counts, cap):
    """Sequences any packing needs: by tokens, and by items above half."""
    return max(-(-sum(s * n for s, n in counts.items()) // cap), sum(n for s, n in counts.items() if 2 * s > cap))


@pytest.mark.parametrize("seed", range(30))
def test_plan_places_every_item_once(seed):
    r = random.Random(seed)
    cap = r.choice([10, 30, 100])
    counts = {r.randint(1, cap): r.randint(1, 40) for _ in range(r.randint(1, 25))}
    plan = packing.Plan(counts, cap)
    length = np.array([s for s, n in counts.items() for _ in range(n)])
    rank = np.array([k for n in counts.values() for k in range(n)])
    seq, off = packing.Plan.assign(plan.lookup(), length, rank)
    bins = {}
    for s, b, o in zip(length.tolist(), seq.tolist(), off.tolist()):
        bins.setdefault(b, []).append((o, s))
    assert sorted(bins) == list(range(plan.sequences))
    for spans in bins.values():
        at = 0
        for o, s in sorted(spans):
            assert o == at
            at += s
        assert at <= cap and sum(3 * s > cap for _, s in spans) <= 2
    assert plan.sequences <= lower_bound(counts, cap) * 11 / 9 + 1


def test_large_items_are_matched_as_well_as_any_pairing():
    """Items above a third: greedy matching opens as few sequences as an exhaustive search."""
    r = random.Random(7)
    for _ in range(60):
        items = [r.randint(34, 100) for _ in range(r.randint(1, 9))]

        def best(left):
            if not left:
                return 0
            a, rest = left[0], left[1:]
            return 1 + min([best(rest)] + [best(rest[:k] + rest[k + 1:]) for k, b in enumerate(rest) if a + b <= 100])

        counts = {s: items.count(s) for s in items}
        assert packing.Plan(counts, 100).sequences == best(tuple(items))


def test_plan_size_does_not_grow_with_the_counts():
    r = random.Random(1)
    shape = {s: r.randint(1, 50) for s in range(1, 1025)}
    small = packing.Plan(shape)
    big = packing.Plan({s: n * 1_000_000 for s, n in shape.items()})
    assert len(big.placements) < 6000 and len(small.placements) < 6000
    assert big.sequences <= lower_bound({s: n * 1_000_000 for s, n in shape.items()}, 1024) * 1.01


def test_vocabulary_is_closed_under_its_merges():
    """What makes the lowest-id merge order equal the file's merge order."""
    from rategrid.llm.tokencount import transducer

    t = transducer(packing.default_vocabulary())
    special = set(encoder().special.values())
    assert all(t.merge(b) == [i] for i, b in t.raw.items() if i not in special)
    assert encoder().fast is not None


@pytest.mark.parametrize("text", [
    "", " ", "a", "<|endoftext|>", "x<|endoftext|> y<|endoftext|><|endoftext|>", "don't  we'll\n\n\t x", "naïve über ß", "日本語 テスト",
    "Ⅷ ½ ٣ 🙂🙂 é", "ᲀ \U0001e922a1 Ɪ9", "\x85a᠎b c \x1c\x1d", "a" * 9000, " " * 9000, "\n x" * 500, "é" * 5000])
def test_ids_equal_the_library(text):
    assert encoder().encode(text) == encoder().library.encode(text, add_special_tokens=False).ids


def test_random_texts_and_cuts(monkeypatch):
    r = random.Random(3)
    alphabet = "ab Z9'\n\t .,é日🙂́ᲀ½<|>" + "the and ing"
    monkeypatch.setattr(packing, "CUT", 50)
    for _ in range(300):
        t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 400)))
        assert encoder().encode(t) == encoder().library.encode(t, add_special_tokens=False).ids


def test_real_documents_equal_the_library(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        assert [*encoder().encode(r.text or ""), packing.END_ID] == library_ids(r.text)


def test_fixture_holds_long_texts():
    assert any(t and len(t) >= LONG for _, t, *_ in documents())
