import hashlib
import re

import pytest
from pyspark.sql import functions as F

from rategrid.llm import mixing
from rategrid.llm.common import running_start, word_count

from .data import documents, frame


def brute(rows):
    """(doc_id, size, source_size, target, taken) by the plain definition."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in rows]
    src = {}
    for r, n in zip(rows, size):
        src[r[3]] = src.get(r[3], 0) + n
    order = sorted(src, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(src.values()), set()
    while True:
        rest = [s for s in order if s not in full]
        if not rest:
            break
        level = (total - sum(3 * src[s] for s in full)) / sum(w[s] for s in rest)
        above = {s for s in rest if w[s] * level > 3 * src[s]}
        if not above:
            break
        full |= above
    target = {s: 3.0 * src[s] if s in full else w[s] * level for s in order}
    out = []
    for s in order:
        mine = sorted((hashlib.md5(f"mix:{'' if r[0] is None else r[0]}".encode()).hexdigest(), n, i)
                      for i, (r, n) in enumerate(zip(rows, size)) if r[3] == s)
        at, t = 0, int(target[s])
        for _, n, i in mine:
            passes, rest = divmod(t, src[s]) if src[s] else (0, 0)
            out.append((rows[i][0], n, src[s], target[s], n * passes + max(0, min(n, rest - at))))
            at += n
    return out


KEY = lambda x: tuple("" if v is None else repr(v) for v in x)


@pytest.mark.parametrize("block", [7, 65536])
def test_taken_words_equal_brute_force(spark, block):
    got = [tuple(r)[:5] for r in mixing.taken_words(frame(spark, extra=True), block_words=block).collect()]
    assert sorted(got, key=KEY) == sorted(brute(documents()), key=KEY)


def test_hot_source_and_cap(spark):
    rows = [(i, "w " * (1 + i % 5), None, "hot", 1) for i in range(300)] + [(1000 + i, "a b", None, f"t{i}", 1) for i in range(4)]
    got = [tuple(r)[:5] for r in mixing.taken_words(frame(spark, rows), block_words=16).collect()]
    assert sorted(got, key=KEY) == sorted(brute(rows), key=KEY)
    assert all(t <= 3 * n for _, n, _, _, t in got)


def test_mix_reads_sources_in_step(spark):
    """Every prefix of the slots holds the sources close to their shares."""
    rows = [(i, "w " * 50, None, f"s{i % 3}", 1) for i in range(240)]
    placed, sources = mixing.plan(frame(spark, rows))
    share = {r["rank"]: r["target"] for r in sources.collect()}
    total = sum(share.values())
    slots = sorted((r["slot"], r["rank"]) for r in mixing.schedule(sources, 20).collect())
    for n in (50, 200, 500):
        for rank, t in share.items():
            assert abs(sum(r == rank for _, r in slots[:n]) / n - t / total) < 0.05
    pieces = mixing.mix(placed, sources, 20)
    assert pieces.where(F.col("slot") >= 1 << 40).count() == 0
    assert pieces.groupBy("slot").agg(F.sum("n_words").alias("n")).where("n > 20").count() == 0


def brute_slots(rows, block):
    """(doc_id, first slot) by walking the golden-ratio points and the repeated streams."""
    taken = brute(rows)
    size = {}
    for d, n, s, t, _ in taken:
        size.setdefault((s, t), []).append((d, n))
    want = sorted({r[3] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    streams = []
    at = 0
    for s in want:                               # brute lists the sources in this order
        n = sum(r[3] == s for r in rows)
        streams.append(taken[at:at + n])
        at += n
    units = [int(x[0][3]) for x in streams]
    total, lo = sum(units), 0
    ends = []
    for u in units:
        ends.append((lo / max(total, 1), (lo + u) / max(total, 1)))
        lo += u
    slot_of, used = {}, [0] * len(units)
    for i in range(total * 102 // (100 * block) + 8 * sum(u >= 1 for u in units) + 8):
        y = (i + 0.5) * 0.6180339887498949
        for k, (a, b) in enumerate(ends):
            if a <= y - int(y) < b:
                if used[k] * block < units[k]:
                    slot_of[k, used[k]] = i
                used[k] += 1
    out = []
    for k, docs in enumerate(streams):
        words = [j for j, (_, n, *_r) in enumerate(docs) for _ in range(n)]
        first = {}
        for w in range(units[k]):
            b = w // block
            j = words[w % len(words)]
            first[j] = min(first.get(j, 1 << 60), slot_of.get((k, b), (1 << 40) + (b << 20) + k))
        out += [(d[0], first.get(j)) for j, d in enumerate(docs)]
    return out


@pytest.mark.parametrize("block", [7, 65536])
def test_first_slots_equal_brute_force(spark, block):
    df = mixing.taken_words(frame(spark), block_words=block).select("doc_id", "first_slot")
    assert sorted((tuple(r) for r in df.collect()), key=KEY) == sorted(brute_slots(documents(), block), key=KEY)


def test_ordered_mix_follows_the_slots(spark):
    rows = [(i, f"{'w ' * 50}{i}", None, f"s{i % 3}", 1) for i in range(240)]
    first = {r["doc_id"]: r["first_slot"] for r in mixing.taken_words(frame(spark, rows), block_words=51).collect()}
    got = [r["doc_id"] for r in mixing.apply_mix(frame(spark, rows), block_words=51, ordered=True).collect()]
    seen = [first[d] for d in dict.fromkeys(got)]
    assert seen == sorted(seen) and len(seen) > 100
    assert sorted(got) == sorted(r["doc_id"] for r in mixing.apply_mix(frame(spark, rows), block_words=51).collect())


def test_applied_mix_has_the_taken_words(spark):
    df = frame(spark, extra=True)
    out = mixing.apply_mix(df)
    assert out.columns == df.columns
    got = {r["source"]: r["w"] for r in out.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("w")).collect()}
    want = {}
    sizes = {}
    for d, n, size, target, t in brute(documents()):
        sizes[size] = sizes.get(size, 0) + t
    for s in {d[3] for d in documents()}:
        n = sum(len((d[1] or "").split()) for d in documents() if d[3] == s)
        want[s] = sizes[n]
    assert got == {s: t for s, t in want.items() if t}
    whole = {(d[0], d[1]) for d in documents()}
    cut = [r for r in out.select("doc_id", "text").collect() if (r["doc_id"], r["text"]) not in whole]
    assert len(cut) <= len(want)                                # at most one cut row a source
    assert all(any(t and t.startswith(r["text"]) for _, t in whole) for r in cut)


def test_running_start_without_sorting_a_group(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id", (F.col("id") / 1000.0).alias("u"),
                                  (F.col("id") % 7).alias("v"))
    got = {r["id"]: r["s"] for r in running_start(df, ["g"], ["id"], "v", "u", "s", rows_per_bucket=10).collect()}
    acc = {0: 0, 1: 0, 2: 0}
    for i in range(1000):
        assert got[i] == acc[i % 3]
        acc[i % 3] += i % 7


def test_empty_and_zero(spark):
    assert mixing.taken_words(frame(spark, [])).count() == 0
    assert mixing.apply_mix(frame(spark, [])).count() == 0
    rows = [(1, None, None, "a", None), (2, "  ", None, None, None)]
    assert sorted(r["taken"] for r in mixing.taken_words(frame(spark, rows)).collect()) == [0, 0]
