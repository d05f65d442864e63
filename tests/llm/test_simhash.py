import random
import re

import numpy as np
import pytest
import xxhash

from rategrid.llm import simhash

from .data import documents, frame


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, t=2):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= t:
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(i)
    out = [None] * len(ids)
    for g in groups.values():
        known = [ids[i] for i in g if ids[i] is not None]
        for i in g:
            out[i] = min(known) if known else None
    return out


def test_golay_tables_cover_every_syndrome_once():
    low, high, start, patterns = simhash.covering_tables(2)
    assert (np.diff(start[0]) == 1).all()                       # perfect code: one home pattern
    y = np.random.default_rng(1).integers(0, 1 << 23, 2000)
    s = low[y & 0xFFF] ^ high[y >> 12]
    home = y ^ patterns[0][start[0][s]]
    assert ((low[home & 0xFFF] ^ high[home >> 12]) == 0).all()  # codewords
    assert max(bin(int(a ^ b)).count("1") for a, b in zip(y, home)) <= 3


def test_close_words_share_a_home_anchor():
    r = np.random.default_rng(2)
    x = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    y = x.copy()
    for i in range(len(x)):
        for b in r.choice(64, int(r.integers(0, 3)), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    row_x, a_x, home_x = simhash.anchors(x)
    row_y, a_y, _ = simhash.anchors(y)
    at = {}
    for i, a in zip(row_y, a_y):
        at.setdefault(int(i), set()).add(int(a))
    for i, a, h in zip(row_x, a_x, home_x):
        if h:
            assert int(a) in at[int(i)]


@pytest.mark.parametrize("cell", [48, 2])
def test_links_equal_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "_SMALL_CELL", cell)
    r = random.Random(3)
    seeds = [r.getrandbits(64) for _ in range(40)]
    fps = []
    for s in seeds:
        x = s
        for _ in range(12):                                     # chains of near words
            fps.append(x)
            for b in r.sample(range(64), r.randint(1, 4)):
                x ^= 1 << b
    fps = list(dict.fromkeys(fps))
    rows = [(i, int(np.array(f, np.uint64).view(np.int64))) for i, f in enumerate(fps)]
    got = {x["doc_id"]: x["component_id"]
           for x in simhash.components_of(spark.createDataFrame(rows, "doc_id long, fp long")).collect()}
    want = brute_components(list(range(len(fps))), fps)
    assert [got[i] for i in range(len(fps))] == want


@pytest.mark.parametrize("limit", [10, 10**9])
def test_large_cell_by_flipped_words_equals_distances(monkeypatch, limit):
    monkeypatch.setattr(simhash, "_FLIP_CELL", limit)
    r = np.random.default_rng(5)
    fp = np.unique(np.uint64(12345) ^ (np.uint64(1) << r.integers(0, 64, 3000, dtype=np.uint64))
                   ^ (np.uint64(1) << r.integers(0, 64, 3000, dtype=np.uint64)))
    home = np.ones(len(fp), bool)
    a, b = simhash._cell(fp, home, 2)
    ordered = sorted(fp.tolist())
    seen = set(ordered)
    root = {x: x for x in ordered}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in ordered:
        for f in simhash._flips(2).tolist():
            if x ^ f in seen:
                p, q = find(x), find(x ^ f)
                root[max(p, q)] = min(p, q)
    got = dict(zip(a.tolist(), b.tolist()))
    assert all(got.get(x, x) == find(x) for x in ordered)


@pytest.mark.parametrize("extra", [False, True])
def test_near_duplicates_against_brute_force(spark, extra):
    docs = documents()
    rows = simhash.near_duplicates(frame(spark, extra=extra)).collect()
    ids, texts = [d[0] for d in docs], [d[1] for d in docs]
    fps = [brute_fingerprint(t) for t in texts]
    comp = brute_components(ids, fps)
    key = lambda x: tuple("" if v is None else str(v) for v in x)
    want = sorted(((i, f"{f:016x}", c) for i, f, c in zip(ids, fps, comp)), key=key)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows), key=key) == want


@pytest.mark.parametrize("extra", [False, True])
def test_one_row_per_component_stays(spark, extra):
    docs = documents()
    df = frame(spark, extra=extra)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    rows = kept.collect()
    ids, fps = [d[0] for d in docs], [brute_fingerprint(d[1]) for d in docs]
    root = {}
    for i, c in enumerate(brute_components(list(range(len(ids))), fps)):
        root.setdefault(c, []).append(i)
    assert len(rows) == len(root)
    for r in rows:
        assert (r["doc_id"], r["text"]) in {(docs[i][0], docs[i][1]) for g in root.values() for i in g
                                            if ids[i] == min((ids[j] for j in g if ids[j] is not None), default=None)}


def test_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.keep_one(frame(spark, [])).count() == 0
