import hashlib

import numpy as np
import pytest

from rategrid.llm import codes


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [max(-2**63, min(2**63 - 1, int(np.floor(256 * float(v))))) for v in e], lab) for i, e, lab in rows
            if e is not None and all(v is not None and np.isfinite(v) for v in e)]
    if not kept:
        return []
    width = -(-max(1, max(len(x) for _, x, _ in kept)) // parts) * parts
    kept = [(i, x + [0] * (width - len(x)), lab) for i, x, lab in kept]
    w = width // parts
    first = {}
    for i, x, _ in kept:
        if i is not None:
            first[i] = min(first.get(i, x), x)
    seeds = [first[i] for i in sorted(first)[:entries]]
    books = [[x[p * w:(p + 1) * w] for x in seeds] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            got = {}
            for _, x, _ in kept:
                y = x[p * w:(p + 1) * w]
                got.setdefault(near(y, books[p])[1], []).append(y)
            books[p] = [[sum(c) // len(got[k]) for c in zip(*got[k])] if k in got else c for k, c in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    out = []
    for i, x, lab in kept:
        hit = [near(x[p * w:(p + 1) * w], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in hit), sum(d for d, _ in hit), lab))
    total = {}
    for _, _, e, lab in out:
        total[lab] = total.get(lab, 0) + e
    big = lambda v: v if v < 2**63 else None
    return sorted((repr(i), c, repr(big(e)), repr(big(total[lab])), sha) for i, c, e, lab in out)


def got(df, **kw):
    return sorted((repr(r["vec_id"]), r["code"], repr(r["error"]), repr(r["label_error"]), r["codebooks_sha256"])
                  for r in codes.compress(df, **kw).collect())


SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("block", [4096, 40])
def test_real_vectors(spark, block):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    assert got(df, block_rows=block) == brute(rows)


def test_odd_rows(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(v) for v in r.choice([0.0, 0.5, -0.25, 1.0], 32)], i % 3) for i in range(200)]
    rows += [(3, rows[9][1], None), (None, rows[4][1], None), (None, rows[5][1], 1), (900, None, 1), (901, [None] * 32, 1),
             (902, [float("nan")] * 32, 0), (903, [1.0], None), (904, [], 2), (7, rows[7][1], 7)] + [(500, rows[0][1], 9)] * 50
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS x", "2 AS code", "3 AS error", "4 AS _v")
    assert got(df) == brute(rows)
    assert got(df, parts=4, entries=5, rounds=3, block_rows=16) == brute(rows, 4, 5, 3)


def test_large_components(spark):
    rows = [(i, [float(i % 5)] * 16 + [1e12 * (i % 4)] * 16, 0) for i in range(80)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == brute(rows)


def test_few_and_empty(spark):
    rows = [(0, [1.0] * 16, None), (4, [2.0] * 16, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == brute(rows)
    assert got(df.limit(0)) == []
    assert got(df.selectExpr("CAST(NULL AS BIGINT) AS vec_id", "embedding", "label")) == []


def test_trees_assign_whole_nodes_exactly():
    r = np.random.default_rng(2)
    centres = r.integers(-5000, 5000, (20, 4))
    points = (centres[r.integers(0, 20, 4000)] + r.integers(-20, 20, (4000, 4))).astype(np.int64)
    levels = codes.halvings(len(points), codes.LEAF)
    order = codes.tree_order(points, levels)
    whole, rows, label = codes.assign(codes.Tree(points[order], levels), codes.EntryTree(centres))
    found = np.full(len(points), -1)
    for level, nodes, entry in whole:
        for k, e in zip(nodes, entry):
            assert (found[levels[level][k]:levels[level][k + 1]] == -1).all()
            found[levels[level][k]:levels[level][k + 1]] = e
    assert (found[rows] == -1).all()
    assert len(rows) < len(points) / 2                     # most parts go with their node
    found[rows] = label
    d = ((points[order][:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (found == d.argmin(axis=1)).all()
