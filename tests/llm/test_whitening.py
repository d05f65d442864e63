from fractions import Fraction

import numpy as np
import pytest

from rategrid.llm import whitening


def brute(rows, count=4):
    """Whitening with exact rational covariances."""
    kept = []
    for i, e in rows:
        if e is None or any(v is None or not np.isfinite(v) for v in e):
            continue
        kept.append((i, [int(np.floor(256 * float(v))) for v in e]))
    width = max((len(x) for _, x in kept), default=0)
    kept = [(i, x + [0] * (width - len(x))) for i, x in kept]
    fit = sorted(set(tuple(x) for _, x in kept))
    n = len(fit)
    s = [sum(x[d] for x in fit) for d in range(width)]
    c = [[Fraction(n * x[d] - s[d], n) for d in range(width)] for x in fit]
    v = [[sum(y[i] * y[j] for y in c) / n for j in range(width)] for i in range(width)]
    dev = {}
    for i, x in kept:
        dev.setdefault(i, []).append(sum((n * x[d] - s[d]) ** 2 for d in range(width)))
    return n, s, np.array([[float(q) for q in row] for row in v]), kept, dev


def check(spark, rows, df=None):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>") if df is None else df
    got = whitening.whiten(df).collect()
    n, s, v, kept, dev = brute(rows)
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    good = int((e[:4] > e[0] * len(e) * np.finfo(float).eps).sum())
    assert len(got) == good * len(kept)
    assert all(r["n"] == n and r["identity_error"] <= 1e-4 for r in got)
    for k in range(good):
        part = [r for r in got if r["component"] == k + 1]
        assert sorted(r["vec_id"] for r in part if r["vec_id"] is not None) == sorted(i for i, _ in kept if i is not None)
        assert part[0]["explained"] == pytest.approx(e[k] / np.trace(v), rel=1e-4)
        want = {}
        for i, x in kept:
            want.setdefault(i, []).append(float((np.array(x) - np.array(s) / n) @ q[:, k] / np.sqrt(e[k])))
        for sign in (1, -1):
            if all(min(abs(r["whitened"] * sign - w) for w in want[r["vec_id"]]) < 1e-6 for r in part):
                break
        else:
            raise AssertionError(f"component {k + 1} differs")
    for r in got:
        assert r["deviation"] in [d if d < 2**63 else None for d in dev[r["vec_id"]]]
    return got


def odd_rows():
    r = np.random.default_rng(3)
    rows = [(i, [float(v) for v in r.normal(0, [1, .5, .25, 2, .1])]) for i in range(80)]
    return rows + [(5, rows[3][1]), (5, rows[3][1]), (None, rows[4][1]), (None, [1.0, 2.0, -1.0, 0.5, 0.25]), (200, None),
                   (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [float("nan")] * 5), (203, [float("inf")] * 5),
                   (204, [0.5]), (205, [-0.0] * 5)]


def test_odd_rows_against_exact_covariances(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS x", "2 AS _c", "3 AS n")
    check(spark, rows, df)


def test_real_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    check(spark, [(r["vec_id"], r["embedding"]) for r in df.collect()], df)


def test_large_components_stay_exact(spark):
    rows = [(i, [1e9 + i, float(i % 7), -1e12 * (i % 3)]) for i in range(40)] + [(99, [1e5, 3.0, 4e30])]
    n, s, v, kept, dev = brute(rows)
    kept_small = rows[:40]
    got = whitening.whiten(spark.createDataFrame(kept_small, "vec_id long, embedding array<double>")).collect()
    n, s, v, _, dev = brute(kept_small)
    assert {r["vec_id"]: r["deviation"] for r in got} == {i: d[0] if d[0] < 2**63 else None for i, d in dev.items()}
    # one entry beyond 64 bits saturates; the query still answers
    assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).count() > 0


def test_no_variance_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(df).count() == 0
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(0, []), (1, None)], "vec_id long, embedding array<float>")).count() == 0
    flat = [(i, [float(i), float(i), 1.0]) for i in range(9)]
    assert {r["component"] for r in check(spark, flat)} == {1}


def test_pair_squares_recover_cross_products():
    x = np.random.default_rng(1).integers(-10**6, 10**6, (500, 6))
    s = [int(v) for v in x.sum(axis=0)]
    v, trace = whitening.covariance(500, s, [int(q) for q in whitening.pair_squares(x, [a // 500 for a in s])])
    want = np.cov(x.T.astype(float), bias=True)
    assert np.allclose(v, want, rtol=1e-12) and trace == pytest.approx(np.trace(want), rel=1e-12)
