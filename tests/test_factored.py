import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rategrid.operators import factored, rate_change_histogram

GRID = "llave string, iter int, tasa_propuesta double"
FINAL = "llave string, tasa_propuesta double, copies long"


def brute(final, grid, bins=60):
    finite = [(k, s, r) for k, s, r in grid if s == 0 and k is not None and r is not None and math.isfinite(r)]
    dif = Counter()
    for k, r, n in final:
        if k is None or r is None or not math.isfinite(r):
            continue
        for k2, _, b in finite:
            if k == k2:
                dif[r - b] += n
    if not dif:
        return []
    mn, mx = min(dif), max(dif)
    out = Counter()
    for x, n in dif.items():
        out[1 if mx == mn else min(math.floor(float(bins) * (x - mn) / (mx - mn)) + 1, bins)] += n
    step = (mx - mn) / float(bins)
    return sorted((b, mn + (b - 1) * step, mn + b * step, n) for b, n in out.items())


def got(spark, final, grid, bins=60):
    rows = rate_change_histogram(spark.createDataFrame(final, FINAL), spark.createDataFrame(grid, GRID), bins).collect()
    return sorted(tuple(r[c] for c in ("bin", "lo", "hi", "n")) for r in rows)


def test_equals_all_pairs(spark):
    r = random.Random(3)
    odd = [None, math.nan, math.inf, -math.inf, 0.0, -0.0]
    keys = ["a", "b", "hot", None]

    def rate():
        return r.choice(odd) if r.random() < 0.1 else r.choice([round(r.random(), 3), r.random() * 1e-9, r.gauss(0, 5)])

    grid = [(k, r.choice([0, 0, 1, -2]), rate()) for k in keys for _ in range(120)] + [("only", 0, 0.5)]
    final = [(k, rate(), r.randint(1, 4)) for k in keys for _ in range(90)] + [("none", 0.5, 1)]
    assert got(spark, final, grid) == brute(final, grid)
    assert got(spark, final, grid, 3) == brute(final, grid, 3)


@pytest.mark.parametrize("final, grid", [
    ([], []),
    ([("a", 0.5, 2)], []),
    ([("a", 0.5, 2), ("b", 0.75, 1)], [("a", 0, 0.25), ("a", 0, 0.25), ("b", 0, 0.5), ("b", 1, 9.0)]),   # one difference
    ([("a", 0.1 + 0.1 * i, 1) for i in range(13)], [("a", 0, 0.3 * i) for i in range(7)]),               # on bin edges
])
def test_edges(spark, final, grid):
    assert got(spark, final, grid) == brute(final, grid)


def test_rates_closer_than_any_cell_are_paired_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(factored, "LEVELS", 1)
    r = random.Random(5)
    grid = [("a", 0, 0.5 + r.random() * 1e-6) for _ in range(40)] + [("a", 0, 0.0)]
    final = [("a", 1.0 + r.random() * 1e-6, 2) for _ in range(40)]
    assert got(spark, final, grid) == brute(final, grid)


def test_hot_key_pairs_stay_linear(spark):
    """As many distinct lead rates as rows: pairs per rate do not grow with the rates."""
    def pairs(n):
        side = spark.range(n).select(F.lit("hot").alias("k"), (F.xxhash64("id") / F.lit(2.0**63)).alias("_v"),
                                     F.lit(1).cast("long").alias("_w"))
        mn, mx = factored.change_range(side, side, "k")
        levels = factored.pair_levels(side, side, mn, mx, 6, "k")
        assert sum(p.where("lo = hi").agg(F.sum("n")).first()[0] or 0 for p in levels) == n * n
        return sum(p.count() for p in levels) / n

    small, large = pairs(2000), pairs(16000)
    assert large < 1.5 * small and large < 16000 / 50
