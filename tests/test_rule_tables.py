"""Rules kept as tables against the literal rules and against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from rategrid.functions.columns import bucket_label
from rategrid.operators.limits import rate_band
from rategrid.operators.rule_tables import bucket_label_table, interval_join, rate_band_table
from rategrid.rules import AMOUNT_BUCKETS, Band

NAN = float("nan")
FLAGS = ["a", "b", "c", None]
RATES = [None, NAN, 0.0, 0.1, 0.15, 0.2, 0.3, 0.5, 0.9, 1.0]
BANDS = [Band("a", 0.15, 0.5), Band("a", 0.1, 0.3), Band("b", None, 0.9), Band("b", 0.2, None), Band("x", 0.1, 1.0)]


def grid(spark):
    rows = [(i, f, r) for i, (f, r) in enumerate((f, r) for f in FLAGS for r in RATES)]
    return spark.createDataFrame(rows, "id int, flg_subsegmento_consumo string, tasa_propuesta double")


def table(spark, bands):
    return spark.createDataFrame([(b.subsegment, b.lo, b.hi) for b in bands],
                                 "flg_subsegmento_consumo string, lo double, hi double")


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize("mode", ["drop", "keep"])
@pytest.mark.parametrize("bands", [BANDS, BANDS[:1], [*BANDS, Band(None, 0.12, 0.95)]])
@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_bands_equal_the_literal_rules(spark, mode, bands, limit):
    g = grid(spark)
    got = rate_band_table(g, table(spark, bands), mode, broadcast_rules=limit, rows_per_task=5)
    assert got.columns == g.columns
    assert ids(got) == ids(rate_band(g, bands, mode))


def test_bands_per_month(spark):
    g = grid(spark).withColumn("codmes", F.when(F.col("id") % 3 > 0, F.col("id") % 3))
    months = {1: BANDS[:2], 2: BANDS[2:]}
    t = None
    for m, bands in months.items():
        part = table(spark, bands).withColumn("codmes", F.lit(m))
        t = part if t is None else t.unionByName(part)
    for mode in ("drop", "keep"):
        want = [i for m, bands in months.items() for i in ids(rate_band(g.where(F.col("codmes") == m), bands, mode))]
        want += ids(g.where("codmes IS NULL"))
        assert ids(rate_band_table(g, t, mode, per=["codmes"])) == sorted(want)
    assert ids(rate_band_table(g, t.limit(0), "drop", per=["codmes"])) == ids(g)


def brute(rows, rules):
    out = []
    for i, p, x in rows:
        for n, q, lo, hi in rules:
            if p is not None and p == q and x is not None and x == x and lo == lo and hi == hi:
                if (lo is None or x >= lo) and (hi is None or x < hi):
                    out.append((i, n))
    return sorted(out)


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_ten_thousand_overlapping_intervals(spark, limit):
    rnd = random.Random(7)
    odd = [None, NAN, 0.0, -0.0, 1e308, -1e308, 1e-310, float("inf"), float("-inf"), 4.0, 8.0]
    rows = [(i, rnd.choice(["p", "q", None]), x) for i, x in enumerate(
        odd + [round(rnd.uniform(-50, 50), 2) for _ in range(300)])]
    rules = []
    for n in range(10_000):
        lo = round(rnd.uniform(-60, 60), 2)
        rules.append((n, rnd.choice(["p", "q", "r", None]), lo, lo + rnd.choice([-1.0, 0.0, 1e-9, 0.01, 0.5, 1.0, 4.0])))
    rules += [(20_000, "p", None, 4.0), (20_001, "p", 4.0, None), (20_002, "q", None, None), (20_003, "q", NAN, 5.0),
              (20_004, "p", -1e308, 1e308), (20_007, "p", -0.7e308, 1e308), (20_005, "q", 0.0, 5e-310), (20_006, "q", 4.0, 8.0)]
    r = spark.createDataFrame(rows, "id int, seg string, x double")
    t = spark.createDataFrame(rules, "rule int, seg string, lo double, hi double")
    got = interval_join(r, t, "x", ["seg"], broadcast_rules=limit, rows_per_task=50)
    assert got.columns == ["id", "seg", "x", "rule"]
    want = brute(rows, rules)
    assert sorted((a["id"], a["rule"]) for a in got.collect()) == want and len(want) > 3_000
    left = interval_join(r, t, "x", ["seg"], how="left", broadcast_rules=limit)
    alone = {a["id"] for a in left.where("rule IS NULL").collect()}
    assert alone == {i for i, *_ in rows} - {i for i, _ in want} and left.count() == len(want) + len(alone)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_buckets_equal_the_literal_labels(spark):
    amounts = [None, NAN, -5.0, 0.0, 4999.99, 5000.0, 7999.0, 8000.0, 119999.0, 120000.0, 1e12]
    rows = spark.createDataFrame(list(enumerate(amounts)), "id int, mtofinalofertadosol double")
    ends = [None, *[u for u, _ in AMOUNT_BUCKETS]]
    t = spark.createDataFrame([(ends[i], u, n) for i, (u, n) in enumerate(AMOUNT_BUCKETS)],
                              "lo double, hi double, rng_mto_v2 string")
    got = bucket_label_table(rows, t, open_label=AMOUNT_BUCKETS[-1][1])
    want = rows.withColumn("rng_mto_v2", bucket_label("mtofinalofertadosol"))
    key = lambda r: (r["id"], r["rng_mto_v2"])
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_no_rules_and_clashing_names(spark):
    rows = spark.createDataFrame([(1, 2.0)], "id int, x double")
    none = spark.createDataFrame([], "rule int, lo double, hi double")
    assert interval_join(rows, none, "x").count() == 0
    assert [tuple(r) for r in interval_join(rows, none, "x", how="left").collect()] == [(1, 2.0, None)]
    with pytest.raises(ValueError, match="id"):
        interval_join(rows, none.withColumnRenamed("rule", "id"), "x")
