"""Selection rules on hand-made keys (ties, zero totals, cancelling scores,
duplicated rates, near ties, negative and null scores)."""

import pytest
from pyspark.sql import functions as F

from rategrid.operators.selection import best_rate, pick_rates
from rategrid.plans.tradeoff import final_selection

# key -> scenarios (iter, rate, objective); prob is 1 so the score equals the objective
CASES = {
    "tie": [(-1, 0.20, 5.0), (0, 0.30, 5.0), (1, 0.40, 1.0)],
    "zero": [(-1, 0.20, 0.0), (0, 0.30, 0.0), (1, 0.40, 0.0)],
    "cancel": [(-1, 0.20, -2.0), (0, 0.30, 0.0), (1, 0.40, 2.0)],
    "dup": [(-1, 0.20, 9.0), (0, 0.20, 9.0), (1, 0.40, 1.0)],
    "near": [(-1, 0.20, 5.00000000000001), (0, 0.30, 5.0)],
    "neg": [(-1, 0.20, -3.0), (0, 0.30, -1.0)],
    "nul": [(-1, 0.20, None), (0, 0.30, -1.0)],
}
# key -> (rate, raw iter, recovered rows with the original fan-out)
EXPECT_MIN = {
    "tie": (0.20, -1, 1), "zero": (0.20, -1, 1), "cancel": (0.30, 0, 1), "dup": (0.20, -1, 4),
    "near": (0.20, -1, 1), "neg": (0.30, 0, 1), "nul": (0.20, -1, 1),
}
EXPECT_SUM = {
    "tie": (0.50, -1, 0), "zero": (0.90, 0, 0), "cancel": (0.70, 1, 0), "dup": (0.40, -1, 1),
    "near": (0.50, -1, 0), "neg": (0.30, 0, 1), "nul": (0.20, -1, 1),
}


@pytest.fixture(scope="module")
def grid(spark):
    rows = [(k, 7, it, r, 1000.0, 1.0, o) for k, sc in CASES.items() for it, r, o in sc]
    g = spark.createDataFrame(
        rows, "llave string, codclavecic long, iter int, tasa_propuesta double, mtofinalofertadosol double, "
              "prob_adj_ef double, van double")
    return g.withColumns({"van_estimado": F.col("van") * F.col("prob_adj_ef"),
                          "mto_estimado": F.col("mtofinalofertadosol") * F.col("prob_adj_ef")})


@pytest.mark.parametrize("tie,expect", [("min", EXPECT_MIN), ("sum", EXPECT_SUM)])
def test_best_rate_edges(grid, tie, expect):
    got = {r.llave: r for r in best_rate(grid, "van", 2.5, ["van"], tie=tie).collect()}
    assert set(got) == set(CASES)
    for k, (rate, it, _) in expect.items():
        assert got[k].tasa_of_1 == pytest.approx(rate, abs=1e-12), k
        assert got[k].iter_of_1 == it, k


@pytest.mark.parametrize("tie,expect", [("min", EXPECT_MIN), ("sum", EXPECT_SUM)])
def test_recovered_rows_edges(grid, tie, expect):
    rows = final_selection(grid, "van", 2.5, ["van"], tie=tie)
    got = {r.llave: r.n for r in rows.groupBy("llave").agg(F.sum("copies").alias("n")).collect()}
    for k, (_, _, n) in expect.items():
        assert got.get(k, 0) == n, k


def test_wide_picks_equal_single_picks(grid):
    exps = [0.5, 2.5, 7.0]
    wide = {(r.llave, r.exp): r.tasa_of_1 for r in pick_rates(grid, "van", exps).collect()}
    for e in exps:
        for r in best_rate(grid, "van", e, ["van"], tie="min").collect():
            if r.tasa_of_1 is not None:
                assert wide[(r.llave, e)] == r.tasa_of_1


def test_nan_and_null_scores_are_zero(spark):
    g = spark.createDataFrame(
        [("a", -1, 0.2, float("nan"), 1.0), ("a", 0, 0.3, -1.0, 1.0), ("b", 0, 0.3, 2.0, float("nan")),
         ("b", 1, 0.4, -2.0, 1.0)],
        "llave string, iter int, tasa_propuesta double, van double, prob_adj_ef double")
    g = g.withColumns({"van_estimado": F.col("van") * F.col("prob_adj_ef"), "mto_estimado": F.lit(1.0),
                       "mtofinalofertadosol": F.lit(1.0)})
    got = {r.llave: r.tasa_of_1 for r in best_rate(g, "van", 2.0, ["van"]).collect()}
    # NaN score becomes 0 and beats the negative ones
    assert got == {"a": 0.2, "b": 0.3}


def test_missing_values_edges(spark):
    """Null key, null rate, missing lead row with all-zero scores, all-null indicator."""
    rows = [
        (None, 0, 0.30, 5.0),          # null key: never picked
        ("nullrate", -1, None, 9.0),   # best score at a null rate: the pick is 0 (filled), no row recovered
        ("nullrate", 0, 0.30, 1.0),
        ("nolead", -1, 0.20, 0.0),     # no lead row and all-zero scores: every row is a candidate
        ("nolead", 1, 0.40, 0.0),
        ("nullind", 0, 0.30, None),    # indicator null everywhere: scores 0, the lead rule applies
        ("nullind", 1, 0.40, None),
    ]
    g = spark.createDataFrame(rows, "llave string, iter int, tasa_propuesta double, van double").withColumns({
        "prob_adj_ef": F.lit(1.0), "codclavecic": F.lit(1).cast("long"), "mtofinalofertadosol": F.lit(100.0)})
    g = g.withColumns({"van_estimado": F.col("van") * F.col("prob_adj_ef"),
                       "mto_estimado": F.col("mtofinalofertadosol") * F.col("prob_adj_ef")})
    picks = {r.llave: r for r in best_rate(g, "van", 2.0, ["van"], tie="min").collect()}
    assert picks[None].tasa_of_1 is None
    assert picks["nullrate"].tasa_of_1 == 0.0 and picks["nullrate"].iter_of_1 == -1
    assert picks["nolead"].tasa_of_1 == 0.20 and picks["nolead"].oferta is None
    assert picks["nullind"].tasa_of_1 == 0.30 and picks["nullind"].van_lead == 0.0
    chosen = {r.llave for r in final_selection(g, "van", 2.0, ["van"], tie="min").collect()}
    assert chosen == {"nolead", "nullind"}


def test_zero_amount_portfolio(spark):
    from rategrid.operators.summary import portfolio

    g = spark.createDataFrame([(0.2, 0.0, 0.5, 0.0, 1.0)], "tasa_propuesta double, mtofinalofertadosol double, "
                              "prob_adj_ef double, mto_estimado double, van_estimado double")
    r = portfolio(g, ["van"]).first()
    assert r.tasa_pnd is None and r.oferta == 0.0 and r.tasa_cli == 0.2


def brute_picks(rows, exps, tie):
    """Every key's pick by the rules, from all of its rows."""
    import math
    from decimal import ROUND_HALF_UP, Decimal

    def score(v, p, e):
        if v is None or p is None or math.isnan(v) or math.isnan(p) or (p < 0 and e != int(e)):
            return 0.0
        o = v * math.pow(p, e)
        return 0.0 if math.isnan(o) else o

    def dec(x):
        return Decimal(repr(x)).quantize(Decimal("1e-10"), ROUND_HALF_UP)

    out, keys = {}, {}
    for k, it, r, v, p in rows:
        keys.setdefault(k, []).append((it, 0.0 if r is None or math.isnan(r) else r, v, p))
    for k, rs in keys.items():
        for e in exps:
            o = [score(v, p, e) for _, _, v, p in rs]
            best, total = max(o), sum(o)
            cand = [r for (it, r, _, _), x in zip(rs, o) if dec(x) == dec(best) or (total == 0 and it == 0)]
            if cand:
                out[k, e] = min(cand) if tie == "min" else sum(cand)
    return out


@pytest.mark.parametrize("rows_per_task", [2_000_000, 20])
@pytest.mark.parametrize("tie", ["min", "sum"])
def test_envelope_picks_equal_brute_force(spark, tie, rows_per_task):
    """Random keys with ties, zeros, negatives, null and NaN cells, tiny scores and cancelling sums."""
    import random

    from rategrid.operators.selection import sweep_picks, unpivot_picks
    from rategrid.operators.skew import keyed_stage

    r, exps = random.Random(11), [0.5, 1.0, 2.5, 6.0, 9.5]
    nan, rows = float("nan"), []
    for k in range(120):
        kind = k % 6
        for it in range(-r.randint(1, 6), r.randint(1, 30)):
            v = r.choice([0.0, 1.0, 250.0, 4000.0, r.uniform(0, 5000)]) if kind else r.choice([-3.0, 3.0, 0.0, 1.0])
            v = -v if kind == 2 and r.random() < .5 else v * 1e-9 if kind == 3 else v
            p = r.choice([1.0, 0.5, 0.25, r.random()])
            if kind >= 4:
                v, p = r.choice([v, v, v, None, nan]), r.choice([p, p, p, None, nan, 0.0])
            rows.append((f"k{k}", it, r.choice([0.1, 0.2, 0.25, None]) if kind == 5 else it / 8, v, p))
    g = spark.createDataFrame(rows, "llave string, iter int, tasa_propuesta double, van double, prob_adj_ef double")
    keyed = keyed_stage(g, name="brute", rows_per_task=rows_per_task)
    assert (keyed.hot.table is None) == (rows_per_task > 20)
    got = {(x.llave, x.exp): x.tasa_of_1 for x in unpivot_picks(sweep_picks(keyed, "van", exps, tie), exps).collect()}
    want = brute_picks(rows, exps, tie)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
