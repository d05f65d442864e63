"""Registered queries: every operator of the library run on the benchmark tables.

Each entry is ``f(spark, sf_dir) -> DataFrame`` over grids that Spark derives
from the benchmark tables (see :mod:`rategrid.sources.tables`), so the work
grows with the scale factor.  The oracle SQL for each entry lives in
:mod:`rategrid.oracle_sql`; both sides alias and round their outputs the same
way (aggregated doubles only: sums of amounts to whole units, ratios to nine
decimals, scores to four, because summation order and ``pow`` may differ in
the last bits between engines).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rategrid.functions.columns import fill_zero, nansum, nansum_or_zero, weighted_mean
from rategrid.operators.limits import (
    bands_need_flag,
    cap_iterations,
    enrich,
    expected,
    lead_rows,
    lead_rows_under_ceiling,
    rate_band,
    rate_floor,
    scenario,
    score_filter,
)
from rategrid.operators.prep import (
    conform,
    key_sample,
    nearest_rate,
    normalise_names,
    numbered,
    offer_lot,
    preview,
    sort_scenarios,
    top_offer,
)
from rategrid.operators.factored import rate_change_histogram
from rategrid.operators.selection import (
    OBJ,
    best_rate,
    chosen_rows,
    fill_numeric,
    key_stats,
    lead_pivots,
    objective,
    objective_pandas_fill,
    score,
)
from rategrid.operators.summary import (
    bucket_report,
    compare,
    lead_summary_pandas,
    merge_profiles,
    portfolio,
    profile,
    profile_sketch,
    rate_change,
    read_profile,
)
from rategrid.operators.rule_tables import bucket_report_table, rate_band_table
from rategrid.operators.skew import HotKeys, hot_keys, keyed_stage
from rategrid.plans.pipelines import publish_outputs, run_multi, run_pandas_rules, run_single, write_outputs
from rategrid.plans.tradeoff import final_selection, scenario_summary, tradeoff
from rategrid.rules import Band
from rategrid.schema import FLOOR_SCHEMA
from rategrid.sources.io import checkpoint_dir, export_csv, read_csv_table, stage, write_stage
from rategrid.sources.runs import publish_run, read_published
from rategrid.sources.tables import (
    dense_grid,
    floor_table,
    gappy_grid,
    gappy_lead_grid,
    hot_key_grid,
    natural_grid,
    offers_table,
    product_table,
)

# ---------------------------------------------------------------------------
# Fixed test parameters (the benchmark tables' market segments stand in for
# the subsegments; MACHINERY is deliberately left without a band)
# ---------------------------------------------------------------------------
TEST_BANDS: tuple[Band, ...] = (
    Band("AUTOMOBILE", 0.145, 0.959),
    Band("BUILDING", 0.235, 0.959),
    Band("FURNITURE", 0.135, 0.429),
    Band("HOUSEHOLD", 0.125, 0.199),
)
SINGLE = ("van",)
MULTI = ("roa", "avg_balance", "roa_saldo")
MULTI_TARGET = "roa_saldo"
EXP_SINGLE = 2.5
EXP_MULTI = 2.0
SAMPLE_KEYS = 1000
LOT_SALE_TYPE = 1      # offers of sale type 1 (urgent priority)
LOT_OFFER_TYPE = 1     # and offer type 1 (finished orders)
PANDAS_EXP = 0.5
HOT_KEY_TASK_ROWS = 2000  # rows per salt for the skewed fixture (default: two million)
PREVIEW_ROWS = 100
NATURAL_EXP = 2.5

AMOUNT_DIGITS = 0
RATIO_DIGITS = 9
PCT_DIGITS = 6         # relative differences can reach hundreds; six decimals keep ~9 significant digits
SCORE_DIGITS = 4
VAN_SUM_DIGITS = 8     # the exact decimals of an expected value: no sum lies on a rounding tie
# Sums over repeated rows of the line-item grid, one digit past the exact
# decimals of each value (price 2, discount 2, expected amount 4, expected
# value 6), so the rounding never meets a tie and absorbs summation order.
NATURAL_DIGITS = {"oferta": 3, "prob_": 3, "tasa_": 3, "mto_": 5, "van_": 7}
# Small groups of lead rows: past the exact decimals (2 and 5); three for the
# expected value, whose seven decimals rarely end in a tie.
LEAD_DIGITS = {"oferta": 3, "mto_estimado": 6, "van_estimado": 3}


# ---------------------------------------------------------------------------
# Grids
# ---------------------------------------------------------------------------

def grid_single(spark: SparkSession, sf: str) -> DataFrame:
    """Dense grid with expected values of the single-indicator flow."""
    return expected(dense_grid(spark, sf), SINGLE)


def dense_hot(spark: SparkSession, sf: str) -> HotKeys:
    """Hot keys of the dense grid, which serve every filter and key join of it."""
    return hot_keys(dense_grid(spark, sf))


def capped_single(spark: SparkSession, sf: str, unmatched: str = "drop", hot: HotKeys | None = None) -> DataFrame:
    """Caps, subsegment enrichment and rate bands (the single-indicator limits)."""
    g = cap_iterations(grid_single(spark, sf))
    how = "inner" if unmatched == "drop" and bands_need_flag(TEST_BANDS) else "left"
    return rate_band(enrich(g, product_table(spark, sf), how=how, hot=hot), TEST_BANDS, unmatched=unmatched)


def grid_multi(spark: SparkSession, sf: str) -> DataFrame:
    return expected(score_filter(dense_grid(spark, sf)), MULTI)


def capped_multi(spark: SparkSession, sf: str, hot: HotKeys | None = None) -> DataFrame:
    """Risk-score filter, expected values and per-key rate floors.  The floors, a row per
    order, are the hash table of the join: the grid's rows need no sort, which spills."""
    return rate_floor(grid_multi(spark, sf), floor_table(spark, sf).hint("shuffle_hash"), hot=hot)


def _limited(make: Callable, spark: SparkSession, sf: str) -> tuple[DataFrame, HotKeys]:
    """A limited dense grid and its hot keys, found once."""
    hot = dense_hot(spark, sf)
    return make(spark, sf, hot=hot), hot


def grid_natural(spark: SparkSession, sf: str) -> DataFrame:
    """Line-item grid: missing lead rows, repeated steps and tied rates."""
    return expected(natural_grid(spark, sf), SINGLE)


# ---------------------------------------------------------------------------
# Output helpers
# ---------------------------------------------------------------------------

def _round(df: DataFrame, digits: int, cols: Iterable[str]) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


def _longs(df: DataFrame) -> DataFrame:
    """Integral columns as long (the oracle casts them to BIGINT)."""
    ints = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    return df.withColumns({f.name: F.col(f.name).cast("long") for f in df.schema.fields
                           if isinstance(f.dataType, ints)})


def _portfolio_rounding(df: DataFrame, indicators: Iterable[str], suffix: str) -> DataFrame:
    amounts = [c for c in [f"oferta", f"mto_estimado{suffix}"] + [f"{i}_estimado{suffix}" for i in indicators]
               if c in df.columns]
    ratios = [c for c in [f"prob{suffix}", f"tasa_cli{suffix}", f"tasa_pnd{suffix}"] if c in df.columns]
    return _round(_round(df, AMOUNT_DIGITS, amounts), RATIO_DIGITS, ratios)


def _tradeoff_rounding(df: DataFrame, indicators: Iterable[str]) -> DataFrame:
    inds = list(indicators)
    df = _portfolio_rounding(df, inds, "")
    df = _portfolio_rounding(df, inds, "_e")
    amounts = ["dif_mto_est"] + [f"dif_{i}_est" for i in inds]
    ratios = ["dif_prob", "dif_t_cli", "dif_t_pnd"]
    pcts = ["pct_prob", "pct_t_cli", "pct_t_pnd", "pct_mto_est"] + [f"pct_{i}_est" for i in inds]
    df = _round(_round(df, AMOUNT_DIGITS, amounts), RATIO_DIGITS, ratios)
    return _longs(_round(df, PCT_DIGITS, pcts))


# ---------------------------------------------------------------------------
# Row-wise operators and limits
# ---------------------------------------------------------------------------

def q_expected_values(spark, sf):
    return _longs(grid_single(spark, sf).select("llave", "iter", "van_estimado", "mto_estimado"))


def q_expected_values_multi(spark, sf):
    g = expected(dense_grid(spark, sf), MULTI)
    return _longs(g.select("llave", "iter", *[f"{i}_estimado" for i in MULTI], "mto_estimado"))


def q_iteration_caps(spark, sf):
    return _longs(cap_iterations(grid_single(spark, sf)).select("llave", "iter", "seg_wtp_cef"))


def q_rate_band_drop(spark, sf):
    return _longs(capped_single(spark, sf, "drop").select(
        "llave", "iter", "tasa_propuesta", "flg_subsegmento_consumo"))


def q_rate_band_keep(spark, sf):
    return _longs(capped_single(spark, sf, "keep").select(
        "llave", "iter", "tasa_propuesta", "flg_subsegmento_consumo"))


def q_rate_floor(spark, sf):
    g = rate_floor(dense_grid(spark, sf), floor_table(spark, sf))
    return _longs(g.select("llave", "iter", "tasa_propuesta", "tasapropuestamin"))


def q_score_filter(spark, sf):
    return _longs(score_filter(dense_grid(spark, sf)).select("llave", "iter", "numscoreriesgo"))


def q_scenario_slice(spark, sf):
    return _longs(scenario(grid_single(spark, sf), -8).select("llave", "iter", "tasa_propuesta", "van_estimado"))


def q_conform_types(spark, sf):
    """All-string copy of the grid (as an untyped CSV arrives) typed back."""
    g = dense_grid(spark, sf)
    cols = ["seg_wtp_cef", "numscoreriesgo", "codclavecic", "llave", "mtofinalofertadosol", "iter",
            "tasa_propuesta", "prob_adj_ef", "van"]
    untyped = g.select(*[F.col(c).cast("string").alias(c.upper()) for c in cols])
    schema = T.StructType([T.StructField(c, g.schema[c].dataType) for c in cols])
    return _longs(conform(normalise_names(untyped), schema))


# ---------------------------------------------------------------------------
# Summaries
# ---------------------------------------------------------------------------

def q_lead_summary(spark, sf):
    out = portfolio(lead_rows(grid_single(spark, sf)), SINGLE)
    return _longs(_portfolio_rounding(out, SINGLE, ""))


def q_lead_summary_ceiling(spark, sf):
    out = portfolio(lead_rows_under_ceiling(capped_multi(spark, sf)), MULTI)
    return _longs(_portfolio_rounding(out, MULTI, ""))


def q_weighted_mean(spark, sf):
    out = lead_rows(grid_single(spark, sf)).groupBy("seg_wtp_cef").agg(
        weighted_mean("tasa_propuesta", "mtofinalofertadosol").alias("tasa_pnd"))
    return _longs(_round(out, RATIO_DIGITS, ["tasa_pnd"]))


def q_nansum_variants(spark, sf):
    g = expected(gappy_grid(spark, sf), SINGLE)
    out = g.groupBy("iter", F.col("van").isNull().cast("int").alias("van_missing")).agg(
        nansum("van_estimado").alias("van_nansum"),
        nansum_or_zero("van_estimado").alias("van_nansum_zero"),
        F.count(F.lit(1)).alias("n"),
    )
    return _longs(_round(out, AMOUNT_DIGITS, ["van_nansum", "van_nansum_zero"]))


def q_column_profile(spark, sf):
    g = gappy_grid(spark, sf)
    return _longs(profile(g, g.columns))


def q_column_profile_merged(spark, sf):
    """Profiles sketched per order month and merged: exact counts and extremes, and
    whether each distinct count is within five standard errors of the exact one."""
    g = stage(gappy_grid(spark, sf), "profile")
    parts = None
    for half in (0, 1):
        part = profile_sketch(g.where(F.col("codmes") % 2 == half))
        parts = part if parts is None else parts.unionByName(part)
    merged = read_profile(merge_profiles(stage(parts, "sketches")))
    exact = profile(g, g.columns).select(F.col("column").alias("_c"), F.col("distinct").alias("_d"))
    out = merged.join(exact, F.col("column") == F.col("_c"))
    return _longs(out.select("column", "type", "non_null", "rows", (
        F.abs(F.col("distinct") - F.col("_d")) <= F.lit(0.04) * F.col("_d")).alias("close")))


# ---------------------------------------------------------------------------
# Scores and selection kernel
# ---------------------------------------------------------------------------

def q_objective_values(spark, sf):
    g = fill_numeric(objective(capped_single(spark, sf), "van", EXP_SINGLE).select("llave", "iter", OBJ))
    return _longs(_round(g, SCORE_DIGITS, [OBJ]))


def q_objective_fill_variants(spark, sf):
    g = gappy_grid(spark, sf)
    a = objective(g, "van", EXP_SINGLE, name="obj_fill").withColumn("obj_fill", fill_zero("obj_fill"))
    b = objective_pandas_fill(a, "van", EXP_SINGLE, name="obj_pandas")
    return _longs(_round(b.select("llave", "iter", "obj_fill", "obj_pandas"), SCORE_DIGITS,
                         ["obj_fill", "obj_pandas"]))


def _key_stats(grid: DataFrame, target: str, exp: float, inds) -> DataFrame:
    scored, s = score(grid, target, [exp], inds)
    scored = scored.withColumnRenamed(s.names[0], OBJ)
    out = key_stats(scored, inds)
    out = _round(out, VAN_SUM_DIGITS, [c for c in out.columns if c == "s_van_estimado"])
    return _round(out, SCORE_DIGITS, [c for c in out.columns if OBJ in c or c[:2] == "s_" and c != "s_van_estimado"])


def q_key_stats(spark, sf):
    return _key_stats(capped_single(spark, sf), "van", EXP_SINGLE, SINGLE)


def q_key_stats_multi(spark, sf):
    return _key_stats(capped_multi(spark, sf), MULTI_TARGET, EXP_MULTI, MULTI)


def _best(grid, target: str, exp: float, inds, tie: str, digits: dict | None = None) -> DataFrame:
    grid, hot = grid if isinstance(grid, tuple) else (grid, None)
    out = best_rate(grid, target, exp, inds, tie=tie, hot=hot)
    if digits:
        for c in out.columns:
            d = next((v for k, v in digits.items() if c.startswith(k)), None)
            if d is not None:
                out = out.withColumn(c, F.round(F.col(c), d))
    return _longs(out)


def q_best_rate_min(spark, sf):
    return _best(_limited(capped_single, spark, sf), "van", EXP_SINGLE, SINGLE, "min")


def q_best_rate_sum(spark, sf):
    return _best(_limited(capped_single, spark, sf), "van", EXP_SINGLE, SINGLE, "sum")


def q_best_rate_multi(spark, sf):
    return _best(_limited(capped_multi, spark, sf), MULTI_TARGET, EXP_MULTI, MULTI, "min")


def q_best_rate_natural_min(spark, sf):
    return _best(grid_natural(spark, sf), "van", NATURAL_EXP, SINGLE, "min", NATURAL_DIGITS)


def q_best_rate_natural_sum(spark, sf):
    return _best(grid_natural(spark, sf), "van", NATURAL_EXP, SINGLE, "sum", NATURAL_DIGITS)


_SR = ["llave", "iter_sr", "tasa_sr", "mto_sr", "van_sr"]


def q_sr_rate_min(spark, sf):
    return _best(_limited(capped_single, spark, sf), "van", EXP_SINGLE, SINGLE, "min").select(*_SR)


def q_sr_rate_sum(spark, sf):
    return _best(_limited(capped_single, spark, sf), "van", EXP_SINGLE, SINGLE, "sum").select(*_SR)


def grid_hot_key(spark: SparkSession, sf: str) -> DataFrame:
    return expected(hot_key_grid(spark, sf), SINGLE)


def q_best_rate_hot_key(spark, sf):
    """Selection where one key holds a third of all rows (the rows per task are
    lowered so that the test tables need several salts)."""
    out = best_rate(grid_hot_key(spark, sf), "van", NATURAL_EXP, SINGLE, tie="min",
                    rows_per_task=HOT_KEY_TASK_ROWS)
    for c in out.columns:
        d = next((v for k, v in NATURAL_DIGITS.items() if c.startswith(k)), None)
        if d is not None:
            out = out.withColumn(c, F.round(F.col(c), d))
    return _longs(out)


def q_tradeoff_hot_key(spark, sf):
    g = grid_hot_key(spark, sf)
    base = portfolio(lead_rows(g), SINGLE)
    return _tradeoff_rounding(tradeoff(g, base, "van", SINGLE, rows_per_task=HOT_KEY_TASK_ROWS), SINGLE)


def q_chosen_rows_hot_key(spark, sf):
    """Recovery of the chosen rows where one key holds a third of all rows."""
    rows = final_selection(grid_hot_key(spark, sf), "van", NATURAL_EXP, SINGLE, tie="min",
                           rows_per_task=HOT_KEY_TASK_ROWS)
    return _longs(rows.select("llave", "codclavecic", "iter", "tasa_propuesta", "mtofinalofertadosol",
                              "van_estimado", "copies"))


def q_lead_pivots(spark, sf):
    return _longs(lead_pivots(capped_single(spark, sf), SINGLE))


def _chosen(grid, target: str, exp: float, inds, tie: str, distinct_on=None) -> DataFrame:
    grid, hot = grid if isinstance(grid, tuple) else (grid, None)
    rows = final_selection(grid, target, exp, inds, tie=tie, distinct_on=distinct_on, hot=hot)
    vals = [f"{i}_estimado" for i in inds]
    return _longs(rows.select("llave", "codclavecic", "iter", "tasa_propuesta", "mtofinalofertadosol", *vals,
                              "copies"))


def q_chosen_rows_unique(spark, sf):
    return _chosen(_limited(capped_single, spark, sf), "van", EXP_SINGLE, SINGLE, "min")


def q_chosen_rows_natural_min(spark, sf):
    return _chosen(grid_natural(spark, sf), "van", NATURAL_EXP, SINGLE, "min")


def q_chosen_rows_natural_sum(spark, sf):
    return _chosen(grid_natural(spark, sf), "van", NATURAL_EXP, SINGLE, "sum")


def q_final_selection_single(spark, sf):
    return _chosen(_limited(capped_single, spark, sf), "van", EXP_SINGLE, SINGLE, "sum")


def q_final_selection_multi(spark, sf):
    return _chosen(_limited(capped_multi, spark, sf), MULTI_TARGET, EXP_MULTI, MULTI, "sum", distinct_on=("codclavecic",))


def _scenario_summary(grid, target: str, exp: float, inds, tie: str) -> DataFrame:
    grid, hot = grid if isinstance(grid, tuple) else (grid, None)
    rows = final_selection(grid, target, exp, inds, tie=tie, hot=hot)
    return _longs(_portfolio_rounding(scenario_summary(rows, inds), inds, "_e"))


def q_scenario_summary(spark, sf):
    return _scenario_summary(_limited(capped_single, spark, sf), "van", EXP_SINGLE, SINGLE, "min")


def q_scenario_summary_natural(spark, sf):
    return _scenario_summary(grid_natural(spark, sf), "van", NATURAL_EXP, SINGLE, "min")


def q_compare_one(spark, sf):
    capped, hot = _limited(capped_single, spark, sf)
    rows = final_selection(capped, "van", EXP_SINGLE, SINGLE, tie="min", hot=hot)
    summ = scenario_summary(rows, SINGLE).withColumn("exp", F.lit(EXP_SINGLE))
    base = portfolio(lead_rows(grid_single(spark, sf)), SINGLE)
    return _tradeoff_rounding(compare(summ, base, SINGLE), SINGLE)


# ---------------------------------------------------------------------------
# Composite plans
# ---------------------------------------------------------------------------

def q_tradeoff_single(spark, sf):
    base = portfolio(lead_rows(grid_single(spark, sf)), SINGLE)
    capped, hot = _limited(capped_single, spark, sf)
    return _tradeoff_rounding(tradeoff(capped, base, "van", SINGLE, hot=hot), SINGLE)


def q_tradeoff_multi(spark, sf):
    capped, hot = _limited(capped_multi, spark, sf)
    keyed = keyed_stage(capped, name="capped-multi", hot=hot)
    base = portfolio(lead_rows_under_ceiling(keyed.rows), MULTI)
    return _tradeoff_rounding(tradeoff(keyed, base, MULTI_TARGET, MULTI), MULTI)


def q_tradeoff_natural(spark, sf):
    g = grid_natural(spark, sf)
    base = portfolio(lead_rows(g), SINGLE)
    return _tradeoff_rounding(tradeoff(g, base, "van", SINGLE), SINGLE)


def _final_single(spark, sf) -> tuple[DataFrame, HotKeys]:
    capped, hot = _limited(capped_single, spark, sf)
    return final_selection(capped, "van", EXP_SINGLE, SINGLE, tie="sum", hot=hot), hot


def _bucket_rounding(df: DataFrame, suffix: str) -> DataFrame:
    return _longs(_portfolio_rounding(df, SINGLE, suffix))


def q_bucket_report_base(spark, sf):
    return _bucket_rounding(bucket_report(lead_rows_under_ceiling(grid_single(spark, sf)), SINGLE), "")


def q_bucket_report_final(spark, sf):
    return _bucket_rounding(bucket_report(_final_single(spark, sf)[0], SINGLE, suffix="_e", weight="copies"), "_e")


def q_rate_change(spark, sf):
    final, hot = _final_single(spark, sf)
    out = rate_change(final, grid_single(spark, sf), hot=hot)
    return _longs(out.select("llave", "iter", "tasa_propuesta", "tasa_base", "dif_tasa", "copies"))


def q_rate_change_histogram(spark, sf):
    """From the chosen and the lead rates of each key, without their product."""
    return _longs(rate_change_histogram(_final_single(spark, sf)[0], grid_single(spark, sf)))


def q_rate_change_hot_key(spark, sf):
    """Rate change where one key holds a third of all rows: chosen rows x
    distinct lead rates of the key, not all pairs."""
    g = keyed_stage(grid_hot_key(spark, sf), name="hot-grid", rows_per_task=HOT_KEY_TASK_ROWS)
    rows = final_selection(g, "van", NATURAL_EXP, SINGLE, tie="min")
    out = rate_change(rows, g.rows.drop("_salt"), hot=g.hot)
    return _longs(out.select("llave", "codclavecic", "iter", "tasa_propuesta", "mtofinalofertadosol", "tasa_base",
                             "dif_tasa", "copies"))


# ---------------------------------------------------------------------------
# Data preparation
# ---------------------------------------------------------------------------

def q_top_offer(spark, sf):
    return _longs(top_offer(offers_table(spark, sf), tiebreak="codoferta"))


def q_nearest_rate(spark, sf):
    capped, hot = _limited(capped_single, spark, sf)
    out = nearest_rate(capped, product_table(spark, sf), hot=hot)
    return _longs(out.select("llave", "iter", "tasa_propuesta", "tasa_objetivo",
                             F.col("dif_abs").cast("double").alias("dif_abs")))


def q_top_offer_lot(spark, sf):
    offers = offer_lot(offers_table(spark, sf), sale_type=LOT_SALE_TYPE, offer_type=LOT_OFFER_TYPE)
    return _longs(top_offer(offers, tiebreak="codoferta"))


def q_indicator_max(spark, sf):
    """Global maximum of the expected indicator, per month of the grid."""
    g = grid_single(spark, sf)
    return _longs(g.groupBy("codmes").agg(F.max("van_estimado").alias("max_van_estimado")))


def q_lead_summary_pandas(spark, sf):
    """Portfolio of the lead rows of the grid with missing values (null and NaN
    in probability, rate and indicator), under the pandas rules."""
    rows = lead_rows(expected(gappy_lead_grid(spark, sf), SINGLE))
    return _longs(_portfolio_rounding(lead_summary_pandas(rows, SINGLE), SINGLE, ""))


def hot_targets(spark, sf) -> DataFrame:
    """Per key of the skewed grid a target rate, a floor and a flag."""
    keys = hot_key_grid(spark, sf).select("llave").distinct()
    n = F.length("llave")
    return keys.select("llave", (F.lit(0.01) * n).alias("tasa_objetivo"), (F.lit(0.005) * n).alias("tasapropuestamin"),
                       F.concat(F.lit("F"), n.cast("string")).alias("flg_subsegmento_consumo"))


_HOT = ["llave", "codclavecic", "iter", "tasa_propuesta", "mtofinalofertadosol"]


def q_nearest_rate_hot_key(spark, sf):
    out = nearest_rate(hot_key_grid(spark, sf), hot_targets(spark, sf).select("llave", "tasa_objetivo"),
                       rows_per_task=HOT_KEY_TASK_ROWS)
    return _longs(out.select(*_HOT, F.col("dif_abs").cast("double").alias("dif_abs")))


def q_rate_floor_hot_key(spark, sf):
    out = rate_floor(hot_key_grid(spark, sf), hot_targets(spark, sf), rows_per_task=HOT_KEY_TASK_ROWS)
    return _longs(out.select(*_HOT, "tasapropuestamin"))


def q_enrich_hot_key(spark, sf):
    out = enrich(hot_key_grid(spark, sf), hot_targets(spark, sf), rows_per_task=HOT_KEY_TASK_ROWS)
    return _longs(out.select(*_HOT, "flg_subsegmento_consumo"))


def _run_single(spark, sf):
    return run_single(dense_grid(spark, sf), product_table(spark, sf), TEST_BANDS)


def _run_multi(spark, sf):
    return run_multi(dense_grid(spark, sf), floor_table(spark, sf))


def q_pipeline_single(spark, sf):
    """End-to-end single-indicator pipeline; its trade-off table."""
    return _tradeoff_rounding(_run_single(spark, sf).tradeoff, SINGLE)


def q_pipeline_single_baseline(spark, sf):
    return _longs(_portfolio_rounding(_run_single(spark, sf).baseline, SINGLE, ""))


_FINAL = ["llave", "codclavecic", "iter", "tasa_propuesta", "mtofinalofertadosol"]


def q_pipeline_single_final(spark, sf):
    return _longs(_run_single(spark, sf).final.select(*_FINAL, "van_estimado", "copies"))


def q_pipeline_single_capped(spark, sf):
    return _longs(_run_single(spark, sf).capped.select("llave", "iter", "tasa_propuesta", "flg_subsegmento_consumo"))


def q_pipeline_single_bucket_base(spark, sf):
    return _bucket_rounding(_run_single(spark, sf).bucket_base, "")


def q_pipeline_single_bucket_final(spark, sf):
    return _bucket_rounding(_run_single(spark, sf).bucket_final, "_e")


def q_pipeline_single_rate_change(spark, sf):
    return _longs(_run_single(spark, sf).rate_change.select(
        "llave", "iter", "tasa_propuesta", "tasa_base", "dif_tasa", "copies"))


def q_pipeline_single_histogram(spark, sf):
    return _longs(_run_single(spark, sf).histogram)


def q_pipeline_multi(spark, sf):
    """End-to-end multi-indicator pipeline; its trade-off table."""
    return _tradeoff_rounding(_run_multi(spark, sf).tradeoff, MULTI)


def q_pipeline_multi_baseline(spark, sf):
    return _longs(_portfolio_rounding(_run_multi(spark, sf).baseline, MULTI, ""))


def q_pipeline_multi_final(spark, sf):
    return _longs(_run_multi(spark, sf).final.select(*_FINAL, *[f"{i}_estimado" for i in MULTI], "copies"))


def _run_pandas(spark, sf):
    return run_pandas_rules(gappy_lead_grid(spark, sf), product_table(spark, sf), TEST_BANDS, exp=PANDAS_EXP)


def q_pipeline_pandas_rules(spark, sf):
    """Two-valued rules on the grid with missing values: per-key max and sum of
    the score whose probability term alone is filled."""
    return _round(_run_pandas(spark, sf).key_stats, SCORE_DIGITS, ["m_obj_funct_p_1", "s_obj_funct_p_1"])


def q_pipeline_pandas_capped(spark, sf):
    return _longs(_run_pandas(spark, sf).capped.select("llave", "iter", "tasa_propuesta", "flg_subsegmento_consumo"))


def q_pipeline_pandas_baseline(spark, sf):
    return _longs(_portfolio_rounding(_run_pandas(spark, sf).baseline, SINGLE, ""))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def q_csv_floor_table(spark, sf):
    """The floor table exported as CSV among other columns in another order, read
    back by header name with types."""
    path = _folder(spark, "csv")
    f = floor_table(spark, sf)
    export_csv(f.select(F.lit("x").alias("campana"), F.col("tasapropuestamin").alias("TasaPropuestaMin"),
                        F.length("llave").alias("n"), F.col("llave").alias("LLAVE")), path)
    return read_csv_table(spark, path, FLOOR_SCHEMA)


def q_partitioned_output(spark, sf):
    """Two campaigns written one after the other to the same partitioned table,
    the second again with other rows; read back: each campaign's last rows."""
    path = _folder(spark, "out")
    g = lead_rows(grid_single(spark, sf)).select("codmes", "llave", "tasa_propuesta")
    for name, rows in (("A", g), ("B", g), ("B", g.where(F.col("tasa_propuesta") > 0.3))):
        write_stage(rows.withColumn("campana", F.lit(name)), path, ["campana"])
    return _longs(spark.read.parquet(path).select("codmes", "llave", "tasa_propuesta", "campana"))


def q_pipeline_outputs(spark, sf):
    """Every table of the multi-indicator pipeline (all its exponents) written by
    month and campaign for two runs; two values of every row read back."""
    path = _folder(spark, "runs")
    for month in (202401, 202402):
        g = dense_grid(spark, sf).drop("codmes").withColumn("codmes", F.lit(month))
        r = run_multi(g, floor_table(spark, sf), run={"codmes": month, "campana": "A"})
        write_outputs(r, path, ["codmes", "campana"])

    return _output_values(lambda name: spark.read.parquet(f"{path}/{name}"))


def _output_values(read: Callable[[str], DataFrame]) -> DataFrame:
    """Two values of every row of the multi-indicator result tables."""
    def rows(name: str, shape, item, a: str, b: str) -> DataFrame:
        t = shape(read(name))
        return t.select(F.lit(name).alias("name"), "codmes", "campana", item.alias("item"), F.col(a).alias("a"), F.col(b).alias("b"))

    out = rows("baseline", lambda t: _portfolio_rounding(t, MULTI, ""), F.lit(""), "roa_saldo_estimado", "tasa_pnd")
    out = out.unionByName(rows("tradeoff", lambda t: _tradeoff_rounding(t, MULTI), F.col("exp").cast("string"),
                               "roa_saldo_estimado_e", "tasa_pnd_e"))
    out = out.unionByName(rows("final", lambda t: t, F.concat_ws(":", "llave", F.col("iter").cast("string")),
                               "mtofinalofertadosol", "tasa_propuesta"))
    return _longs(out)


def q_published_runs(spark, sf):
    """Two months published, the second first without rows and then whole; a later run of
    the first month stops after one table: the published values."""
    path = _folder(spark, "published")

    def read(name: str) -> DataFrame:
        return read_published(spark, path, name)

    for month in (202401, 202402):
        run = {"codmes": month, "campana": "A"}
        if month == 202402:
            none = {n: read(n).where(F.lit(False)).withColumn("codmes", F.lit(month)) for n in ("baseline", "tradeoff", "final")}
            publish_run(none, path, run)
        g = dense_grid(spark, sf).drop("codmes").withColumn("codmes", F.lit(month))
        publish_outputs(run_multi(g, floor_table(spark, sf), run=run), path, run)
    lead_rows(dense_grid(spark, sf)).write.parquet(f"{path}/run-{uuid.uuid4().hex}/baseline")
    return _output_values(read)


def _monthly(spark, sf):
    """Orders with month, amount and subsegment (the source of the rule tables)."""
    p = product_table(spark, sf).select("llave", "flg_subsegmento_consumo")
    o = lead_rows(dense_grid(spark, sf)).select("codmes", "llave", "mtofinalofertadosol")
    return o.join(p, "llave").withColumn("_k", F.col("llave").cast("long"))


def monthly_bands(spark, sf):
    """A band per month and subsegment; one without lower and one without upper bound in a few,
    MACHINERY unlisted."""
    k = _monthly(spark, sf).where("flg_subsegmento_consumo <> 'MACHINERY'").groupBy(
        "codmes", "flg_subsegmento_consumo").agg(F.min("_k").alias("a"), F.max("_k").alias("b"))
    return k.select("codmes", "flg_subsegmento_consumo",
                    F.when(F.col("a") % 9 != 0, F.lit(0.12) + F.col("a") % 8 / F.lit(100)).alias("lo"),
                    F.when(F.col("b") % 9 != 0, F.lit(0.25) + F.col("b") % 30 / F.lit(100)).alias("hi"))


def monthly_buckets(spark, sf):
    """Three buckets per month between its least and greatest amount, the last one open."""
    m = F.col("mtofinalofertadosol")
    e = _monthly(spark, sf).groupBy("codmes").agg(F.min(m).alias("a"), F.max(m).alias("b"))
    none, width = F.lit(None).cast("double"), F.col("b") - F.col("a")
    edges = [none, F.col("a") + width * F.lit(0.125), F.col("a") + width * F.lit(0.5)]
    return e.select("codmes", F.inline(F.array(*[
        F.struct(edges[i].alias("lo"), edges[i + 1].alias("hi"), F.lit(n).alias("rng_mto_v2"))
        for i, n in enumerate(("1.low", "2.middle"))])))


def _rate_band_rules(spark, sf, mode):
    g = enrich(gappy_grid(spark, sf), product_table(spark, sf), hot=dense_hot(spark, sf))
    out = rate_band_table(g, monthly_bands(spark, sf), mode, per=("codmes",))
    return _longs(out.select("llave", "iter", "tasa_propuesta", "flg_subsegmento_consumo"))


def q_rate_band_rules_drop(spark, sf):
    """Rate bands per month and subsegment from a rule table, three-valued."""
    return _rate_band_rules(spark, sf, "drop")


def q_rate_band_rules_keep(spark, sf):
    """Rate bands per month and subsegment from a rule table, two-valued."""
    return _rate_band_rules(spark, sf, "keep")


def q_bucket_report_rules(spark, sf):
    """Lead rows per month and bucket of a bucket table that changes per month."""
    out = bucket_report_table(lead_rows(grid_single(spark, sf)), monthly_buckets(spark, sf), SINGLE, per=("codmes",),
                              open_label="3.open")
    for c, digits in LEAD_DIGITS.items():
        out = _round(out, digits, [c])
    return _longs(_round(out, RATIO_DIGITS, ["prob", "tasa_cli", "tasa_pnd"]))


def q_sort_scenarios(spark, sf):
    """Total order by key and step, with each row's place in it."""
    return _longs(sort_scenarios(numbered(grid_single(spark, sf).select("llave", "iter"))))


PROFILE_RSD = 0.01


def q_column_profile_approximate(spark, sf):
    """Sketched profile of all columns: exact counts, and whether each distinct
    count is within five relative deviations of the exact one."""
    g = stage(gappy_grid(spark, sf), "profile")
    exact = profile(g, g.columns).select(F.col("column").alias("_c"), F.col("distinct").alias("_d"))
    out = profile(g, rsd=PROFILE_RSD).join(exact, F.col("column") == F.col("_c"))
    return _longs(out.select("column", "type", "non_null", "rows", (
        F.abs(F.col("distinct") - F.col("_d")) <= F.lit(5 * PROFILE_RSD) * F.col("_d")).alias("close")))


def q_key_sample(spark, sf):
    return _longs(key_sample(grid_single(spark, sf), SAMPLE_KEYS).select("llave", "iter", "tasa_propuesta"))


def q_preview(spark, sf):
    return _longs(preview(grid_single(spark, sf), PREVIEW_ROWS).select("llave", "iter", "tasa_propuesta"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "expected_values": q_expected_values,
    "expected_values_multi": q_expected_values_multi,
    "iteration_caps": q_iteration_caps,
    "rate_band_drop": q_rate_band_drop,
    "rate_band_keep": q_rate_band_keep,
    "rate_floor": q_rate_floor,
    "score_filter": q_score_filter,
    "scenario_slice": q_scenario_slice,
    "conform_types": q_conform_types,
    "lead_summary": q_lead_summary,
    "lead_summary_ceiling": q_lead_summary_ceiling,
    "weighted_mean": q_weighted_mean,
    "nansum_variants": q_nansum_variants,
    "column_profile": q_column_profile,
    "column_profile_merged": q_column_profile_merged,
    "objective_values": q_objective_values,
    "objective_fill_variants": q_objective_fill_variants,
    "key_stats": q_key_stats,
    "key_stats_multi": q_key_stats_multi,
    "best_rate_min": q_best_rate_min,
    "best_rate_sum": q_best_rate_sum,
    "best_rate_multi": q_best_rate_multi,
    "best_rate_natural_min": q_best_rate_natural_min,
    "best_rate_natural_sum": q_best_rate_natural_sum,
    "sr_rate_min": q_sr_rate_min,
    "sr_rate_sum": q_sr_rate_sum,
    "lead_pivots": q_lead_pivots,
    "chosen_rows_unique": q_chosen_rows_unique,
    "chosen_rows_natural_min": q_chosen_rows_natural_min,
    "chosen_rows_natural_sum": q_chosen_rows_natural_sum,
    "final_selection_single": q_final_selection_single,
    "final_selection_multi": q_final_selection_multi,
    "scenario_summary": q_scenario_summary,
    "scenario_summary_natural": q_scenario_summary_natural,
    "compare_one": q_compare_one,
    "tradeoff_single": q_tradeoff_single,
    "tradeoff_multi": q_tradeoff_multi,
    "tradeoff_natural": q_tradeoff_natural,
    "best_rate_hot_key": q_best_rate_hot_key,
    "tradeoff_hot_key": q_tradeoff_hot_key,
    "chosen_rows_hot_key": q_chosen_rows_hot_key,
    "bucket_report_base": q_bucket_report_base,
    "bucket_report_final": q_bucket_report_final,
    "rate_change": q_rate_change,
    "rate_change_histogram": q_rate_change_histogram,
    "rate_change_hot_key": q_rate_change_hot_key,
    "nearest_rate_hot_key": q_nearest_rate_hot_key,
    "rate_floor_hot_key": q_rate_floor_hot_key,
    "enrich_hot_key": q_enrich_hot_key,
    "top_offer": q_top_offer,
    "nearest_rate": q_nearest_rate,
    "top_offer_lot": q_top_offer_lot,
    "indicator_max": q_indicator_max,
    "lead_summary_pandas": q_lead_summary_pandas,
    "pipeline_single": q_pipeline_single,
    "pipeline_single_baseline": q_pipeline_single_baseline,
    "pipeline_single_capped": q_pipeline_single_capped,
    "pipeline_single_final": q_pipeline_single_final,
    "pipeline_single_bucket_base": q_pipeline_single_bucket_base,
    "pipeline_single_bucket_final": q_pipeline_single_bucket_final,
    "pipeline_single_rate_change": q_pipeline_single_rate_change,
    "pipeline_single_histogram": q_pipeline_single_histogram,
    "pipeline_multi": q_pipeline_multi,
    "pipeline_multi_baseline": q_pipeline_multi_baseline,
    "pipeline_multi_final": q_pipeline_multi_final,
    "pipeline_pandas_rules": q_pipeline_pandas_rules,
    "pipeline_pandas_capped": q_pipeline_pandas_capped,
    "pipeline_pandas_baseline": q_pipeline_pandas_baseline,
    "pipeline_outputs": q_pipeline_outputs,
    "published_runs": q_published_runs,
    "rate_band_rules_drop": q_rate_band_rules_drop,
    "rate_band_rules_keep": q_rate_band_rules_keep,
    "bucket_report_rules": q_bucket_report_rules,
    "csv_floor_table": q_csv_floor_table,
    "partitioned_output": q_partitioned_output,
    "sort_scenarios": q_sort_scenarios,
    "column_profile_approximate": q_column_profile_approximate,
    "key_sample": q_key_sample,
    "preview": q_preview,
}
