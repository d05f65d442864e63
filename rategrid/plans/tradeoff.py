"""Trade-off sweep and final selection (the composite operators)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rategrid.functions.columns import ratio
from rategrid.operators.selection import chosen_rows, rate_groups, sweep_picks, unpivot_picks
from rategrid.operators.skew import ROWS_PER_TASK, HotKeys, Keyed, keyed_stage
from rategrid.operators.summary import compare, portfolio
from rategrid.rules import SWEEP_EXPONENTS
from rategrid.schema import COLS


def scenario_summary(chosen: DataFrame, indicators: Sequence[str], weighted: bool = True) -> DataFrame:
    """One-row summary of chosen rows with ``_e`` names.  ``weighted`` counts
    each row ``copies`` times (the original job's fan-out)."""
    return portfolio(chosen, indicators, suffix="_e", with_counts=False, weight="copies" if weighted else None)


def sweep_summaries(
    grid: DataFrame | Keyed,
    target: str,
    indicators: Sequence[str],
    exps: Sequence[float] = SWEEP_EXPONENTS,
    tie: str = "min",
    key: str = COLS.key,
    distinct_on: Sequence[str] | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Per exponent, the summary of the chosen portfolio (``exp`` + ``_e`` columns).

    Eager: the columns the sweep reads are staged by key (unless ``grid`` is such a
    stage), the one full exchange of the rows; ``hot`` are the hot keys of the grid,
    if known.  Picks (:func:`rategrid.operators.selection.sweep_picks`) are reduced
    to distinct (key, rate) with the list of their exponents; only rows at such
    a rate are aggregated, and the exponents are expanded last, so the final
    ``groupBy(exp)`` has at most ``len(exps)`` groups.  Each recovered row counts
    ``copies`` times.  Repeated exponents are an error.
    """
    exps = tuple(float(e) for e in exps)
    if len(set(exps)) != len(exps):
        raise ValueError(f"exponents repeat: {exps}")
    on = list(distinct_on) if distinct_on is not None else [COLS.client, COLS.step]
    cols = dict.fromkeys([key, COLS.step, COLS.rate, COLS.amount, COLS.prob, target, *on, COLS.expected_amount,
                          *[f"{i}_estimado" for i in indicators]])
    keyed = grid if isinstance(grid, Keyed) else keyed_stage(grid.select(*cols), key, "sweep-rows", hot, rows_per_task)
    picks = sweep_picks(keyed, target, exps, tie)
    wanted = unpivot_picks(picks, exps, key).groupBy(key, F.col("tasa_of_1").alias("_pick")).agg(
        F.sort_array(F.collect_list("exp")).alias("_exps"))
    groups = rate_groups(keyed, indicators, wanted, key=key, distinct_on=on)
    hit = groups.withColumn("exp", F.explode("_exps"))
    w = F.col("copies")

    def wsum(c: str):
        return F.sum(F.col(c) * w)

    per_exp = hit.groupBy("exp").agg(
        ratio(wsum("s_prob"), wsum("n_prob")).alias("prob_e"),
        ratio(wsum("s_rate"), wsum("n_rate")).alias("tasa_cli_e"),
        ratio(wsum("s_rate_amount"), wsum("s_amount")).alias("tasa_pnd_e"),
        wsum("s_mto_estimado").alias("mto_estimado_e"),
        *[wsum(f"s_{i}_estimado").alias(f"{i}_estimado_e") for i in indicators],
    )
    exps_df = keyed.rows.sparkSession.createDataFrame([(e,) for e in exps], "exp double")
    out = ["prob_e", "tasa_cli_e", "tasa_pnd_e", "mto_estimado_e"] + [f"{i}_estimado_e" for i in indicators]
    # every exponent keeps a row, with null summaries when nothing was chosen;
    # both sides hold at most len(exps) rows
    return exps_df.join(F.broadcast(per_exp), on="exp", how="left").select(*out, "exp")


def tradeoff(
    grid: DataFrame | Keyed,
    baseline: DataFrame,
    target: str,
    indicators: Sequence[str],
    exps: Sequence[float] = SWEEP_EXPONENTS,
    tie: str = "min",
    rows_per_task: int = ROWS_PER_TASK,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Trade-off table: the lead ``baseline`` beside the chosen portfolio of
    each exponent, with absolute and relative differences (one row per
    exponent)."""
    summ = sweep_summaries(grid, target, indicators, exps, tie, rows_per_task=rows_per_task, hot=hot)
    return compare(summ, baseline, indicators)


def final_selection(
    grid: DataFrame | Keyed,
    target: str,
    exp: float,
    indicators: Sequence[str],
    tie: str = "sum",
    distinct_on: Sequence[str] | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Grid rows at the rate chosen for one exponent (plus ``copies``).

    With ``tie="sum"`` several best rates of a key are added, and the key
    keeps only rows at that sum (often none).

    Eager: the grid is staged by key (unless it is such a stage), the one full
    exchange of its rows; statistics, picks, copies and the recovery read that
    stage in place.  ``hot`` are the hot keys of the grid, if known."""
    keyed = grid if isinstance(grid, Keyed) else keyed_stage(grid, COLS.key, "grid", hot, rows_per_task)
    picks = sweep_picks(keyed, target, [exp], tie)
    return chosen_rows(keyed, picks, pick_col="t_0", distinct_on=distinct_on)
