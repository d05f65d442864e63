"""End-to-end pipelines.

``run_single``: one indicator, iteration caps and rate bands.
``run_multi``: several indicators, risk-score filter and per-key rate floors.
``run_pandas_rules``: the single-indicator flow with two-valued band logic
and pandas-style filling.

Eager: the capped grid, the final chosen rows and the selection's statistics are
staged while a result is built (written to the shared checkpoint folder and read
back), so sweep, final selection and reports scan stored Parquet and a lost
executor repeats work after the last stage only.  ``result.stages`` names these
stages; :func:`write_outputs` deletes them once every table is written.

``run`` (for example ``{"codmes": 202401, "campana": "A"}``) adds literal columns to
every result table that lacks them, so all of them can be partitioned by run.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rategrid.functions.columns import nan_to_null
from rategrid.operators.factored import rate_change_histogram
from rategrid.operators.limits import (
    bands_need_flag,
    cap_iterations,
    enrich,
    expected,
    lead_rows,
    lead_rows_under_ceiling,
    rate_band,
    rate_floor,
    score_filter,
)
from rategrid.operators.selection import OBJ, objective_pandas_fill
from rategrid.operators.summary import (
    bucket_report,
    lead_summary_pandas,
    portfolio,
    rate_change,
)
from rategrid.operators.skew import hot_keys, keyed_stage
from rategrid.plans.tradeoff import final_selection, tradeoff
from rategrid.rules import DEFAULT_CAPS, MIN_RISK_SCORE, SWEEP_EXPONENTS, Band
from rategrid.schema import COLS
from rategrid.sources.io import drop_stages, stage, stage_scope, write_stage
from rategrid.sources.runs import publish_run


@dataclass
class SingleResult:
    grid: DataFrame          # expected values added, before limits
    capped: DataFrame        # caps + bands applied
    baseline: DataFrame      # one-row lead summary (all lead rows)
    tradeoff: DataFrame      # one row per exponent
    final: DataFrame         # chosen rows for the final exponent (+ copies)
    bucket_base: DataFrame   # lead rows under the ceiling, per amount bucket
    bucket_final: DataFrame  # chosen rows per amount bucket
    rate_change: DataFrame   # chosen rows with base rate and change
    histogram: DataFrame     # rate-change histogram
    stages: list[str] = field(default_factory=list)  # paths of the run's stages


@dataclass
class MultiResult:
    grid: DataFrame
    capped: DataFrame
    baseline: DataFrame
    tradeoff: DataFrame
    final: DataFrame
    stages: list[str] = field(default_factory=list)


@dataclass
class PandasRulesResult:
    capped: DataFrame        # caps, then bands with unknown comparisons as false
    baseline: DataFrame      # lead summary, null indicators counted as 0
    key_stats: DataFrame     # per-key max/sum of the score (score filled, target not)
    stages: list[str] = field(default_factory=list)


def _with_run(result, run: Mapping | None):
    """Every table of a result with the run's literal columns it lacks."""
    for f in fields(result):
        df = getattr(result, f.name)
        if isinstance(df, DataFrame) and run:
            setattr(result, f.name, df.withColumns({k: F.lit(v) for k, v in run.items() if k not in df.columns}))
    return result


def run_single(
    grid: DataFrame,
    product: DataFrame,
    bands: Sequence[Band],
    indicator: str = "van",
    exps: Sequence[float] = SWEEP_EXPONENTS,
    final_exp: float = 2.5,
    caps: Sequence[tuple[int, int]] = DEFAULT_CAPS,
    run: Mapping | None = None,
) -> SingleResult:
    """Caps, product attributes and bands, trade-off sweep, final selection and
    its reports.  Where the bands remove every row without a product row, the
    product join is an inner one."""
    inds = [indicator]
    how = "inner" if bands_need_flag(bands) else "left"
    g = expected(grid, inds)
    with stage_scope() as stages:
        hot = hot_keys(grid)
        capped = keyed_stage(rate_band(enrich(cap_iterations(g, caps), product, how=how, hot=hot), bands,
                                       unmatched="drop"), name="capped", hot=hot)
        baseline = portfolio(lead_rows(g), inds)
        final = stage(final_selection(capped, indicator, final_exp, inds, tie="sum"), "final")
        trade = tradeoff(capped, baseline, indicator, inds, exps, tie="min")
        change = rate_change(final, g, hot=hot)
        changes = rate_change_histogram(final, g)
    return _with_run(SingleResult(
        grid=g,
        capped=capped.rows.drop("_salt"),
        baseline=baseline,
        tradeoff=trade,
        final=final,
        bucket_base=bucket_report(lead_rows_under_ceiling(g), inds),
        bucket_final=bucket_report(final, inds, suffix="_e", weight="copies"),
        rate_change=change,
        histogram=changes,
        stages=stages,
    ), run)


def run_multi(
    grid: DataFrame,
    floors: DataFrame,
    indicators: Sequence[str] = ("roa", "avg_balance", "roa_saldo"),
    target: str = "roa_saldo",
    exps: Sequence[float] = SWEEP_EXPONENTS,
    final_exp: float = 2.0,
    min_score: int = MIN_RISK_SCORE,
    run: Mapping | None = None,
) -> MultiResult:
    """Score filter, rate floors, trade-off sweep and final selection."""
    inds = list(indicators)
    g = expected(score_filter(grid, min_score), inds)
    with stage_scope() as stages:
        hot = hot_keys(grid)
        # the floors are the hash table of the join: the grid's rows are sorted once, for the stage
        keyed = keyed_stage(rate_floor(score_filter(grid, min_score), floors.hint("shuffle_hash"), hot=hot),
                            name="capped-multi", hot=hot)
        # expected values are products of staged columns: made again on reading, they neither move nor fill the stage
        names = rate_floor(g, floors, hot=hot).columns
        keyed = replace(keyed, rows=expected(keyed.rows, inds).select(*dict.fromkeys([*names, *keyed.by])))
        capped = keyed.rows.drop("_salt")
        baseline = portfolio(lead_rows_under_ceiling(capped), inds)
        trade = tradeoff(keyed, baseline, target, inds, exps, tie="min")
        final = final_selection(keyed, target, final_exp, inds, tie="sum", distinct_on=(COLS.client,))
    return _with_run(MultiResult(grid=g, capped=capped, baseline=baseline, tradeoff=trade, final=final,
                                 stages=stages), run)


def run_pandas_rules(
    grid: DataFrame,
    product: DataFrame,
    bands: Sequence[Band],
    indicator: str = "van",
    exp: float = 0.5,
    caps: Sequence[tuple[int, int]] = DEFAULT_CAPS,
    run: Mapping | None = None,
) -> PandasRulesResult:
    """Caps and bands with unknown comparisons as false; means, maxima and sums
    skip null and NaN, and a sum of nothing is 0."""
    inds = [indicator]
    g = expected(grid, inds)
    enriched = enrich(cap_iterations(g, caps), product)
    score = nan_to_null(OBJ)
    stats = objective_pandas_fill(enriched, indicator, exp).groupBy(COLS.key).agg(
        F.max(score).alias(f"m_{OBJ}"), F.coalesce(F.sum(score), F.lit(0.0)).alias(f"s_{OBJ}"))
    return _with_run(PandasRulesResult(
        capped=rate_band(enriched, bands, unmatched="keep"),
        baseline=lead_summary_pandas(lead_rows(g), inds),
        key_stats=stats,
    ), run)


def write_outputs(result, out_dir: str, partition_by: Sequence[str] = (), keep_stages: bool = False) -> None:
    """Write every DataFrame of a pipeline result under ``out_dir/<name>``, then
    delete the run's stages.  A table that lacks a partition column is an error
    (pass ``run`` to the pipeline): nothing is written then."""
    tables = {f.name: getattr(result, f.name) for f in fields(result) if isinstance(getattr(result, f.name), DataFrame)}
    for name, df in tables.items():
        absent = [c for c in partition_by if c not in df.columns]
        if absent:
            raise ValueError(f"{name} lacks partition columns: {', '.join(absent)}")
    for name, df in tables.items():
        write_stage(df, f"{out_dir.rstrip('/')}/{name}", partition_by)
    if not keep_stages and tables:
        drop_stages(next(iter(tables.values())).sparkSession, result.stages)


def publish_outputs(result, out_dir: str, run: Mapping, keep_stages: bool = False) -> int:
    """Write every DataFrame of a pipeline result and publish them together as the state
    of ``run`` (see :mod:`rategrid.sources.runs`), then delete the run's stages."""
    tables = {f.name: getattr(result, f.name) for f in fields(result) if isinstance(getattr(result, f.name), DataFrame)}
    number = publish_run(tables, out_dir, run)
    if not keep_stages:
        drop_stages(next(iter(tables.values())).sparkSession, result.stages)
    return number


__all__ = ["run_single", "run_multi", "run_pandas_rules", "write_outputs", "publish_outputs"]
