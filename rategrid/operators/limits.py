"""Scenario weighting and business limits on the grid (row-wise operators).

None of these shuffle except the key-wise joins (``enrich``, ``rate_floor``),
which join on the offer key with hot keys spread over salts
(:mod:`rategrid.operators.skew`).
Predicates are plain column expressions, so they reach the Parquet scan when
the grid is read from files.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rategrid.operators.skew import ROWS_PER_TASK, HotKeys, key_join
from rategrid.rules import DEFAULT_CAPS, LEAD_RATE_CEILING, MIN_RISK_SCORE, Band
from rategrid.schema import COLS


def expected(
    grid: DataFrame,
    indicators: Sequence[str],
    prob: str = COLS.prob,
    amount: str = COLS.amount,
) -> DataFrame:
    """Probability-weighted indicators ``{ind}_estimado`` and ``mto_estimado``.

    Existing columns of the same name (any case) are replaced.
    """
    p = F.col(prob)
    new = {f"{ind}_estimado": F.col(ind) * p for ind in indicators}
    new[COLS.expected_amount] = F.col(amount) * p
    return grid.withColumns(new)


def cap_predicate(
    caps: Iterable[tuple[int, int]] = DEFAULT_CAPS,
    segment: str = COLS.segment,
    step: str = COLS.step,
) -> Column:
    """OR over segments of ``segment == k AND -cap <= step <= cap``."""
    s, it = F.col(segment), F.col(step)
    pred = None
    for seg, cap in caps:
        term = (s == F.lit(seg)) & (it >= F.lit(-cap)) & (it <= F.lit(cap))
        pred = term if pred is None else pred | term
    if pred is None:
        raise ValueError("no caps given")
    return pred


def cap_iterations(
    grid: DataFrame,
    caps: Iterable[tuple[int, int]] = DEFAULT_CAPS,
    segment: str = COLS.segment,
    step: str = COLS.step,
) -> DataFrame:
    """Keep steps within the cap of their segment; unknown or null segments are dropped."""
    return grid.where(cap_predicate(caps, segment, step))


def band_violation(
    bands: Sequence[Band],
    rate: str = COLS.rate,
    subsegment: str = COLS.subsegment,
) -> list[Column]:
    """Three-valued "outside the band" terms: OR of ``rate < lo AND flag = s`` and
    ``rate > hi AND flag = s`` over the band rows."""
    r, flag = F.col(rate), F.col(subsegment)
    terms: list[Column] = []
    for b in bands:
        if b.lo is not None:
            terms.append((r < F.lit(b.lo)) & (flag == F.lit(b.subsegment)))
        if b.hi is not None:
            terms.append((r > F.lit(b.hi)) & (flag == F.lit(b.subsegment)))
    return terms


def bands_need_flag(bands: Sequence[Band]) -> bool:
    """Whether every rate lies outside some band, so that under three-valued
    logic a row without a subsegment is removed whatever its rate (and the
    product join may be an inner one)."""
    lows = [b.lo for b in bands if b.lo is not None]
    highs = [b.hi for b in bands if b.hi is not None]
    return bool(lows) and bool(highs) and max(lows) > min(highs)


def rate_band(
    grid: DataFrame,
    bands: Sequence[Band],
    unmatched: str = "drop",
    rate: str = COLS.rate,
    subsegment: str = COLS.subsegment,
) -> DataFrame:
    """Remove scenarios whose rate lies outside the band of their subsegment.

    ``unmatched="drop"`` keeps SQL three-valued logic: a row whose subsegment
    is null (no product match) is removed if its rate lies outside any band (see
    :func:`bands_need_flag`) or is null, and so is a listed subsegment with a
    null rate; an unlisted non-null subsegment is kept.
    ``unmatched="keep"`` treats each unknown comparison as false (the pandas
    rule), so rows without a subsegment and rows with a null rate are kept.
    """
    terms = band_violation(bands, rate, subsegment)
    if not terms:
        raise ValueError("no bands given")
    if unmatched == "drop":
        outside = terms[0]
        for t in terms[1:]:
            outside = outside | t
        return grid.where(~outside)
    if unmatched == "keep":
        outside = F.coalesce(terms[0], F.lit(False))
        for t in terms[1:]:
            outside = outside | F.coalesce(t, F.lit(False))
        return grid.where(~outside)
    raise ValueError(f"unmatched must be 'drop' or 'keep', got {unmatched!r}")


def enrich(
    grid: DataFrame,
    product: DataFrame,
    columns: Sequence[str] = (COLS.subsegment,),
    key: str = COLS.key,
    dedupe: Sequence[str] | None = None,
    how: str = "left",
    rows_per_task: int = ROWS_PER_TASK,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Attach per-offer attributes (equi-join on the key, hot keys salted).

    Eager unless ``hot`` gives the grid's hot keys: they are found by a pass over
    its key column.  The product table grows with the number of offers, so it is not broadcast;
    duplicate keys fan out unless ``dedupe`` names the columns whose smallest
    values pick one row per key."""
    side = product.select(*dict.fromkeys([key, *columns, *(dedupe or ())]))
    if dedupe is not None:
        rest = [c for c in side.columns if c != key]
        order = F.struct(*[F.col(c) for c in dict.fromkeys([*dedupe, *rest])])
        side = side.groupBy(key).agg(F.min(order).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in columns])
    return key_join(grid, side, hot, key, how=how, rows_per_task=rows_per_task)


def rate_floor(
    grid: DataFrame,
    floors: DataFrame,
    key: str = COLS.key,
    rate: str = COLS.rate,
    floor: str = "tasapropuestamin",
    rows_per_task: int = ROWS_PER_TASK,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Keep scenarios whose rate is at least the key's floor; keys without a
    floor (or with a null floor or rate) are removed.  Duplicate floor rows
    fan out, as an equi-join does; hot keys are spread over salts (eager unless
    ``hot`` gives them)."""
    side = floors.select(key, F.col(floor).cast("double").alias(floor))
    return key_join(grid, side, hot, key, rows_per_task=rows_per_task).where(F.col(rate) >= F.col(floor))


def score_filter(grid: DataFrame, min_score: int = MIN_RISK_SCORE, score: str = COLS.score) -> DataFrame:
    """Keep scenarios with risk score at least ``min_score``."""
    return grid.where(F.col(score) >= F.lit(min_score))


def lead_rows(grid: DataFrame, step: str = COLS.step) -> DataFrame:
    """Rows of the lead scenario (``iter == 0``)."""
    return grid.where(F.col(step) == F.lit(0))


def lead_rows_under_ceiling(
    grid: DataFrame,
    ceiling: float = LEAD_RATE_CEILING,
    step: str = COLS.step,
    rate: str = COLS.rate,
) -> DataFrame:
    """Lead rows whose rate does not exceed the global ceiling."""
    return grid.where((F.col(step) == F.lit(0)) & (F.col(rate) <= F.lit(ceiling)))


def scenario(grid: DataFrame, step_value: int, step: str = COLS.step) -> DataFrame:
    """Rows of one rate step (for example ``-8``)."""
    return grid.where(F.col(step) == F.lit(step_value))
