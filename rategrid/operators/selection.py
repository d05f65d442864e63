"""Best-rate selection per offer key.

Rules (for one exponent ``e``, per key, ``o = fill0(target * prob**e)``,
``m = max(o)``, ``s = sum(o)``; every numeric column is filled with 0 first):

* the candidates are the rows whose score equals the maximum, plus the lead
  row (``iter == 0``) when ``s == 0``;
* step picks (``iter_*``) compare raw doubles, the other picks compare the
  scores as ``decimal(32,10)``;
* ``tie="min"`` takes the smallest candidate value of each output column
  independently, ``tie="sum"`` adds the candidates' values.

Plan shape: the rows are staged by key once
(:func:`rategrid.operators.skew.keyed_stage`); key statistics, picks, copies and the
recovery of the chosen rows then group and join them where they are, without a
further exchange.  Rows of a hot key are staged by (key, salt); their statistics
are partial aggregates combined over the salts, and no window is laid over them.

The sweep over many exponents first keeps the upper envelope of every key: the
logarithm of a score, ``log(value) + e * log(prob)``, is a line in the exponent, so
of the rows of a key only those whose line comes up to the highest one at some
exponent (within the tie tolerance) can be picked.  Scores are computed for
these rows and exponents only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rategrid.functions.columns import nan_to_zero
from rategrid.operators.skew import ROWS_PER_TASK, HotKeys, Keyed, keyed_stage
from rategrid.schema import COLS

OBJ = "obj_funct_p_1"


# A key whose best score at some exponent is below e^LOW keeps all its rows: scores that small can
# be equal as decimal(32,10) although their logarithms differ.  Above it, equal decimals differ by
# less than 1e-10 / e^LOW, so lines further apart than LINE_TOLERANCE cannot tie.
LOW = -6.0
HIGH = 700.0                     # above, a score may overflow to infinity
LINE_TOLERANCE = 2e-6


@dataclass(frozen=True)
class Scores:
    """Score columns of a scored grid: one per exponent."""

    exps: tuple[float, ...]
    names: tuple[str, ...]


def objective(grid: DataFrame, target: str, exp: float, prob: str = COLS.prob, name: str = OBJ) -> DataFrame:
    """``{name} = target * prob ** exp`` (no filling)."""
    return grid.withColumn(name, F.col(target) * F.pow(F.col(prob), F.lit(float(exp))))


def objective_pandas_fill(grid: DataFrame, target: str, exp: float, prob: str = COLS.prob, name: str = OBJ) -> DataFrame:
    """Variant that fills only ``prob ** exp`` with 0, so a null target stays null."""
    p = F.pow(F.col(prob), F.lit(float(exp)))
    return grid.withColumn(name, F.col(target) * F.coalesce(F.nanvl(p, F.lit(None).cast("double")), F.lit(0.0)))


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of the numeric columns (the ones ``fillna(0)`` touches)."""
    from pyspark.sql.types import NumericType

    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def fill_numeric(df: DataFrame) -> DataFrame:
    """Null and NaN become 0 in every numeric column; strings are untouched."""
    return df.fillna(0, subset=numeric_columns(df))


def score(
    grid: DataFrame,
    target: str,
    exps: Sequence[float],
    indicators: Sequence[str],
    key: str = COLS.key,
    step: str = COLS.step,
    rate: str = COLS.rate,
    amount: str = COLS.amount,
    prob: str = COLS.prob,
    extra: Sequence[str] = (),
) -> tuple[DataFrame, Scores]:
    """Project the columns the selection reads, add one score per exponent and
    fill numeric nulls/NaN with 0.

    ``grid`` must carry ``{ind}_estimado`` and ``mto_estimado``
    (see :func:`rategrid.operators.limits.expected`).
    """
    exps = tuple(float(e) for e in exps)
    names = tuple(f"obj_{i}" for i in range(len(exps)))
    cols = [key, step, rate, amount, prob, COLS.expected_amount]
    cols += [f"{i}_estimado" for i in indicators]
    cols += [c for c in extra if c not in cols]
    t, p = F.col(target), F.col(prob)
    scored = grid.select(
        *[F.col(c) for c in dict.fromkeys(cols)],
        *[(t * F.pow(p, F.lit(e))).alias(n) for e, n in zip(exps, names)],
    )
    return fill_numeric(scored), Scores(exps, names)


def key_stats(
    scored: DataFrame,
    indicators: Sequence[str],
    scores: Sequence[str] = (OBJ,),
    key: str = COLS.key,
) -> DataFrame:
    """Per key: ``m_``/``s_`` (max/sum) of each ``{ind}_estimado`` and score."""
    aggs = [F.max(f"{i}_estimado").alias(f"m_{i}_estimado") for i in indicators]
    aggs += [F.sum(f"{i}_estimado").alias(f"s_{i}_estimado") for i in indicators]
    aggs += [F.max(s).alias(f"m_{s}") for s in scores]
    aggs += [F.sum(s).alias(f"s_{s}") for s in scores]
    return scored.groupBy(key).agg(*aggs)


def best_rate(
    grid: DataFrame,
    target: str,
    exp: float,
    indicators: Sequence[str],
    tie: str = "min",
    key: str = COLS.key,
    step: str = COLS.step,
    rate: str = COLS.rate,
    amount: str = COLS.amount,
    prob: str = COLS.prob,
    rows_per_task: int = ROWS_PER_TASK,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Per key: lead values, the pick on the expected target (``_sr``) and the
    pick on the score (``_of_1``) for one exponent.

    ``target`` is the raw indicator scored (``van``); ``{target}_estimado``
    drives the ``_sr`` picks.  Eager: the columns read are staged by key once;
    statistics and picks need no further exchange.  Output columns: ``llave, oferta, prob_lead,
    iter_lead, iter_sr, iter_of_1, tasa_lead, tasa_sr, tasa_of_1, mto_lead,
    mto_sr, mto_of_1`` and ``{ind}_lead, {ind}_sr, {ind}_of_1`` per indicator.
    """
    if tie not in ("min", "sum"):
        raise ValueError(f"tie must be 'min' or 'sum', got {tie!r}")
    est = [f"{i}_estimado" for i in indicators]
    cols = list(dict.fromkeys([key, step, rate, amount, prob, target, COLS.expected_amount, *est]))
    keyed = keyed_stage(grid.select(*cols), key, "rows", hot, rows_per_task)
    narrow = keyed.rows
    # filled copies (``fillna(0)``) computed inline, as SQL text (one JVM call per expression)
    f = {c: _filled_sql(narrow, c) for c in cols if c != key}
    st = f[step]
    obj = f"coalesce(nanvl(`{target}` * pow(`{prob}`, CAST({float(exp)!r} AS DOUBLE)), 0D), 0D)"
    t_est = f[f"{target}_estimado"]
    stats = narrow.groupBy(key).agg(
        F.expr(f"max({t_est}) AS _m_sr"), F.expr(f"sum({t_est}) AS _s_sr"),
        F.expr(f"max({obj}) AS _m_of"), F.expr(f"sum({obj}) AS _s_of"),
    )
    joined = keyed.join(narrow, stats, how="left")
    rules = {"sr": (t_est, "_m_sr", "_s_sr"), "of": (obj, "_m_of", "_s_of")}

    def lead(c: str, name: str) -> Column:
        return F.expr(f"sum(CASE WHEN {st} = 0 THEN {f[c]} END) AS {name}")

    def pick(c: str, rule: str, name: str, decimal: bool = True) -> Column:
        score, best, total = rules[rule]
        if decimal:
            cand = _pick_sql(f[c], score, best, total, st)
        else:
            cand = f"CASE WHEN {total} = 0D AND {st} = 0 THEN {f[c]} WHEN {score} = {best} THEN {f[c]} END"
        return F.expr(f"{tie}({cand}) AS {name}")

    aggs = [
        lead(amount, "oferta"),
        lead(prob, "prob_lead"),
        lead(step, "iter_lead"),
        pick(step, "sr", "iter_sr", decimal=False),
        pick(step, "of", "iter_of_1", decimal=False),
        lead(rate, "tasa_lead"),
        pick(rate, "sr", "tasa_sr"),
        pick(rate, "of", "tasa_of_1"),
        lead(COLS.expected_amount, "mto_lead"),
        pick(COLS.expected_amount, "sr", "mto_sr"),
        pick(COLS.expected_amount, "of", "mto_of_1"),
    ]
    for i in indicators:
        aggs += [
            lead(f"{i}_estimado", f"{i}_lead"),
            pick(f"{i}_estimado", "sr", f"{i}_sr"),
            pick(f"{i}_estimado", "of", f"{i}_of_1"),
        ]
    return joined.groupBy(key).agg(*aggs)


def lead_pivots(
    grid: DataFrame,
    indicators: Sequence[str],
    key: str = COLS.key,
    step: str = COLS.step,
    rate: str = COLS.rate,
    amount: str = COLS.amount,
    prob: str = COLS.prob,
) -> DataFrame:
    """Per key, sums of the lead rows' values after filling numeric nulls with 0
    (null when the key has no lead row).  A single partial aggregation."""
    cols = [key, step, rate, amount, prob, COLS.expected_amount] + [f"{i}_estimado" for i in indicators]
    g = fill_numeric(grid.select(*dict.fromkeys(cols)))
    lead = F.col(step) == F.lit(0)
    out = [("oferta", amount), ("prob_lead", prob), ("iter_lead", step), ("tasa_lead", rate),
           ("mto_lead", COLS.expected_amount)] + [(f"{i}_lead", f"{i}_estimado") for i in indicators]
    return g.groupBy(key).agg(*[F.sum(F.when(lead, F.col(c))).alias(n) for n, c in out])


def filled(df: DataFrame, col: str) -> Column:
    """``col`` as ``fillna(0)`` leaves it: null (and NaN for floating types) -> 0."""
    dt = df.schema[col].dataType
    c = F.col(col)
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return F.coalesce(F.nanvl(c, F.lit(None).cast(dt)), F.lit(0).cast(dt))
    if isinstance(dt, T.NumericType):
        return F.coalesce(c, F.lit(0).cast(dt))
    return c


def _filled_sql(df: DataFrame, col: str) -> str:
    """SQL text of :func:`filled`."""
    dt = df.schema[col].dataType
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return f"coalesce(nanvl(`{col}`, CAST(NULL AS {dt.simpleString()})), CAST(0 AS {dt.simpleString()}))"
    if isinstance(dt, T.NumericType):
        return f"coalesce(`{col}`, CAST(0 AS {dt.simpleString()}))"
    return f"`{col}`"


def _pick_sql(value: str, score: str, best: str, total: str, step: str) -> str:
    """Candidate value: the lead row when the key's total score is 0, else
    rows whose score equals the maximum as decimal(32,10) (a cheap double
    test first; equal decimals differ by less than 1e-9)."""
    return (f"CASE WHEN {total} = 0D AND {step} = 0 THEN {value} "
            f"WHEN {score} >= {best} - 1.0E-9D AND try_cast({score} AS DECIMAL(32,10)) = "
            f"try_cast({best} AS DECIMAL(32,10)) THEN {value} END")


def upper_envelope(rows: DataFrame, by: Sequence[str], exps: Sequence[float], target: str, prob: str) -> DataFrame:
    """Rows of each group ``by`` that can have the group's best score at some exponent,
    with ``_near{i}``: whether at exponent ``i``.

    A group keeps all its rows, near everywhere, if a value or probability is
    negative, and at an exponent where no line is positive, or where the best
    line is so low or high that decimals or overflow decide ties.  Null and NaN
    scores are 0 and never best otherwise.  A window over ``by`` (groups of bounded
    size); no exchange where the rows are staged by ``by``."""
    exps = [float(e) for e in exps]
    tolerance = LINE_TOLERANCE * max(1.0, max(abs(e) for e in exps) / 100)
    odd = f"coalesce(`{target}` < 0, false) OR coalesce(`{prob}` < 0, false)" if min(exps) > 0 else "true"
    lines = rows.withColumns({
        "_a": F.expr(f"ln(CASE WHEN NOT isnan(`{prob}`) THEN `{prob}` END)"),
        "_b": F.expr(f"ln(CASE WHEN NOT isnan(`{target}`) THEN `{target}` END)"),
        "_odd": F.expr(odd),
    })
    w = Window.partitionBy(*by)
    best = lines.select("*", F.max("_odd").over(w).alias("_whole"),
                        *[F.max(F.expr(f"_b + {e!r}D * _a")).over(w).alias(f"_M{i}") for i, e in enumerate(exps)])
    # what a line must reach; everything does where the best line decides nothing (a missing one included)
    reach = [F.expr(f"CASE WHEN NOT _whole AND _M{i} >= {LOW!r}D AND _M{i} <= {HIGH!r}D THEN _M{i} - {tolerance!r}D "
                    f"ELSE -1.0E308D END AS _M{i}") for i in range(len(exps))]
    bounded = best.select(*rows.columns, "_a", "_b", *reach)
    near = {f"_near{i}": F.expr(f"coalesce(_b + {e!r}D * _a, -1.0E308D) >= _M{i}") for i, e in enumerate(exps)}
    return bounded.withColumns(near).where(" OR ".join(near)).select(*rows.columns, *near)


def sweep_picks(
    keyed: Keyed,
    target: str,
    exps: Sequence[float],
    tie: str = "min",
    step: str = COLS.step,
    rate: str = COLS.rate,
    prob: str = COLS.prob,
) -> DataFrame:
    """Chosen rate ``t_{i}`` per key and exponent of rows staged by key.

    Ordinary keys: the upper envelope's rows get their scores, and best score and
    sum are windows over the same sorted groups, so the whole step runs where the
    rows are staged.  Hot keys: best scores and sums are partial aggregates over
    the salts, joined back to the salted rows."""
    exps = tuple(float(e) for e in exps)
    if tie not in ("min", "sum"):
        raise ValueError(f"tie must be 'min' or 'sum', got {tie!r}")
    key, by = keyed.key, keyed.by
    rows = keyed.columns(step, rate, target, prob).where(F.col(key).isNotNull())
    n = range(len(exps))
    # The per-exponent expressions are written as SQL text: one JVM call
    # each instead of one per operator, which keeps planning time flat as the
    # number of exponents grows.
    st, rt = f"{_filled_sql(rows, step)} AS _st", f"{_filled_sql(rows, rate)} AS _rt"
    objs = [f"coalesce(nanvl(`{target}` * pow(`{prob}`, CAST({e!r} AS DOUBLE)), 0D), 0D)" for e in exps]
    picks = [F.expr(f"{tie}({_pick_sql('_rt', f'_o{i}', f'_m{i}', f'_s{i}', '_st')}) AS t_{i}") for i in n]

    ordinary = rows if keyed.hot.table is None else rows.where(F.col("_salt") == 0)
    scored = upper_envelope(ordinary, by, exps, target, prob).selectExpr(
        *[f"`{c}`" for c in by], st, rt, *[f"CASE WHEN _near{i} THEN {objs[i]} END AS _o{i}" for i in n])
    w = Window.partitionBy(*by)
    stats = [F.max(f"_o{i}").over(w).alias(f"_m{i}") for i in n] + [F.sum(f"_o{i}").over(w).alias(f"_s{i}") for i in n]
    out = scored.select("*", *stats).groupBy(*by).agg(*picks)
    if keyed.hot.table is None:
        return out
    scored = rows.where(F.col("_salt") > 0).selectExpr(*[f"`{c}`" for c in by], st, rt,
                                                       *[f"{o} AS _o{i}" for i, o in enumerate(objs)])
    stats = scored.groupBy(key).agg(*[F.max(f"_o{i}").alias(f"_m{i}") for i in n],
                                    *[F.sum(f"_o{i}").alias(f"_s{i}") for i in n])
    hot = keyed.join(scored, stats).groupBy(key).agg(*picks)
    return out.drop("_salt").unionByName(hot)


def pick_rates(
    grid: DataFrame,
    target: str,
    exps: Sequence[float],
    tie: str = "min",
    key: str = COLS.key,
    step: str = COLS.step,
    rate: str = COLS.rate,
    prob: str = COLS.prob,
) -> DataFrame:
    """Chosen rate per key for many exponents at once: ``(llave, exp, tasa_of_1)``
    (null picks dropped); see :func:`sweep_picks`.  Eager: the columns read are
    staged by key."""
    keyed = keyed_stage(grid.select(*dict.fromkeys([key, step, rate, target, prob])), key, "picks")
    return unpivot_picks(sweep_picks(keyed, target, exps, tie, step=step, rate=rate, prob=prob), exps, key)


def at_pick(rate: str) -> Column:
    """``rate = _pick``, written as two bounds so that the join stays one on the key,
    by which the rows are staged (as an equality it would become a second join key,
    and the rows would be exchanged again).  Null and NaN rates never match."""
    return (F.col(rate) <= F.col("_pick")) & (F.col(rate) >= F.col("_pick"))


def unpivot_picks(picks: DataFrame, exps: Sequence[float], key: str = COLS.key) -> DataFrame:
    """Wide picks (``t_{i}``) to rows ``(key, exp, tasa_of_1)``, null picks dropped."""
    pairs = F.array(*[F.struct(F.lit(float(e)).alias("exp"), F.col(f"t_{i}").alias("tasa_of_1"))
                      for i, e in enumerate(exps)])
    return picks.select(key, F.inline(pairs)).where(F.col("tasa_of_1").isNotNull())


def chosen_rows(
    grid: DataFrame | Keyed,
    picks: DataFrame,
    key: str = COLS.key,
    rate: str = COLS.rate,
    client: str = COLS.client,
    step: str = COLS.step,
    pick_col: str = "tasa_of_1",
    distinct_on: Sequence[str] | None = None,
    hot: HotKeys | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Grid rows at the chosen rate of their key, each once, plus ``copies``.

    ``copies`` is the number of distinct ``distinct_on`` tuples (default
    ``(client, step)``) among the key's rows at that rate: the multiplicity with
    which the original job's distinct-then-join recovery repeats each row.
    Weighted summaries use it to reproduce that job's totals without
    materialising the repeated rows.  Comparison is raw double equality; null
    rates never match.

    ``copies`` comes from the narrow columns (key, rate and ``distinct_on``) joined
    with the picks; the result, one row per chosen key, then meets the full-width
    rows.  Eager unless ``grid`` is staged by key: both joins read the rows where
    they are staged."""
    on = list(distinct_on) if distinct_on is not None else [client, step]
    keyed = grid if isinstance(grid, Keyed) else keyed_stage(grid, key, "grid", hot, rows_per_task)
    key = keyed.key
    pick = picks.select(key, F.col(pick_col).alias("_pick")).where(F.col("_pick").isNotNull())
    hit = keyed.join(keyed.columns(rate, *on), pick).where(at_pick(rate))
    chosen = hit.groupBy(key, "_pick").agg(F.count_distinct(F.struct(*[F.col(c) for c in on])).alias("copies"))
    out = keyed.join(keyed.rows, chosen).where(at_pick(rate))
    return out.select(*[c for c in keyed.rows.columns if c != "_salt"], "copies")


def rate_groups(
    grid: DataFrame | Keyed,
    indicators: Sequence[str],
    wanted: DataFrame | None = None,
    key: str = COLS.key,
    rate: str = COLS.rate,
    amount: str = COLS.amount,
    prob: str = COLS.prob,
    client: str = COLS.client,
    step: str = COLS.step,
    distinct_on: Sequence[str] | None = None,
) -> DataFrame:
    """Per (key, rate): ``copies`` and the partial sums a portfolio summary needs.

    ``wanted`` (``key``, ``_pick``, further columns; needs a grid staged by key) keeps only the rows at a wanted
    rate of their key before anything is grouped, and its further columns are
    kept: the distinct count then sees the chosen rows, not the whole grid.

    ``copies`` counts the distinct ``distinct_on`` tuples (default
    ``(client, step)``) at the rate: the number of times the original job's
    distinct-then-join recovery repeats each row."""
    on = list(distinct_on) if distinct_on is not None else [client, step]
    cols = list(dict.fromkeys([key, rate, amount, prob, *on, COLS.expected_amount, *[f"{i}_estimado" for i in indicators]]))
    rows = grid.columns(*cols) if isinstance(grid, Keyed) else grid.select(*cols)
    rows = rows.where(F.col(key).isNotNull() & F.col(rate).isNotNull())
    extra: list[str] = []
    if wanted is not None:
        extra = [c for c in wanted.columns if c not in (key, "_pick")]
        rows = grid.join(rows, wanted).where(at_pick(rate)).drop("_pick")
    r, a = F.col(rate), F.col(amount)
    aggs = [
        F.count_distinct(F.struct(*[F.col(c) for c in on])).alias("copies"),
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(prob).alias("s_prob"),
        F.count(prob).alias("n_prob"),
        F.sum(r).alias("s_rate"),
        F.count(r).alias("n_rate"),
        F.sum(r * a).alias("s_rate_amount"),
        F.sum(a).alias("s_amount"),
        F.sum(COLS.expected_amount).alias("s_mto_estimado"),
    ] + [F.sum(nan_to_zero(f"{i}_estimado")).alias(f"s_{i}_estimado") for i in indicators]
    return rows.groupBy(key, rate, *extra).agg(*aggs)
