"""Portfolio summaries, comparisons and reports (aggregations).

Global summaries are single-row aggregates; grouped reports group on a small
label set.  Both use partial aggregation, so no task ever holds a group's
rows.  Weighted variants take a ``copies`` column (see
:func:`rategrid.operators.selection.chosen_rows`) and count each row that many
times.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rategrid.functions.columns import bucket_label, nan_to_null, nan_to_zero, ratio
from rategrid.operators.skew import ROWS_PER_TASK, HotKeys, key_join
from rategrid.rules import AMOUNT_BUCKETS, HISTOGRAM_BINS
from rategrid.schema import COLS


def portfolio_aggs(
    indicators: Sequence[str],
    suffix: str = "",
    with_counts: bool = True,
    weight: str | None = None,
    rate: str = COLS.rate,
    amount: str = COLS.amount,
    prob: str = COLS.prob,
    order: str = "summary",
) -> list[Column]:
    """Aggregates of a portfolio: row count, total amount, mean probability,
    mean rate, amount-weighted rate, expected amount and NaN-safe indicator
    totals.  ``weight`` counts each row ``weight`` times.

    ``order="summary"`` puts ``prob`` third (lead summary), ``"report"`` last
    (bucket report)."""
    w = F.col(weight) if weight else None

    def wsum(x: Column) -> Column:
        return F.sum(x * w) if w is not None else F.sum(x)

    def wavg(x: Column) -> Column:
        if w is None:
            return F.avg(x)
        return ratio(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))

    r, a, p = F.col(rate), F.col(amount), F.col(prob)
    counts = []
    if with_counts:
        counts = [
            (F.sum(w) if w is not None else F.count(F.lit(1))).alias("clientes"),
            wsum(a).alias("oferta"),
        ]
    prob_agg = wavg(p).alias(f"prob{suffix}")
    body = [
        wavg(r).alias(f"tasa_cli{suffix}"),
        ratio(wsum(r * a), wsum(a)).alias(f"tasa_pnd{suffix}"),
        wsum(F.col(COLS.expected_amount)).alias(f"mto_estimado{suffix}"),
    ] + [wsum(nan_to_zero(f"{i}_estimado")).alias(f"{i}_estimado{suffix}") for i in indicators]
    if order == "summary":
        return counts + [prob_agg] + body
    return counts + body + [prob_agg]


def portfolio(
    rows: DataFrame,
    indicators: Sequence[str],
    suffix: str = "",
    with_counts: bool = True,
    weight: str | None = None,
) -> DataFrame:
    """One-row portfolio summary (see :func:`portfolio_aggs`)."""
    return rows.agg(*portfolio_aggs(indicators, suffix, with_counts, weight))


def lead_summary_pandas(rows: DataFrame, indicators: Sequence[str]) -> DataFrame:
    """Lead summary with the pandas rules: means skip null and NaN, sums count
    them as 0 and an all-null column sums to 0."""
    cols = [COLS.rate, COLS.amount, COLS.prob, COLS.expected_amount, *[f"{i}_estimado" for i in indicators]]
    clean = rows.withColumns({c: nan_to_null(c) for c in cols})
    one = clean.agg(*portfolio_aggs(indicators))
    zero = ["oferta", COLS.expected_amount, *[f"{i}_estimado" for i in indicators]]
    return one.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in zero})


def _metric_names(indicators: Sequence[str]) -> list[tuple[str, str, str]]:
    """(baseline column, scenario column, short name) of the compared metrics."""
    base = [("prob", "prob_e", "prob"), ("tasa_cli", "tasa_cli_e", "t_cli"),
            ("tasa_pnd", "tasa_pnd_e", "t_pnd"), ("mto_estimado", "mto_estimado_e", "mto_est")]
    return base + [(f"{i}_estimado", f"{i}_estimado_e", f"{i}_est") for i in indicators]


def compare(scenario: DataFrame, baseline: DataFrame, indicators: Sequence[str]) -> DataFrame:
    """Attach the one-row ``baseline`` to every scenario row and add absolute
    (``dif_*``) and relative (``pct_*``, null on a zero baseline) differences.

    ``baseline`` is a global aggregate, so exactly one row: it is broadcast to
    the scenario rows (a one-row nested-loop join, no shuffle).
    """
    attached = F.broadcast(baseline).crossJoin(scenario)
    metrics = _metric_names(indicators)
    dif = {f"dif_{s}": F.col(e) - F.col(b) for b, e, s in metrics}
    pct = {f"pct_{s}": ratio(F.col(e) - F.col(b), F.col(b)) for b, e, s in metrics}
    return attached.withColumns(dif).withColumns(pct)


def bucket_report(
    rows: DataFrame,
    indicators: Sequence[str],
    suffix: str = "",
    weight: str | None = None,
    amount: str = COLS.amount,
    buckets: Sequence[tuple[float | None, str]] = AMOUNT_BUCKETS,
    label: str = "rng_mto_v2",
) -> DataFrame:
    """Portfolio aggregates per amount bucket, ordered by bucket label."""
    labelled = rows.withColumn(label, bucket_label(amount, buckets))
    aggs = portfolio_aggs(indicators, suffix, True, weight, order="report")
    return labelled.groupBy(label).agg(*aggs).orderBy(label)


def lead_rates(grid: DataFrame, key: str = COLS.key, rate: str = COLS.rate, step: str = COLS.step) -> DataFrame:
    """Per key and distinct lead rate (``tasa_base``) the number of lead rows."""
    return grid.where(F.col(step) == F.lit(0)).groupBy(key, F.col(rate).alias("tasa_base")).agg(
        F.count(F.lit(1)).alias("_leads"))


def rate_change(final_rows: DataFrame, grid: DataFrame, key: str = COLS.key, rate: str = COLS.rate,
                step: str = COLS.step, weight: str = "copies", hot: HotKeys | None = None,
                rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Chosen rows with the key's lead rate (``tasa_base``) and the change
    ``dif_tasa``: one row per chosen row and distinct lead rate of its key, its
    ``weight`` times the number of lead rows at that rate.

    Lead rows are counted per distinct rate before the join, so a key with many
    chosen and many lead rows gives chosen rows x distinct lead rates, never all
    pairs; hot keys are spread over salts (eager unless ``hot`` gives them)."""
    leads = lead_rates(grid, key, rate, step)
    return (key_join(final_rows, leads, hot, key, rows_per_task=rows_per_task)
            .withColumn(weight, F.col(weight) * F.col("_leads")).drop("_leads")
            .withColumn("dif_tasa", F.col(rate) - F.col("tasa_base")))


def rate_change_groups(final_rows: DataFrame, grid: DataFrame, key: str = COLS.key, rate: str = COLS.rate,
                       step: str = COLS.step, weight: str = "copies", hot: HotKeys | None = None) -> DataFrame:
    """:func:`rate_change` reduced to distinct (key, rate, lead rate) with summed
    weights before the join: the input of exact histograms and totals."""
    chosen = final_rows.groupBy(key, rate).agg(F.sum(weight).alias(weight))
    return rate_change(chosen, grid, key, rate, step, weight, hot)


def histogram(rows: DataFrame, col: str, bins: int = HISTOGRAM_BINS, weight: str | None = None) -> DataFrame:
    """Equal-width histogram between the column's min and max.

    Returns ``bin`` (1..bins), ``lo``, ``hi`` and ``n`` for non-empty bins; the
    maximum falls in the last bin (closed on the right).  When min equals max
    every value is in bin 1.  Null and NaN values are ignored.  The range is a
    one-row global aggregate broadcast to the rows; the counts are a partial
    aggregation with at most ``bins`` groups.
    """
    rows = rows.withColumn(col, nan_to_null(col)).where(F.col(col).isNotNull())
    rng = rows.agg(F.min(col).alias("_mn"), F.max(col).alias("_mx"))
    x, mn, mx = F.col(col), F.col("_mn"), F.col("_mx")
    width = mx - mn
    raw = F.floor(F.lit(float(bins)) * (x - mn) / width).cast("long") + F.lit(1)
    b = F.when(width == F.lit(0.0), F.lit(1).cast("long")).otherwise(F.least(raw, F.lit(bins).cast("long")))
    counted = (
        rows.crossJoin(F.broadcast(rng))
        .select(b.alias("bin"), (F.col(weight) if weight else F.lit(1)).alias("_w"), "_mn", "_mx")
        .groupBy("bin", "_mn", "_mx")
        .agg(F.sum("_w").cast("long").alias("n"))
    )
    step = (mx - mn) / F.lit(float(bins))
    return counted.select(
        "bin",
        (mn + (F.col("bin") - F.lit(1)) * step).alias("lo"),
        (mn + F.col("bin") * step).alias("hi"),
        "n",
    )


def _as_cell(df: DataFrame, name: str) -> tuple[str, Column] | None:
    """``name`` as one of the three types a cell can hold, equal exactly for equal values;
    None for types that have no such form."""
    dt, c = df.schema[name].dataType, F.col(name)
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return "l", c.cast("long")
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return "d", c.cast("double")
    if isinstance(dt, T.DateType):
        return "l", F.unix_date(c).cast("long")
    if isinstance(dt, T.DecimalType) or dt == T.StringType():
        return "s", c.cast("string")
    return None


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: ``_rows``, and per column i the non-null (``_nn{i}``) and distinct non-null
    (``_nd{i}``) values, exact.

    A row becomes one narrow cell (column number and value) per column, whose values
    are counted map-side before they move.  Spark's own distinct counts would repeat
    the row with a slot for every column, mostly null; they are left for columns
    of types that a cell does not hold."""
    cells = [_as_cell(df, c) for c in cols]
    if not cells or None in cells:
        return df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(f"_nn{i}") for i, c in enumerate(cols)],
                      *[F.count_distinct(F.col(c)).alias(f"_nd{i}") for i, c in enumerate(cols)])
    types = {"l": "long", "d": "double", "s": "string"}
    at = F.array(*[F.struct(F.lit(i).alias("_c"), *[(v if k == kind else F.lit(None).cast(t)).alias(f"_{k}")
                                                    for k, t in types.items()]) for i, (kind, v) in enumerate(cells)])
    values = df.select(F.inline(at)).groupBy("_c", "_l", "_d", "_s").agg(F.count(F.lit(1)).alias("_n"))
    known = F.coalesce("_l", "_d", F.when(F.col("_s").isNotNull(), F.lit(0))).isNotNull()
    per = values.groupBy("_c").agg(F.sum("_n").alias("_rows"), F.sum(F.when(known, F.col("_n"))).alias("_nn"),
                                   F.count(F.when(known, F.lit(1))).alias("_nd"))

    def of(i: int, c: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("_c") == F.lit(i), F.col(c))), F.lit(0).cast("long"))

    return per.agg(of(0, "_rows").alias("_rows"), *[of(i, "_nn").alias(f"_nn{i}") for i in range(len(cols))],
                   *[of(i, "_nd").alias(f"_nd{i}") for i in range(len(cols))])


def profile(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool | None = None,
            rsd: float = 0.01) -> DataFrame:
    """Per column: type, non-null count and distinct non-null count.

    Named ``columns`` are counted exactly by default: one scan, whose rows are
    expanded to (column, value) and combined map-side before they move
    (:func:`value_counts`).  Without
    names all columns are sketched in one pass (HyperLogLog sketches, mergeable,
    bounded memory, relative error about ``rsd``; see :func:`profile_sketch`).  Output: ``column, type, non_null, distinct, rows``.
    """
    cols = list(columns) if columns is not None else df.columns
    if columns is None if approximate is None else approximate:
        lg = max(4, min(21, math.ceil(2 * math.log2(1.04 / rsd))))
        return read_profile(profile_sketch(df, cols, lg)).select("column", "type", "non_null", "distinct", "rows")
    one = value_counts(df, cols)
    entries = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("type"),
                 F.col(f"_nn{i}").alias("non_null"), F.col(f"_nd{i}").alias("distinct"))
        for i, c in enumerate(cols)
    ])
    return one.select(F.inline(entries), F.col("_rows").alias("rows"))


SKETCH_LG = 14                   # HyperLogLog sketches of 2^14 registers: relative error about 0.8 %


def profile_sketch(df: DataFrame, columns: Sequence[str] | None = None, lg: int = SKETCH_LG) -> DataFrame:
    """Mergeable profile, one row per column: ``column, type, rows, non_null, least,
    greatest, sketch`` (extremes as text, NaN the greatest number).  Kept per partition
    or month, it is merged by :func:`merge_profiles` instead of reading old rows again."""
    cols = list(columns) if columns is not None else df.columns
    aggs = []
    for i, c in enumerate(cols):
        # the sketch takes integers, text and binary: other values go in as text, -0.0 as 0.0
        dt = df.schema[c].dataType
        v = F.col(c)
        if not isinstance(dt, (T.IntegerType, T.LongType, T.StringType, T.BinaryType)):
            v = (v + F.lit(0).cast(dt) if isinstance(dt, (T.DoubleType, T.FloatType)) else v).cast("string")
        aggs += [F.count(F.col(c)).alias(f"_nn{i}"), F.min(c).cast("string").alias(f"_lo{i}"),
                 F.max(c).cast("string").alias(f"_hi{i}"), F.hll_sketch_agg(v, F.lit(lg)).alias(f"_sk{i}")]
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    entries = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("type"),
                 F.col("_rows").alias("rows"), F.col(f"_nn{i}").alias("non_null"), F.col(f"_lo{i}").alias("least"),
                 F.col(f"_hi{i}").alias("greatest"), F.col(f"_sk{i}").alias("sketch"))
        for i, c in enumerate(cols)])
    return one.select(F.inline(entries))


_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def merge_profiles(parts: DataFrame) -> DataFrame:
    """Rows of :func:`profile_sketch` of several parts (unioned) as one profile per
    column, itself mergeable.  Extremes of numbers are compared as numbers."""
    number = F.col("type").isin(*_NUMBERS) | F.col("type").startswith("decimal")

    def extreme(f, c: str) -> Column:
        exact = F.struct(F.when(number, F.col(c).try_cast("double")), F.when(number, F.col(c).try_cast("decimal(38,10)")),
                         F.col(c).alias("v"))
        return f(F.when(F.col(c).isNotNull(), exact)).getField("v").alias(c)

    return parts.groupBy("column", "type").agg(
        F.sum("rows").alias("rows"), F.sum("non_null").alias("non_null"), extreme(F.min, "least"),
        extreme(F.max, "greatest"), F.hll_union_agg("sketch").alias("sketch"))


def read_profile(sketches: DataFrame) -> DataFrame:
    """``column, type, rows, non_null, least, greatest, distinct`` (estimate) of a mergeable profile."""
    return sketches.select("column", "type", "rows", "non_null", "least", "greatest",
                           F.hll_sketch_estimate("sketch").alias("distinct"))
