"""Business rules kept as tables: rate bands and buckets that change per month.

``rate_band`` and ``bucket_label`` write their rules into the plan, one comparison
per rule, which suits a handful.  Here the rules are rows, so there may be many
thousands, chosen by equal values of ``per`` (for example the month).

*Bands.*  A rate is outside some band of its subsegment if it is below the greatest
lower or above the least upper bound, so the bands fold to one row per
subsegment and the grid meets them in an equi-join.

*Intervals.*  ``interval_join`` bins both sides at several scales: an interval no
longer than ``2^k`` covers at most two or three cells of width ``2^k``, and a row looks
up its cell at each scale that some interval has.  The join is an equi-join on
the cell, with the interval itself tested after it; no nested loop, whatever the
lengths.

Rule tables are counted: up to ``BROADCAST_RULES`` rows they are broadcast, above the
rows meet them in :func:`rategrid.operators.skew.key_join`, hot cells salted.  Eager
(the count, and the scales of the intervals).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rategrid.operators.skew import ROWS_PER_TASK, key_join
from rategrid.operators.summary import portfolio_aggs
from rategrid.schema import COLS
from rategrid.sources.io import stage

BROADCAST_RULES = 1_000_000


def _key(cols: Sequence[Column]) -> Column:
    """Text that is equal for equal values, null if one is null."""
    parts = [c.cast("string") for c in cols]
    known = F.lit(True)
    for p in parts:
        known = known & p.isNotNull()
    coded = [x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p)]
    return F.when(known, F.concat(*coded) if coded else F.lit(""))


def _meet(rows: DataFrame, rules: DataFrame, how: str, broadcast_rules: int, rows_per_task: int) -> DataFrame:
    """``rows`` and ``rules`` joined on ``_rule`` (``rules`` staged)."""
    if rules.count() <= broadcast_rules:
        return rows.join(F.broadcast(rules), "_rule", how)
    return key_join(rows, rules, key="_rule", how=how, rows_per_task=rows_per_task)


def fold_bands(bands: DataFrame, per: Sequence[str] = (), subsegment: str = COLS.subsegment) -> DataFrame:
    """``_rule, _lo, _hi``: the greatest lower and least upper bound of each subsegment
    (and ``per``).  Bounds that are null do not bound."""
    return (bands.groupBy(_key([F.col(c) for c in (*per, subsegment)]).alias("_rule"))
            .agg(F.max("lo").alias("_lo"), F.min("hi").alias("_hi")).where(F.col("_rule").isNotNull()))


def rate_band_table(grid: DataFrame, bands: DataFrame, unmatched: str = "drop", per: Sequence[str] = (),
                    rate: str = COLS.rate, subsegment: str = COLS.subsegment,
                    broadcast_rules: int = BROADCAST_RULES, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Remove scenarios whose rate lies outside a band of their subsegment; ``bands`` has
    the columns ``per``, ``subsegment``, ``lo`` and ``hi`` (one row or several per subsegment).

    Same rules as :func:`rategrid.operators.limits.rate_band` over the bands with the
    row's values of ``per``.  ``"drop"``: a row without subsegment goes if its rate is
    null or outside any band of its ``per``, a null rate goes where its
    subsegment is listed with a bound, and a band without subsegment takes rows
    of every subsegment out.  ``"keep"``: unknown comparisons are false.  A row whose
    ``per`` is null or has no bands is kept; an empty table keeps all rows."""
    if unmatched not in ("drop", "keep"):
        raise ValueError(f"unmatched must be 'drop' or 'keep', got {unmatched!r}")
    cols = grid.columns
    r = F.col(rate)

    def violated(lo: str, hi: str) -> Column:
        """Outside the folded bounds, null where the rate is null and a bound exists."""
        return ((F.col(lo).isNotNull() & (r < F.col(lo))) | (F.col(hi).isNotNull() & (r > F.col(hi))))

    own = stage(fold_bands(bands, per, subsegment), "bands")
    rows = _meet(grid.withColumn("_rule", _key([F.col(c) for c in (*per, subsegment)])), own, "left",
                 broadcast_rules, rows_per_task)
    outside = violated("_lo", "_hi")
    if unmatched == "keep":
        return rows.where(~F.coalesce(outside, F.lit(False))).select(*cols)
    # what no subsegment decides: bands of null subsegments for every row, all bands for rows without one
    blank = F.col(subsegment).isNull()
    sets = stage(bands.groupBy(_key([F.col(c) for c in per]).alias("_rule")).agg(
        F.max("lo").alias("_all_lo"), F.min("hi").alias("_all_hi"),
        F.max(F.when(blank, F.col("lo"))).alias("_blank_lo"), F.min(F.when(blank, F.col("hi"))).alias("_blank_hi"),
    ).where(F.col("_rule").isNotNull()), "band-sets")
    rows = _meet(rows.drop("_rule").withColumn("_rule", _key([F.col(c) for c in per])), sets, "left",
                 broadcast_rules, rows_per_task)
    unknown = F.when(F.col(subsegment).isNull(), violated("_all_lo", "_all_hi")).otherwise(
        violated("_blank_lo", "_blank_hi"))
    # an unknown comparison removes the row, as a false one does
    return rows.where(F.coalesce(~(outside | unknown), F.lit(False))).select(*cols)


def _scales(rules: DataFrame) -> DataFrame:
    """``rules`` with ``_level``: the least k with length <= 2^k (null: unbounded)."""
    length = F.col("_hi") - F.col("_lo")
    bounded = F.col("_lo").isNotNull() & F.col("_hi").isNotNull() & (length <= F.lit(2.0 ** 1023))
    return rules.withColumn("_level", F.when(bounded, F.greatest(
        F.ceil(F.log2(length)), F.lit(-1022)).cast("int")))


def _cell(x: Column, level: Column) -> Column:
    # beyond the range of long all cells are its end, on both sides alike
    return F.floor(x / F.pow(F.lit(2.0), level)).cast("long")


def interval_join(rows: DataFrame, rules: DataFrame, value: str, per: Sequence[str] = (), lo: str = "lo",
                  hi: str = "hi", how: str = "inner", broadcast_rules: int = BROADCAST_RULES,
                  rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``rows`` with the other columns of each rule of the same ``per`` whose half-open
    interval ``[lo, hi)`` holds ``value``: one row per match, however the intervals
    overlap (``how="left"``: rows without a match once, with nulls).

    A null bound is open.  Null and NaN values, null ``per`` and intervals that are
    empty or have a NaN bound match nothing.  Columns of ``rules`` other than ``per``,
    ``lo`` and ``hi`` must not be named like columns of ``rows``."""
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, got {how!r}")
    extra = [c for c in rules.columns if c not in (*per, lo, hi)]
    clash = [c for c in extra if c in rows.columns]
    if clash:
        raise ValueError(f"rule columns named like row columns: {', '.join(clash)}")
    low, high = F.col(lo).cast("double"), F.col(hi).cast("double")
    good = (F.coalesce(~F.isnan(low), F.lit(True)) & F.coalesce(~F.isnan(high), F.lit(True))
            & F.coalesce(low < high, F.lit(True)))
    held = _scales(rules.where(good).select(
        _key([F.col(c) for c in per]).alias("_per"), low.alias("_lo"), high.alias("_hi"),
        F.struct(*[F.col(c) for c in extra]).alias("_rule_row")).where(F.col("_per").isNotNull()))
    cells = F.when(F.col("_level").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.sequence(_cell(F.col("_lo"), F.col("_level")), _cell(F.col("_hi"), F.col("_level"))))
    place = _key([F.col("_per"), F.coalesce(F.col("_level"), F.lit(9999)), F.col("_cell")])
    held = stage(held.withColumn("_cell", F.explode(cells)).select(
        place.alias("_rule"), "_level", "_lo", "_hi", "_rule_row"), "intervals")
    # the exponents of doubles: at most about 2,100 scales, whatever the table
    levels = sorted((x["_level"] for x in held.select("_level").distinct().collect()), key=lambda x: (x is None, x))
    if not levels:
        none = [F.lit(None).cast(rules.schema[c].dataType).alias(c) for c in extra]
        return rows.select("*", *none) if how == "left" else rows.select("*", *none).limit(0)
    cols = rows.columns
    x = F.col(value).cast("double")
    at = F.array(*[F.struct(F.lit(k).cast("int").alias("_level"), (
        F.lit(0).cast("long") if k is None else F.floor(x / F.lit(2.0 ** k)).cast("long")).alias("_cell")) for k in levels])
    usable = x.isNotNull() & ~F.isnan(x)
    seek = rows.select(F.struct(*[F.col(c) for c in cols]).alias("_row"), _key([F.col(c) for c in per]).alias("_per"),
                       F.when(usable, x).alias("_x"), F.monotonically_increasing_id().alias("_at") if how == "left"
                       else F.lit(None).cast("long").alias("_at"), F.when(usable, at).alias("_cells"))
    if how == "left":
        seek = stage(seek, "interval-rows")
    probes = (seek.select(*([] if how == "left" else ["_row"]), "_at", "_per", "_x", F.explode("_cells").alias("_c"))
              .withColumn("_cell", F.col("_c._cell")).withColumn("_level", F.col("_c._level"))
              .withColumn("_rule", place).drop("_c", "_cell", "_level", "_per").where(F.col("_rule").isNotNull()))
    hit = _meet(probes, held.select("_rule", "_lo", "_hi", "_rule_row"), "inner", broadcast_rules, rows_per_task).where(
        (F.col("_lo").isNull() | (F.col("_x") >= F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_x") < F.col("_hi"))))
    if how == "left":
        hit = seek.select("_at", "_row").join(hit.select("_at", "_rule_row"), "_at", "left")
    return hit.select("_row.*", *[F.col("_rule_row")[c].alias(c) for c in extra])


def bucket_label_table(rows: DataFrame, buckets: DataFrame, per: Sequence[str] = (), amount: str = COLS.amount,
                       label: str = "rng_mto_v2", open_label: str = "open", **limits) -> DataFrame:
    """``rows`` with the ``label`` of the bucket ``[lo, hi)`` of their ``per`` that holds the amount;
    ``open_label`` for amounts in none (null and NaN among them).  The buckets of a
    ``per`` must not overlap, or a row comes once per bucket."""
    named = buckets.select(*per, "lo", "hi", F.col(label).alias("_label"))
    out = interval_join(rows, named, amount, per, how="left", **limits)
    return out.withColumn(label, F.coalesce("_label", F.lit(open_label))).drop("_label")


def bucket_report_table(rows: DataFrame, buckets: DataFrame, indicators: Sequence[str], per: Sequence[str] = (),
                        suffix: str = "", weight: str | None = None, amount: str = COLS.amount,
                        label: str = "rng_mto_v2", open_label: str = "open", **limits) -> DataFrame:
    """Portfolio aggregates per ``per`` and bucket of a bucket table."""
    need = list(dict.fromkeys([*per, COLS.rate, amount, COLS.prob, COLS.expected_amount,
                               *[f"{i}_estimado" for i in indicators], *([weight] if weight else [])]))
    labelled = bucket_label_table(rows.select(*need), buckets, per, amount, label, open_label, **limits)
    return labelled.groupBy(*per, label).agg(*portfolio_aggs(indicators, suffix, True, weight, order="report"))
