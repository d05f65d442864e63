"""Histogram of rate changes without the product of chosen and lead rates.

A key with ``n`` chosen and ``m`` lead rates has ``n * m`` differences.  They are
never expanded: each side is kept as weighted rates, grouped into cells (a quarter
of a bin wide) of the key, and cells are paired.  As a bin is monotone in the
difference, the bins of a pair's smallest and largest difference tell whether all
its differences share one bin; then the product of the two weights counts there.
Only pairs that a bin edge runs through are split, each side into the quarter
cells that occur, level by level; the differences of a key span at most the whole
range, so it starts with a few hundred cells at most, and an edge runs through a
number of pairs linear in the cells.  Rates that stay together on the finest
level are paired one by one, so the counts are exact.

Cases: null keys and null, NaN or infinite rates take no part; no difference gives
no row; equal differences are all in bin 1.
"""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rategrid.functions.columns import nan_to_null
from rategrid.rules import HISTOGRAM_BINS
from rategrid.schema import COLS
from rategrid.sources.io import stage

CELLS_PER_BIN = 4
SPLIT = 4                        # a power of two: cells of one level nest exactly in those above
LEVELS = 24


def weighted_rates(rows: DataFrame, key: str, rate: str, weight: Column) -> DataFrame:
    """``key, _v, _w``: the distinct finite rates of a key with their weights."""
    v = nan_to_null(F.col(rate).cast("double"))
    return (rows.select(key, v.alias("_v"), weight.cast("long").alias("_w"))
            .where(F.col(key).isNotNull() & (F.abs("_v") < F.lit(math.inf)))
            .groupBy(key, "_v").agg(F.sum("_w").alias("_w")))


def change_range(chosen: DataFrame, leads: DataFrame, key: str) -> tuple[float, float] | None:
    """Least and greatest difference of any key, from the extremes of its sides."""
    a, b = (side.groupBy(key).agg(F.min("_v").alias(f"{p}_lo"), F.max("_v").alias(f"{p}_hi"))
            for side, p in ((chosen, "a"), (leads, "b")))
    r = a.join(b, key).agg(F.min(F.col("a_lo") - F.col("b_hi")).alias("mn"),
                           F.max(F.col("a_hi") - F.col("b_lo")).alias("mx")).first()
    return None if r["mn"] is None else (r["mn"], r["mx"])


def pair_levels(chosen: DataFrame, leads: DataFrame, mn: float, mx: float, bins: int, key: str) -> list[DataFrame]:
    """Per level the staged cell pairs ``key, a, b, lo, hi, n``: cells, bins of the
    least and greatest difference, and weight.  A pair is settled if ``lo = hi``."""
    width = mx - mn
    scale = min(bins * CELLS_PER_BIN / width, sys.float_info.max) if width else 0.0

    def bin_of(x: Column) -> Column:
        if not width:
            return F.lit(1).cast("long")
        return F.least(F.floor(F.lit(float(bins)) * (x - F.lit(mn)) / F.lit(width)).cast("long") + F.lit(1),
                       F.lit(bins).cast("long"))

    def cell(level: int) -> Column:
        return F.floor(F.col("_v") * F.lit(scale * SPLIT ** level))

    def cells(side: DataFrame, p: str, level: int) -> DataFrame:
        above = [cell(level - 1).alias(p)] if level else []
        own = F.col("_v") if level > LEVELS else cell(level)
        return (side.select(key, *above, own.alias(f"{p}_cell"), "_v", "_w")
                .groupBy(key, *([p] if level else []), f"{p}_cell")
                .agg(F.min("_v").alias(f"{p}_lo"), F.max("_v").alias(f"{p}_hi"), F.sum("_w").alias(f"{p}_w")))

    levels: list[DataFrame] = []
    pairs = cells(chosen, "a", 0).join(cells(leads, "b", 0), key)
    for level in range(1, LEVELS + 3):
        levels.append(stage(pairs.select(
            key, F.col("a_cell").alias("a"), F.col("b_cell").alias("b"),
            bin_of(F.col("a_lo") - F.col("b_hi")).alias("lo"), bin_of(F.col("a_hi") - F.col("b_lo")).alias("hi"),
            (F.col("a_w") * F.col("b_w")).alias("n")), "change-pairs"))
        cut = levels[-1].where(F.col("lo") < F.col("hi")).select(key, "a", "b")
        if level > LEVELS + 1 or cut.isEmpty():
            break
        pairs = cut.join(cells(chosen, "a", level), [key, "a"]).join(cells(leads, "b", level), [key, "b"])
    return levels


def rate_change_histogram(final_rows: DataFrame, grid: DataFrame, bins: int = HISTOGRAM_BINS, key: str = COLS.key,
                          rate: str = COLS.rate, step: str = COLS.step, weight: str = "copies") -> DataFrame:
    """Equal-width histogram (``bin, lo, hi, n``; non-empty bins) of chosen rate minus
    lead rate over all chosen rows (counted ``weight`` times) and lead rows of their
    key: the rows of ``histogram(rate_change(..), "dif_tasa")``.  Eager: each side is
    staged as weighted rates, then read per level of cells."""
    chosen = stage(weighted_rates(final_rows, key, rate, F.col(weight)), "chosen-rates")
    leads = stage(weighted_rates(grid.where(F.col(step) == F.lit(0)), key, rate, F.lit(1)), "lead-rates")
    found = change_range(chosen, leads, key)
    if found is None:
        return final_rows.sparkSession.createDataFrame([], "bin long, lo double, hi double, n long")
    mn, mx = found
    counts = None
    for pairs in pair_levels(chosen, leads, mn, mx, bins, key):
        part = pairs.where(F.col("lo") == F.col("hi")).select(F.col("lo").alias("bin"), "n")
        counts = part if counts is None else counts.unionByName(part)
    edge = F.lit(mx - mn) / F.lit(float(bins))
    return counts.groupBy("bin").agg(F.sum("n").alias("n")).select(
        "bin", (F.lit(mn) + (F.col("bin") - F.lit(1)) * edge).alias("lo"),
        (F.lit(mn) + F.col("bin") * edge).alias("hi"), "n")
