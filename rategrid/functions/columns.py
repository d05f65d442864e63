"""Scalar and aggregate column expressions used across the operators.

All helpers return ``pyspark.sql.Column`` objects built from built-in
functions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rategrid.rules import AMOUNT_BUCKETS, TIE_DECIMAL


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def nan_to_zero(col: str | Column) -> Column:
    """NaN becomes 0; null stays null (``when(isnan(x), 0).otherwise(x)``)."""
    c = _c(col)
    return F.when(F.isnan(c), F.lit(0.0)).otherwise(c)


def nan_to_null(col: str | Column) -> Column:
    """NaN becomes null, so aggregates skip it (the pandas rule)."""
    c = _c(col)
    return F.when(~F.isnan(c), c)


def fill_zero(col: str | Column) -> Column:
    """Null and NaN become 0 (what ``DataFrame.fillna(0)`` does to a double)."""
    return F.coalesce(F.nanvl(_c(col), F.lit(0.0)), F.lit(0.0))


def nansum(col: str | Column) -> Column:
    """Sum with NaN counted as 0 and nulls skipped; all-null input gives null."""
    return F.sum(nan_to_zero(col))


def nansum_or_zero(col: str | Column) -> Column:
    """Sum after replacing null and NaN by 0; all-null input gives 0."""
    return F.coalesce(F.sum(fill_zero(col)), F.lit(0.0))


def ratio(num: Column, den: Column) -> Column:
    """Division that yields null on a zero or null denominator (no ANSI error)."""
    return F.try_divide(num, den)


def weighted_mean(value: str | Column, weight: str | Column) -> Column:
    """sum(value * weight) / sum(weight).

    The numerator skips rows where either side is null, the denominator only
    rows with a null weight; a zero total weight gives null.
    """
    v, w = _c(value), _c(weight)
    return ratio(F.sum(v * w), F.sum(w))


def dec(col: str | Column) -> Column:
    """Fixed-scale decimal used for tolerant score equality.

    Overflow gives null (``try_cast``) instead of an error.
    """
    return _c(col).try_cast(TIE_DECIMAL)


def dec_equal(value: str | Column, best: str | Column) -> Column:
    """``dec(value) == dec(best)`` where ``best`` is the maximum of ``value``.

    Two doubles whose decimals agree differ by less than 1e-9, and ``value`` is
    never above ``best``; the cheap double test filters the rows first, so the
    decimal conversion runs only for scores next to the maximum (``AND`` is
    evaluated lazily in generated code).
    """
    v, b = _c(value), _c(best)
    return (v >= b - F.lit(1e-9)) & (dec(v) == dec(b))


def bucket_label(
    col: str | Column,
    buckets: Sequence[tuple[float | None, str]] = AMOUNT_BUCKETS,
) -> Column:
    """Label of the half-open range ``[previous upper, upper)`` holding ``col``.

    ``buckets`` is ordered by upper bound; the last entry (upper ``None``) is
    the open bucket and also receives null values.
    """
    c = _c(col)
    *bounded, (last_upper, last_label) = buckets
    if last_upper is not None:
        raise ValueError("the last bucket must be open (upper bound None)")
    expr = None
    for upper, label in bounded:
        expr = F.when(c < F.lit(upper), F.lit(label)) if expr is None else expr.when(c < F.lit(upper), F.lit(label))
    return F.lit(last_label) if expr is None else expr.otherwise(F.lit(last_label))
