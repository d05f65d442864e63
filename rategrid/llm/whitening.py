"""Embedding whitening from exact polarised covariances.

Entries become integers ``x = floor(scale * c)``.  The fit list is each distinct
vector once, ``n`` vectors with per-dimension sums ``S``.  Instead of products of
two dimensions, only squares are aggregated: the exact squared centred values of
every dimension and of the sum of every pair of dimensions.  The difference of
these variances recovers every cross-covariance,
``cov(i, j) = (var(i + j) - var(i) - var(j)) / 2``, and the assembled matrix goes
to ``eigh``.

All of this is exact.  Values are centred at ``floor(S / n)`` before they are
squared, which keeps them small whatever ``n`` is; with ``r = S - n * floor(S / n)``
the squares about the true mean are ``sum (n*x - S)^2 = n^2 * sum z^2 - n * r^2``
in whole numbers, and the covariance is rounded once.  Each task sends one
partial sum per dimension pair; sums are kept as two decimals, so none wraps.  The
driver sees one number per pair of dimensions, whatever the number of rows.

Cases: vectors that are null or hold null or non-finite entries take no part;
rows repeating an id, and rows with a null id, each keep their rows; shorter
vectors are padded with zeros; integers beyond 64 bits saturate; a deviation
beyond 64 bits is null; components without variance (eigenvalue within rounding
of zero: one distinct vector, equal dimensions) are left out, so fewer than four
may be returned; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rategrid.llm.common import prepare, stage

SCALE = 256
COMPONENTS = 4
_HALF = 10**18                   # sums are carried as (high, low) of this base
_SMALL = float(2**28)            # centred values below this are squared in 64 bits
_OUT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
        "identity_error double")


def integers(table: DataFrame, id_col: str = "vec_id", vec: str = "embedding", scale: int = SCALE,
             keep: tuple[str, ...] = ()) -> DataFrame:
    """``vec_id, x`` (array of long) and the columns ``keep`` of the rows that take part."""
    x = F.transform(F.col(vec), lambda c: c.cast("double"))
    finite = F.forall("_c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return (table.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("_c"), *keep)
            .where(F.col("_c").isNotNull() & finite)
            .select("vec_id", F.transform("_c", lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("x"), *keep))


def padded(rows: DataFrame, width: int) -> DataFrame:
    """``x`` filled up with zeros to ``width`` entries."""
    fill = F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))
    return rows.withColumn("x", F.when(F.size("x") < width, F.concat("x", fill)).otherwise(F.col("x")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an Arrow list column as an integer matrix."""
    return column.flatten().to_numpy().reshape(len(column), width)


def summed(rows: DataFrame, width: int, size: int, add: Callable[[np.ndarray], np.ndarray]) -> list[int]:
    """Exact totals of ``size`` numbers over all rows: ``add`` gives them for a
    batch (integers that fit 64 bits, or Python integers).  A task keeps one
    running total of each, and Spark adds up the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, object)
        for b in batches:
            if b.num_rows:
                total += add(matrix(b.column(0), width)).astype(object)
        at = np.nonzero(total)[0]
        high, low = total[at] // _HALF, total[at] % _HALF
        yield pa.record_batch([pa.array(at, pa.int64()), *(pa.array([Decimal(int(v)) for v in x], pa.decimal128(38, 0))
                                                          for x in (high, low))], names=["slot", "high", "low"])

    parts = rows.select("x").mapInArrow(run, "slot long, high decimal(38,0), low decimal(38,0)")
    out = [0] * size
    for r in parts.groupBy("slot").agg(F.sum("high").alias("h"), F.sum("low").alias("l")).collect():
        out[r["slot"]] = int(r["h"]) * _HALF + int(r["l"])
    return out


def centred(x: np.ndarray, centre: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``x - centre`` as (rows that fit 64-bit squares, other rows as Python
    integers, which rows are the former)."""
    c = np.array([float(v) for v in centre])
    fits = np.abs(x.astype(float) - c).max(axis=1, initial=0) < _SMALL
    wide = x[~fits].astype(object) - np.array(centre, object) if not fits.all() else np.zeros((0, x.shape[1]), object)
    # a row that fits lies within 2^28 of the centre, so the difference cannot wrap
    small = x[fits] - np.array([int(v) for v in centre], np.int64)
    return small, wide, fits


def pair_squares(x: np.ndarray, centre: list[int]) -> np.ndarray:
    """Sums of squared centred values of every dimension, then of every pair sum
    ``(0,1), (0,2), ..``."""
    small, wide, _ = centred(x, centre)
    out = _squares(small[:1024]).astype(object)
    for at in range(1024, len(small), 1024):               # 1024 squares below 2^58 may pass 63 bits only together
        out += _squares(small[at:at + 1024]).astype(object)
    return out + _squares(wide) if len(wide) else out


def _squares(z: np.ndarray) -> np.ndarray:
    if z.dtype != object and len(z) and 4.0 * float(np.abs(z).max()) ** 2 * len(z) >= 2.0**62:
        z = z.astype(object)
    parts = [(z * z).sum(axis=0)]
    for i in range(z.shape[1] - 1):
        t = z[:, i + 1:] + z[:, i:i + 1]
        parts.append((t * t).sum(axis=0))
    return np.concatenate(parts)


def covariance(n: int, sums: list[int], squares: list[int]) -> tuple[np.ndarray, float]:
    """Covariance matrix (divisor ``n``) and trace from the pair squares."""
    d = len(sums)
    r = [s - n * (s // n) for s in sums]
    # n^2 times the variance of each dimension and of each pair sum, times n
    own = [n * n * squares[i] - n * r[i] * r[i] for i in range(d)]
    v = np.zeros((d, d))
    at = d
    for i in range(d):
        v[i, i] = float(Fraction(own[i], n**3))
        for j in range(i + 1, d):
            both = n * n * squares[at] - n * (r[i] + r[j]) ** 2
            v[i, j] = v[j, i] = float(Fraction(both - own[i] - own[j], 2 * n**3))
            at += 1
    return v, float(Fraction(sum(own), n**3))


def components(v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues of ``v`` and their unit vectors (columns), those
    within rounding of zero left out."""
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    good = int((e[:count] > max(e[0], 0.0) * len(e) * np.finfo(float).eps).sum()) if len(e) and e[0] > 0 else 0
    q = q[:, :good]
    flip = np.sign(q[np.abs(q).argmax(axis=0), np.arange(good)])
    return e[:good], q * flip


class Model:
    """Fitted whitening: exact means as (centre, remainder), components."""

    def __init__(self, n: int, sums: list[int], e: np.ndarray, q: np.ndarray, trace: float):
        self.n, self.e, self.q, self.trace = n, e, q, trace
        self.centre = [s // n for s in sums]
        self.rest = [s - n * c for s, c in zip(sums, self.centre)]

    def project(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """Whitened values and exact deviations of integer rows."""
        small, wide, fits = centred(x, self.centre)
        off = np.array([r / self.n for r in self.rest])
        w = np.zeros((len(x), len(self.e)))
        scale = self.q / np.sqrt(self.e)
        w[fits] = (small - off) @ scale
        if len(wide):
            w[~fits] = np.array([[float(Fraction(int(a) * self.n - r, self.n)) for a, r in zip(row, self.rest)]
                                 for row in wide]) @ scale
        dev = np.zeros(len(x), object)
        if len(small):
            about = (((small - off) * self.n) ** 2).sum(axis=1)
            fit = about < 2.0**62
            rest = np.array(self.rest, np.int64)
            y = small[fit] * self.n - rest
            part = np.zeros(len(small), object)
            part[fit] = (y * y).sum(axis=1)
            part[~fit] = self._exact(small[~fit].astype(object))
            dev[fits] = part
        if len(wide):
            dev[~fits] = self._exact(wide)
        return w, [int(v) if v < 2**63 else None for v in dev]

    def _exact(self, z: np.ndarray) -> np.ndarray:
        if not len(z):
            return np.zeros(0, object)
        y = z * self.n - np.array(self.rest, object)
        return (y * y).sum(axis=1)


def fit(vectors: DataFrame, width: int, count: int = COMPONENTS) -> Model | None:
    """Model of a staged table of distinct integer vectors (None: no vector)."""
    n = vectors.count()
    if not n or not width:
        return None
    sums = summed(vectors, width, width, _column_sums)
    centre = [s // n for s in sums]
    squares = summed(vectors, width, width + width * (width - 1) // 2, lambda x: pair_squares(x, centre))
    v, trace = covariance(n, sums, squares)
    e, q = components(v, count)
    return Model(n, sums, e, q, trace)


def _column_sums(x: np.ndarray) -> np.ndarray:
    if float(np.abs(x.astype(float)).max(initial=0)) * len(x) >= 2.0**62:
        return x.astype(object).sum(axis=0)
    return x.sum(axis=0)


def identity_error(vectors: DataFrame, model: Model, width: int) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = len(model.e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = np.zeros(k), np.zeros((k, k))
        for b in batches:
            w, _ = model.project(matrix(b.column(0), width))
            one += w.sum(axis=0)
            two += w.T @ w
        yield pa.record_batch([pa.array(range(k + k * k), pa.int32()), pa.array(np.concatenate([one, two.ravel()]))],
                              names=["slot", "s"])

    got = np.zeros(k + k * k)
    for r in vectors.select("x").mapInArrow(run, "slot int, s double").groupBy("slot").agg(F.sum("s").alias("s")).collect():
        got[r["slot"]] = r["s"]
    mean, second = got[:k] / model.n, got[k:].reshape(k, k) / model.n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def whiten(table: DataFrame, id_col: str = "vec_id", vec: str = "embedding", scale: int = SCALE,
           count: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of
    every row that takes part.  Eager: rows and fit list are staged."""
    spark = prepare(table.sparkSession)
    rows = stage(integers(table, id_col, vec, scale), "whiten-rows")
    sizes = rows.agg(F.min(F.size("x")).alias("lo"), F.max(F.size("x")).alias("hi")).first()
    width = sizes["hi"] or 0
    if sizes["lo"] != sizes["hi"]:
        rows = padded(rows, width)
    vectors = stage(rows.select("x").distinct(), "whiten-fit")
    model = fit(vectors, width, count)
    if model is None or not len(model.e):
        return spark.createDataFrame([], _OUT)
    error = identity_error(vectors, model, width)
    explained = model.e / model.trace
    k = len(model.e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.num_rows
            w, dev = model.project(matrix(b.column(1), width))
            again = pa.array(np.repeat(np.arange(m), k))
            yield pa.record_batch([
                b.column(0).take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, model.n, np.int64)), pa.array(dev, pa.int64()).take(again),
                pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(run, _OUT)
