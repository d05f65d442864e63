"""Data preparation: typing, naming, sampling, top offer and nearest rate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rategrid.functions.columns import dec
from rategrid.operators.skew import ROWS_PER_TASK, HotKeys, keyed_stage
from rategrid.schema import COLS
from rategrid.sources.io import stage


def normalise_names(df: DataFrame) -> DataFrame:
    """Lower-case every column name (the engine resolves names case-insensitively)."""
    return df.toDF(*[c.lower() for c in df.columns])


def conform(df: DataFrame, schema: T.StructType, strict: bool = True, keep_extra: bool = False,
            missing: str = "error") -> DataFrame:
    """Cast the columns named in ``schema`` (matched case-insensitively) to its
    types, in its order.  ``strict`` uses ``cast`` (malformed text raises under
    ANSI mode); otherwise ``try_cast`` turns it into null.  Columns of
    ``schema`` missing from ``df`` are an error; ``missing="null"`` adds them as
    typed nulls."""
    if missing not in ("error", "null"):
        raise ValueError(f"missing must be 'error' or 'null', got {missing!r}")
    by_lower = {c.lower(): c for c in df.columns}
    absent = [f.name for f in schema.fields if f.name.lower() not in by_lower]
    if absent and missing == "error":
        raise ValueError(f"columns missing: {', '.join(absent)}")
    out = []
    for f in schema.fields:
        src = by_lower.get(f.name.lower())
        if src is None:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
        else:
            c = F.col(src)
            out.append((c.cast(f.dataType) if strict else c.try_cast(f.dataType)).alias(f.name))
    if keep_extra:
        wanted = {f.name.lower() for f in schema.fields}
        out += [F.col(c) for c in df.columns if c.lower() not in wanted]
    return df.select(*out)


def top_offer(
    offers: DataFrame,
    key: str = COLS.client,
    order: str = COLS.amount,
    tiebreak: str | None = None,
    nulls_first: bool = False,
) -> DataFrame:
    """One offer per ``key``: the largest ``order`` value, ties broken by the
    smallest ``tiebreak``.  ``nulls_first`` ranks null ``order`` values above
    all others (as a descending sort with nulls first does).

    Planned as a single ``max_by`` aggregation.  Its struct buffers make it
    sort-based (a local sort per task), but it still combines map-side: each
    task sends one row per client, so a client with a huge number of offers
    never lands whole in one task (unlike a row-number window, which buffers
    the client's partition).
    """
    o = F.col(order)
    rank = [o.isNull() if nulls_first else o.isNotNull(), o]
    if tiebreak is not None:
        if not _is_numeric(offers, tiebreak):
            raise ValueError("tiebreak must be a numeric column")
        t = F.col(tiebreak)
        # smaller tiebreak wins: non-null first, then the negated value
        rank += [t.isNotNull(), -t]
    cols = [c for c in offers.columns if c != key]
    best = F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(*rank))
    return offers.groupBy(key).agg(best.alias("_best")).select(key, *[F.col(f"_best.{c}").alias(c) for c in cols])


def offer_lot(
    offers: DataFrame,
    lot: int | None = None,
    sale_type: int | None = None,
    offer_type: int | None = None,
) -> DataFrame:
    """Offers of one lot, sale type and offer type (each filter optional);
    plain predicates, pushed into the Parquet scan."""
    cond = F.lit(True)
    for col, v in (("codloteoferta", lot), ("tipventa", sale_type), ("tipoferta", offer_type)):
        if v is not None:
            cond = cond & (F.col(col) == F.lit(v))
    return offers.where(cond)


def _is_numeric(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, T.NumericType)


def nearest_rate(
    grid: DataFrame,
    targets: DataFrame,
    target: str = "tasa_objetivo",
    key: str = COLS.key,
    rate: str = COLS.rate,
    rows_per_task: int = ROWS_PER_TASK,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Grid rows whose rate is nearest to the key's target rate.

    Distance ``dif_abs = abs(rate - target)`` is compared as
    ``decimal(32,10)``; all rows at the minimum distance are returned.

    Eager: the grid is staged by key, the one full exchange of its rows.  Each
    key's distinct rates meet its distinct targets for the best distance, and
    the full-width rows meet target and best distance, both where the rows are
    staged.  ``hot`` are the hot keys of the grid, if known."""
    keyed = keyed_stage(grid, key, "nearest", hot, rows_per_task)
    dist = dec(F.abs(F.col(rate) - F.col(target)))
    side = targets.select(key, target).groupBy(key, target).agg(F.count(F.lit(1)).alias("_copies"))
    pairs = keyed.columns(rate).distinct()
    # a key may have several target rows: the minimum is over all of them
    best = keyed.join(pairs, side.select(key, target)).groupBy(key).agg(F.min(dist).alias("_best"))
    near = keyed.join(keyed.rows, side.join(best, key)).withColumn("dif_abs", dist).where(
        F.col("dif_abs") == F.col("_best"))
    once = near.withColumn("_copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return once.drop("_best", "_copies", "_salt")


def key_sample(grid: DataFrame, n: int, key: str = COLS.key) -> DataFrame:
    """All rows of the first ``n`` keys in key order (keys keep all their steps).

    The key list is a top-``n`` (each task keeps its first ``n`` keys, so the
    list is bounded by ``n``).  How the semi-join runs is left to adaptive
    execution, which knows the list's measured size."""
    keys = grid.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).limit(n)
    return grid.join(keys, on=key, how="left_semi")


def preview(grid: DataFrame, n: int, order: Sequence[str] = (COLS.key, COLS.step)) -> DataFrame:
    """First ``n`` rows in a deterministic order (a top-``n``)."""
    return grid.orderBy(*order).limit(n)


def sort_scenarios(grid: DataFrame, order: Sequence[str] = (COLS.key, COLS.step)) -> DataFrame:
    """Total order by key and step (range-partitioned sort)."""
    return grid.orderBy(*order)


def numbered(grid: DataFrame, order: Sequence[str] = (COLS.key, COLS.step), name: str = "place") -> DataFrame:
    """Rows with their number (from 0) in the order of ``order`` (equal rows in any order).

    Eager: the rows are range-partitioned, sorted and staged; the rows before each
    range (one count per range) are added to the place within it.  No row passes
    Python, and no range holds more than its share unless rows are equal in
    ``order``."""
    ranges = grid.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    staged = stage(ranges.withColumns({"_range": F.spark_partition_id(), "_inside": inside}), "numbered")
    sizes = staged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # one row per range, so at most as many as there are shuffle partitions
    return (staged.join(F.broadcast(starts), "_range")
            .select(*grid.columns, (F.col("_start") + F.col("_inside")).cast("long").alias(name)))
