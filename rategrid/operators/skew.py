"""Hot keys, and key joins that spread them.

A key is hot when it holds more than ``rows_per_task`` rows.  :func:`hot_keys` finds
these keys exactly in two looks.  The first is a mergeable summary: rows per hash
bucket of the key, combined map-side; a key over the budget has its bucket over
the budget, so no hot key is missed.  The second counts the keys of such buckets
exactly, so a bucket that is large by many small keys gives no hot key, at any
size of the data.  At most ``rows / rows_per_task`` keys are hot.

Every row-level join of the library goes through :func:`key_join`.  Without a hot key
(decided by the exact counts) it is a plain equi-join.  Otherwise the rows of a
hot key are dealt over ``rows of the key / rows_per_task`` salts and the other
side's rows of that key are repeated once per salt; all other keys stay as they
are, with salt 0.  The table of hot keys is broadcast up to ``BROADCAST_KEYS`` keys;
nothing that grows with the data is collected.

A row's salt is a hash of its values and of the partition it is read in: equal
rows in different partitions get different salts, and a retried task gives each
row the salt it had before, in whatever order its rows arrive.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rategrid.schema import COLS
from rategrid.sources.io import stage, stage_by

SALT_BUCKETS = 1 << 20
ROWS_PER_TASK = 2_000_000
BROADCAST_KEYS = 1_000_000


@dataclass(frozen=True)
class HotKeys:
    """The hot keys of a table as ``(_hot, _salts)`` rows; ``table`` is None where no
    key is hot.  Keys that are not in the table they are used for do no harm, so
    the hot keys of a grid serve every filter of it and every join that repeats
    no row."""

    table: DataFrame | None = None
    small: bool = True           # at most BROADCAST_KEYS keys


def key_bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(SALT_BUCKETS)).cast("int")


def in_buckets(rows: DataFrame, buckets: DataFrame, key: str) -> DataFrame:
    """``rows`` whose key falls in ``buckets``.  There are at most ``SALT_BUCKETS`` of them,
    whatever the data, so they are broadcast: rows exchanged by bucket would bring
    those of a hot key, which all share one, to a single task."""
    return rows.withColumn("_bucket", key_bucket(key)).join(F.broadcast(buckets), "_bucket", "left_semi")


def hot_keys(rows: DataFrame, key: str = COLS.key, rows_per_task: int = ROWS_PER_TASK,
             n: str | None = None) -> HotKeys:
    """Hot keys of ``rows`` (``n``: a column of row counts, if the rows are counts).
    Eager: one pass over the key column, a second one over the rows of large
    buckets if there are any; the hot keys are staged."""
    weight = F.count(F.lit(1)) if n is None else F.sum(n)
    narrow = rows.select(key, *([n] if n else []))
    budget = F.lit(rows_per_task)
    large = (narrow.groupBy(key_bucket(key).alias("_bucket")).agg(weight.alias("_rows"))
             .where(F.col("_rows") > budget).select("_bucket"))
    if large.isEmpty():
        return HotKeys()
    exact = in_buckets(narrow, large, key).groupBy(key).agg(weight.alias("_rows")).where(F.col("_rows") > budget)
    table = stage(exact.select(F.col(key).alias("_hot"), F.ceil(F.col("_rows") / budget).cast("int").alias("_salts")),
                  "hot-keys")
    found = table.count()
    return HotKeys(table, found <= BROADCAST_KEYS) if found else HotKeys()


def _with_salts(df: DataFrame, hot: HotKeys, key: str) -> DataFrame:
    """``df`` with the number of salts of its key (null: not hot)."""
    table = F.broadcast(hot.table) if hot.small else hot.table
    return df.join(table, F.col(key).eqNullSafe(F.col("_hot")), "left").drop("_hot")


def salted(rows: DataFrame, hot: HotKeys, key: str, by: Sequence[str]) -> DataFrame:
    """``rows`` with ``_salt``: 0, or for hot keys 1 .. salts from a hash of ``by``
    and the partition read."""
    seed = F.xxhash64(*[F.col(c) for c in by], F.spark_partition_id())
    return (_with_salts(rows.withColumn("_seed", seed), hot, key)
            .withColumn("_salt", F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(
                F.lit(1) + F.pmod(F.col("_seed"), F.col("_salts").cast("long")).cast("int")))
            .drop("_seed", "_salts"))


def repeated(side: DataFrame, hot: HotKeys, key: str) -> DataFrame:
    """``side`` with every row once per salt of its key."""
    salts = F.when(F.col("_salts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.col("_salts")))
    return _with_salts(side, hot, key).withColumn("_salt", F.explode(salts)).drop("_salts")


def key_join(rows: DataFrame, side: DataFrame, hot: HotKeys | None = None, key: str = COLS.key,
             how: str = "inner", by: Sequence[str] | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``rows`` joined with ``side`` on ``key`` (``how``: inner, left, left_semi), hot keys
    spread over salts.  ``hot`` defaults to those of ``rows`` (found eagerly); ``by`` are the
    columns hashed into the salt (default: those of key, step, rate and client
    that ``rows`` has, or all)."""
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"how must be inner, left or left_semi, got {how!r}")
    hot = hot_keys(rows, key, rows_per_task) if hot is None else hot
    if hot.table is None:
        return rows.join(side, on=key, how=how)
    own = [c for c in (key, COLS.step, COLS.rate, COLS.client) if c in rows.columns]
    cols = list(by) if by is not None else own if len(own) > 1 else rows.columns
    return salted(rows, hot, key, cols).join(repeated(side, hot, key), on=[key, "_salt"], how=how).drop("_salt")


@dataclass(frozen=True)
class Keyed:
    """Rows staged by key: bucketed on the key (and the salt, where a key is hot),
    so that grouping by the key and joining on it need no further exchange of
    the rows."""

    rows: DataFrame
    key: str
    hot: HotKeys

    @property
    def by(self) -> list[str]:
        return [self.key] if self.hot.table is None else [self.key, "_salt"]

    def columns(self, *cols: str) -> DataFrame:
        """The rows' ``cols`` and what they are staged by."""
        return self.rows.select(*dict.fromkeys([*self.by, *cols]))

    def join(self, rows: DataFrame, side: DataFrame, how: str = "inner") -> DataFrame:
        """``rows`` (derived from :attr:`rows`, with the columns ``by``) joined with ``side``
        on the key; only ``side`` can move."""
        if self.hot.table is None:
            return rows.join(side, on=self.key, how=how)
        return rows.join(repeated(side, self.hot, self.key), on=self.by, how=how)


def keyed_stage(grid: DataFrame, key: str = COLS.key, name: str = "grid", hot: HotKeys | None = None,
                rows_per_task: int = ROWS_PER_TASK) -> Keyed:
    """Stage ``grid`` by key: the one full exchange of its rows.  ``hot`` defaults to the
    hot keys of ``grid`` (found by a pass over its key column).  Eager."""
    hot = hot_keys(grid, key, rows_per_task) if hot is None else hot
    if hot.table is not None:
        own = [c for c in (key, COLS.step, COLS.rate, COLS.client) if c in grid.columns]
        grid = salted(grid, hot, key, own if len(own) > 1 else grid.columns)
    by = [key] if hot.table is None else [key, "_salt"]
    return Keyed(stage_by(grid, by, name), key, hot)
