"""Helpers shared by the operators: session set-up, sized partitions, prefix
sums without a per-group sort, and connected components."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rategrid.session import ensure_checkpoint_dir
from rategrid.sources import io

WORD = r"[^\x20\x09-\x0D]+"
# rows of one Arrow batch sent to Python: long texts stay a few MB per batch
ARROW_ROWS = 1000

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches and let Python workers import this package
    (on a cluster it is installed there or shipped with ``--py-files``)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the session's checkpoint folder and read it back."""
    ensure_checkpoint_dir(df.sparkSession)
    return io.stage(df, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` (null text: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_start(
    df: DataFrame,
    group: list[str],
    order: list[str],
    value: str,
    position: str,
    name: str,
    rows_per_bucket: int = 4096,
) -> DataFrame:
    """Exclusive running sum of ``value`` within ``group`` in the order of
    ``order`` without sorting a whole group in one task.

    ``position`` is a column in [0, 1), non-decreasing in ``order``.  A group of
    ``n`` rows is cut into ``n / rows_per_bucket`` buckets of ``position``; the
    bucket totals (a small aggregate) are summed over the buckets of a group and
    the rows are sorted within a bucket.  Adds ``name`` (long)."""
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    n_buckets = F.ceil(F.col("_n") / F.lit(rows_per_bucket)).cast("long")
    same = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in group]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    rows = (
        df.alias("l")
        .join(sizes.alias("r"), cond, "inner")
        .select("l.*", F.floor(F.col(f"l.{position}") * n_buckets).cast("long").alias("_bucket"))
    )
    totals = rows.groupBy(*group, "_bucket").agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*group, "_bucket", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_local", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return (
        local.alias("l")
        .join(bases.alias("r"), cond & (F.col("l._bucket") == F.col("r._bucket")), "inner")
        .select(*[F.col(f"l.{c}") for c in df.columns],
                (F.col("r._base") + F.col("l._local")).cast("long").alias(name))
    )


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph given as ``(a, b)`` long pairs:
    ``(node, root)`` for every node of an edge, ``root`` the smallest node.

    Alternates the two star steps (link every larger neighbour to the smallest
    one; link every smaller neighbour and the node itself to the smallest one)
    until the edges no longer change.  Each round is a grouped minimum and a
    join on the node, its result written to the checkpoint folder, so no
    neighbour list is gathered and a lost executor repeats one round only."""
    e = stage(edges.where(F.col("a") != F.col("b"))
              .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    seen = _signature(e)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (sym.where(F.col("v") > F.col("u")).join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small_low, "u").where(F.col("v") != F.col("m")).select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        e = stage(linked.unionByName(small_low.select("u", F.col("m").alias("v"))).distinct(), "cc")
        now = _signature(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("connected components did not converge")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _signature(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"),
              F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["x"], r["s"]
