"""Lineage cuts go to the folder the session names in spark.checkpoint.dir."""

from pyspark.sql import functions as F

from rategrid.operators.limits import rate_floor
from rategrid.session import BROADCAST_BYTES, BROADCAST_CONF, configure
from rategrid.sources.io import checkpoint_dir, stage


def test_checkpoint_dir_from_session(spark):
    d = spark.conf.get("spark.checkpoint.dir")
    assert checkpoint_dir(spark) == d


def test_stage_paths_are_new_and_under_checkpoint_dir(spark):
    df = spark.range(10)
    a, b = stage(df, "same"), stage(df, "same")
    pa, pb = a.inputFiles()[0], b.inputFiles()[0]
    root = spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert root in pa and root in pb
    assert pa.rsplit("/", 1)[0] != pb.rsplit("/", 1)[0]
    assert sorted(a.collect()) == sorted(b.collect())


def _floored(spark, path: str, rows: int):
    spark.range(rows).select(F.col("id").cast("string").alias("llave"), F.rand(1).alias("x"), F.rand(2).alias("y"),
                             F.rand(3).alias("tasapropuestamin")).write.parquet(path)
    t = spark.read.parquet(path)
    grid = t.select("llave", "x", "y", F.explode(F.sequence(F.lit(1), F.lit(17))).alias("iter"), F.lit(0.5).alias("tasa_propuesta"))
    return rate_floor(grid, t)._jdf.queryExecution().executedPlan().toString()


def test_exploded_grid_and_side_table_of_few_megabytes_are_not_broadcast(spark, tmp_path):
    before = spark.conf.get(BROADCAST_CONF)
    try:
        spark.conf.set(BROADCAST_CONF, "10485760b")
        configure(spark)
        assert "BroadcastExchange" not in _floored(spark, f"{tmp_path}/large", 150_000)
        assert "BroadcastExchange" in _floored(spark, f"{tmp_path}/small", 1_000)
        spark.conf.set(BROADCAST_CONF, "-1")
        configure(spark)
        assert spark.conf.get(BROADCAST_CONF) == "-1"
        spark.conf.set(BROADCAST_CONF, "256k")
        configure(spark)
        assert spark.conf.get(BROADCAST_CONF) == "256k"
        assert BROADCAST_BYTES == 1 << 20
    finally:
        spark.conf.set(BROADCAST_CONF, before)
