"""Sources and sinks: typed CSV, conform, staged Parquet, partitioned overwrite."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rategrid.operators.prep import conform, normalise_names
from rategrid.schema import FLOOR_SCHEMA
from rategrid.sources.io import read_csv_table, stage, write_stage


def test_typed_csv(spark, tmp_path):
    p = tmp_path / "floor.csv"
    p.write_text("llave,TasaPropuestaMin\na,0.15\nb,0.2\n")
    df = read_csv_table(spark, str(p), FLOOR_SCHEMA)
    assert df.schema == FLOOR_SCHEMA
    assert sorted(tuple(r) for r in df.collect()) == [("a", 0.15), ("b", 0.2)]


def test_conform_strict_and_lenient(spark):
    df = spark.createDataFrame([("1", "x"), ("2", "0.5")], "ITER string, TASA string")
    schema = T.StructType([T.StructField("iter", T.IntegerType()), T.StructField("tasa", T.DoubleType()),
                           T.StructField("extra", T.LongType())])
    got = conform(normalise_names(df), schema, strict=False, missing="null").collect()
    assert [tuple(r) for r in got] == [(1, None, None), (2, 0.5, None)]
    with pytest.raises(Exception):
        conform(normalise_names(df), schema, strict=True).collect()


def test_conform_names_missing_columns(spark):
    schema = T.StructType([T.StructField("iter", T.IntegerType()), T.StructField("tasa", T.DoubleType())])
    with pytest.raises(ValueError, match="tasa"):
        conform(spark.createDataFrame([("1",)], "iter string"), schema)


def test_csv_is_read_by_header_name(spark, tmp_path):
    p = tmp_path / "floor.csv"
    p.write_text("x,TasaPropuestaMin,y,LLAVE\n1,0.15,2,a\n3,0.2,4,b\n")
    df = read_csv_table(spark, str(p), FLOOR_SCHEMA)
    assert sorted(tuple(r) for r in df.collect()) == [("a", 0.15), ("b", 0.2)]
    p.write_text("llave,tasapropuestamin\na,abc\n")
    with pytest.raises(Exception):
        read_csv_table(spark, str(p), FLOOR_SCHEMA).collect()
    p.write_text("llave,tasa\na,0.1\n")
    with pytest.raises(ValueError, match="tasapropuestamin"):
        read_csv_table(spark, str(p), FLOOR_SCHEMA)


def test_two_months_survive_in_every_table(spark, tmp_path):
    import os

    from rategrid.catalog import TEST_BANDS
    from rategrid.plans.pipelines import run_single, write_outputs
    from rategrid.sources.tables import dense_grid, product_table

    sf, out = "/root/testdata/sf0.001", str(tmp_path / "out")
    for month in (202401, 202402):
        g = dense_grid(spark, sf).withColumn("codmes", F.lit(month))
        r = run_single(g, product_table(spark, sf), TEST_BANDS, exps=[2.5], run={"codmes": month, "campana": "A"})
        staged = list(r.stages)
        assert staged and all(os.path.exists(p) for p in staged)
        write_outputs(r, out, ["codmes", "campana"])
        assert not any(os.path.exists(p) for p in staged)
    for name in ("grid", "capped", "baseline", "tradeoff", "final", "bucket_base", "bucket_final", "rate_change", "histogram"):
        months = {x.codmes for x in spark.read.parquet(f"{out}/{name}").select("codmes").distinct().collect()}
        assert months == {202401, 202402}, name


def test_missing_partition_column_is_an_error(spark, tmp_path):
    from rategrid.plans.pipelines import run_multi, write_outputs
    from rategrid.sources.tables import dense_grid, floor_table

    sf = "/root/testdata/sf0.001"
    with pytest.raises(ValueError, match="campana"):
        write_stage(spark.createDataFrame([(1,)], "v int"), str(tmp_path / "x"), ["campana"])
    r = run_multi(dense_grid(spark, sf), floor_table(spark, sf), exps=[2.0])
    with pytest.raises(ValueError, match="baseline"):
        write_outputs(r, str(tmp_path / "y"), ["codmes"])
    assert not (tmp_path / "y").exists()


def test_stage_round_trip(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    s = stage(df, "round-trip")
    assert sorted(s.collect()) == sorted(df.collect())


def test_dynamic_partition_overwrite(spark, tmp_path):
    path = str(tmp_path / "out")
    a = spark.createDataFrame([(202401, "c1", 1), (202402, "c1", 2)], "codmes int, campana string, v int")
    write_stage(a, path, ["codmes", "campana"])
    b = spark.createDataFrame([(202402, "c1", 3)], "codmes int, campana string, v int")
    write_stage(b, path, ["codmes", "campana"])
    got = sorted(tuple(r) for r in spark.read.parquet(path).select("codmes", "v").collect())
    assert got == [(202401, 1), (202402, 3)]


def test_export_csv_and_pipeline_outputs(spark, tmp_path):
    from rategrid.catalog import TEST_BANDS
    from rategrid.plans.pipelines import run_single, write_outputs
    from rategrid.sources.io import export_csv
    from rategrid.sources.tables import dense_grid, product_table

    sf = "/root/testdata/sf0.001"
    r = run_single(dense_grid(spark, sf), product_table(spark, sf), TEST_BANDS, exps=[0.5, 2.5], run={"codmes": 202401})
    assert r.tradeoff.count() == 2
    # the final rows are staged once and feed three reports
    n_final = r.final.count()
    assert r.rate_change.count() == n_final
    assert r.bucket_final.agg(F.sum("clientes")).first()[0] == r.final.agg(F.sum("copies")).first()[0]
    assert r.histogram.agg(F.sum("n")).first()[0] == r.final.agg(F.sum("copies")).first()[0]
    out = str(tmp_path / "out")
    write_outputs(r, out, partition_by=["codmes"], keep_stages=True)
    back = spark.read.parquet(f"{out}/final")
    assert back.count() == n_final and "codmes" in back.columns
    csv = str(tmp_path / "tradeoff_csv")
    export_csv(r.tradeoff, csv)
    assert spark.read.option("header", True).csv(csv).count() == 2
