"""Aggregate helpers: NaN-safe sums, weighted mean, buckets, histogram, profile, top offer."""

import math

import pytest
from pyspark.sql import functions as F

from rategrid.functions.columns import bucket_label, nansum, nansum_or_zero, weighted_mean
from rategrid.operators.prep import nearest_rate, top_offer
from rategrid.operators.summary import compare, histogram, portfolio, profile


def test_nansum_variants(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", 2.0), ("a", None), ("b", None)], "k string, x double")
    got = {r.k: (r.s, r.z) for r in df.groupBy("k").agg(nansum("x").alias("s"), nansum_or_zero("x").alias("z"))
           .collect()}
    assert got == {"a": (2.0, 2.0), "b": (None, 0.0)}


def test_weighted_mean_zero_weight(spark):
    df = spark.createDataFrame([(1.0, 0.0), (None, 0.0)], "r double, a double")
    assert df.agg(weighted_mean("r", "a").alias("w")).first().w is None


def test_bucket_label(spark):
    df = spark.createDataFrame([(4999.99,), (5000.0,), (119999.0,), (120000.0,), (None,)], "m double")
    got = [r.b for r in df.select(bucket_label("m").alias("b")).collect()]
    assert got == ["1.[-;5k>", "2.[5k;8k>", "8.[80k;120k>", "9.[120k;+>", "9.[120k;+>"]


def test_histogram_closed_last_bin(spark):
    df = spark.createDataFrame([(float(x),) for x in range(11)] + [(None,)], "x double")
    got = {r.bin: r.n for r in histogram(df, "x", bins=5).collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 2, 5: 3}  # the maximum closes the last bin
    one = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert [(r.bin, r.n) for r in histogram(one, "x").collect()] == [(1, 2)]


def test_histogram_weighted(spark):
    df = spark.createDataFrame([(0.0, 2), (1.0, 3)], "x double, copies long")
    got = {r.bin: r.n for r in histogram(df, "x", bins=2, weight="copies").collect()}
    assert got == {1: 2, 2: 3}


def test_compare_zero_baseline(spark):
    base = spark.createDataFrame([(1, 10.0, 0.5, 0.2, 0.2, 0.0, 0.0)],
                                 "clientes long, oferta double, prob double, tasa_cli double, tasa_pnd double, "
                                 "mto_estimado double, van_estimado double")
    sc = spark.createDataFrame([(0.6, 0.3, 0.3, 5.0, 1.0, 0.5)],
                               "prob_e double, tasa_cli_e double, tasa_pnd_e double, mto_estimado_e double, "
                               "van_estimado_e double, exp double")
    r = compare(sc, base, ["van"]).first()
    assert r.dif_mto_est == 5.0 and r.pct_mto_est is None
    assert r.pct_prob == pytest.approx(0.2)


def test_weighted_portfolio_equals_fanout(spark):
    rows = spark.createDataFrame([(0.2, 100.0, 0.5, 50.0, 3.0, 2), (0.3, 50.0, 0.4, 20.0, float("nan"), 1)],
                                 "tasa_propuesta double, mtofinalofertadosol double, prob_adj_ef double, "
                                 "mto_estimado double, van_estimado double, copies long")
    fan = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_c")).drop("_c")
    a = portfolio(rows, ["van"], weight="copies").first().asDict()
    b = portfolio(fan, ["van"]).first().asDict()
    for k in a:
        assert a[k] == pytest.approx(b[k]), k


def test_profile(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, float("nan"))], "s string, x double")
    got = {r.column: (r.type, r.non_null, r.distinct, r.rows) for r in profile(df, df.columns).collect()}
    assert got == {"s": ("string", 2, 1, 3), "x": ("double", 2, 2, 3)}


def test_merged_profiles_equal_one_over_all_rows(spark):
    from rategrid.operators.summary import merge_profiles, profile_sketch, read_profile

    rows = [(str(i % 70), float(i % 300) - 5, i, None if i % 3 else i * 1.5) for i in range(2000)]
    df = spark.createDataFrame(rows, "s string, x double, i int, m double")
    a, b, c = (profile_sketch(df.where(f"i % 3 = {k}")) for k in range(3))
    merged = read_profile(merge_profiles(merge_profiles(a.unionByName(b)).unionByName(c)))
    whole = read_profile(profile_sketch(df))
    cols = ["column", "type", "rows", "non_null", "least", "greatest"]
    assert sorted(merged.select(cols).collect()) == sorted(whole.select(cols).collect())
    got = {r.column: r for r in merged.collect()}
    assert (got["x"].least, got["x"].greatest, got["i"].greatest) == ("-5.0", "294.0", "1999")
    for col, n in (("s", 70), ("x", 300), ("i", 2000)):
        assert abs(got[col].distinct - n) <= 0.04 * n
    assert got["m"].non_null == sum(r[3] is not None for r in rows)


def test_numbered_rows(spark):
    from rategrid.operators.prep import numbered

    df = spark.createDataFrame([("R", i % 7) for i in range(500)] + [(f"k{i}", 0) for i in range(300)] + [(None, 1)],
                               "llave string, iter int").repartition(5)
    got = sorted((r.place, r.llave, r.iter) for r in numbered(df).collect())
    assert [p for p, _, _ in got] == list(range(801))
    keys = [(k is not None, k or "", i) for _, k, i in got]
    assert keys == sorted(keys)
    assert numbered(df.limit(0)).count() == 0


def test_histogram_ignores_nan(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (float("nan"),), (None,)], "x double")
    assert {r.bin: (r.lo, r.n) for r in histogram(df, "x", bins=2).collect()} == {1: (0.0, 1), 2: (0.5, 1)}


def test_pandas_rules_skip_nan(spark):
    from rategrid.operators.summary import lead_summary_pandas

    nan = float("nan")
    df = spark.createDataFrame([(0.2, 100.0, nan, nan, nan), (0.4, 50.0, 0.5, 75.0, None), (None, 150.0, 0.5, nan, None)],
                               "tasa_propuesta double, mtofinalofertadosol double, prob_adj_ef double, mto_estimado double, van_estimado double")
    r = lead_summary_pandas(df, ["van"]).first()
    assert (r.prob, r.mto_estimado, r.van_estimado, r.clientes) == (0.5, 75.0, 0.0, 3)
    assert r.tasa_cli == pytest.approx(0.3) and r.oferta == 300.0


def test_repeated_exponents_are_an_error(spark):
    from rategrid.plans.tradeoff import sweep_summaries

    g = spark.createDataFrame([("a", 0, 0.1)], "llave string, iter int, tasa_propuesta double")
    with pytest.raises(ValueError):
        sweep_summaries(g, "van", ["van"], [1.0, 1.0])


def test_top_offer_ties(spark):
    o = spark.createDataFrame([(1, 10, 5.0), (1, 11, 7.0), (1, 9, 7.0), (2, 20, None), (2, 21, 1.0)],
                              "codclavecic long, codoferta long, mtofinalofertadosol double")
    got = {r.codclavecic: r.codoferta for r in top_offer(o, tiebreak="codoferta").collect()}
    assert got == {1: 9, 2: 21}
    got = {r.codclavecic: r.codoferta for r in top_offer(o, tiebreak="codoferta", nulls_first=True).collect()}
    assert got[2] == 20


def test_nearest_rate_keeps_all_ties(spark):
    g = spark.createDataFrame([("a", 0.10), ("a", 0.20), ("a", 0.30)], "llave string, tasa_propuesta double")
    t = spark.createDataFrame([("a", 0.15)], "llave string, tasa_objetivo double")
    got = sorted(r.tasa_propuesta for r in nearest_rate(g, t).collect())
    assert got == [0.10, 0.20]


def test_dec_equal_near_ties(spark):
    from rategrid.functions.columns import dec_equal

    df = spark.createDataFrame([(5.00000000000001, 5.00000000000001), (5.0, 5.00000000000001), (5.0001, 5.0002)],
                               "v double, m double")
    assert [r.e for r in df.select(dec_equal("v", "m").alias("e")).collect()] == [True, True, False]


def test_value_counts_equal_distinct_counts(spark):
    df = spark.sql("""SELECT * FROM VALUES
        (1, CAST('NaN' AS DOUBLE), 'a', DATE'2020-01-01', 1.10BD, true, CAST(1 AS FLOAT)),
        (2, 0.0D, '', DATE'2020-01-02', 1.1BD, null, CAST('NaN' AS FLOAT)),
        (2, -0.0D, null, null, null, false, null),
        (null, CAST('NaN' AS DOUBLE), 'A', DATE'2020-01-01', 2BD, true, CAST(1 AS FLOAT)) AS t(i, d, s, t, n, b, f)""")
    want = df.agg(*[F.count(c).alias(f"n_{c}") for c in df.columns], *[F.count_distinct(c).alias(f"d_{c}") for c in df.columns]).first()
    for rows, n in ((df, 4), (df.where("i > 5"), 0)):
        got = {r.column: (r.type, r.non_null, r.distinct, r.rows) for r in profile(rows, rows.columns).collect()}
        types = dict(rows.dtypes)
        assert got == {c: (types[c], want[f"n_{c}"] if n else 0, want[f"d_{c}"] if n else 0, n) for c in df.columns}


def test_exact_profile_moves_narrow_cells(spark):
    """Columns share the slots of a cell; types without a cell form are counted by Spark."""
    g = spark.range(10).select("id", *[(F.col("id") * i).cast("double").alias(f"d{i}") for i in range(12)])
    plan = profile(g, g.columns)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "Generate" in plan
    odd = spark.range(4).select(F.array("id").alias("a"), F.lit(None).cast("long").alias("z"))
    assert {(r.column, r.non_null, r.distinct, r.rows) for r in profile(odd, odd.columns).collect()} == {("a", 4, 4, 4), ("z", 0, 0, 4)}
