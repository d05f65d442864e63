"""Plan shape: one scan per branch, no window or sort-based aggregation in the
sweep, pushed-down cap predicate, broadcast only of one-row tables."""

import re

from pyspark.sql import functions as F

from rategrid.catalog import capped_single, grid_single
from rategrid.operators.limits import cap_iterations
from rategrid.operators.summary import portfolio
from rategrid.operators.limits import lead_rows
from rategrid.operators.skew import keyed_stage
from rategrid.plans.tradeoff import final_selection, tradeoff
from rategrid.sources.io import read_grid, stage

from .conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text: str) -> list[str]:
    return [x for x in text.splitlines() if re.search(r"\bExchange (hash|range|Round|Single)", x)]


def keyed_capped(spark, sf=SF_SMALL, **kw):
    return keyed_stage(capped_single(spark, sf), name="plan-test", **kw)


def test_sweep_moves_no_grid_row_after_its_stage(spark):
    """Statistics, picks and the rows at the chosen rates read the stage in place:
    the only exchanges hold at most one row per exponent (or one row)."""
    keyed = keyed_capped(spark)
    base = portfolio(lead_rows(grid_single(spark, SF_SMALL)), ["van"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(tradeoff(keyed, base, "van", ["van"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in p
    assert len(re.findall("BroadcastNestedLoopJoin", p)) == 1          # the one-row baseline
    moved = exchanges(p)
    assert all("hashpartitioning(exp#" in x or "SinglePartition" in x for x in moved), moved
    assert len([x for x in p.splitlines() if "FileScan parquet" in x and "Bucketed: true" in x]) == 2


def test_final_selection_has_one_full_exchange(spark, monkeypatch):
    """The stage's write holds the only exchange of grid rows, and computes the grid once."""
    from importlib import import_module

    skew, written = import_module("rategrid.operators.skew"), []
    real = skew.stage_by

    def spy(df, by, name=None):
        written.append(plan(df.repartition(8, *by)))
        return real(df, by, name)

    monkeypatch.setattr(skew, "stage_by", spy)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(final_selection(grid_single(spark, SF_SMALL), "van", 2.5, ["van"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(written) == 1 and len(exchanges(written[0])) == 1
    assert exchanges(p) == [] and "orders.parquet" not in p
    # statistics and picks read a few columns of the stage, one scan reads all
    wide = [x for x in p.splitlines() if "FileScan parquet" in x and "roa_saldo" in x]
    assert len(wide) == 1


def test_envelope_bounds_the_rows_per_key(spark):
    """Keys of 400 positive rows: a handful lie on the upper envelope, whatever the number of rows."""
    from rategrid.operators.selection import upper_envelope
    from rategrid.rules import SWEEP_EXPONENTS

    g = spark.range(20 * 400).select(
        (F.col("id") % 20).cast("string").alias("llave"), F.expr("0.02 + 0.9 * (1 - (id div 20) / 400)").alias("p"),
        F.expr("100 + 1000 * sqrt((id div 20) / 400) + (id % 20)").alias("v"))
    kept = upper_envelope(g, ["llave"], SWEEP_EXPONENTS, "v", "p").groupBy("llave").count().collect()
    assert len(kept) == 20 and max(r["count"] for r in kept) <= 2 * len(SWEEP_EXPONENTS)


def test_cap_predicate_pushed_to_parquet(spark, tmp_path):
    path = str(tmp_path / "grid")
    grid_single(spark, SF_SMALL).write.parquet(path)
    p = plan(cap_iterations(read_grid(spark, path)).select("llave"))
    scan = [line for line in p.splitlines() if "FileScan" in line][0]
    assert "PushedFilters: [" in scan and "seg_wtp_cef" in scan
    # only the needed columns are read
    m = re.search(r"ReadSchema: struct<([^>]*)>", scan)
    assert m and set(m.group(1).split(",")) == {"llave:string", "seg_wtp_cef:int", "iter:int"}


def test_hot_keys_are_exact_at_any_total(spark):
    """10^12 rows, some buckets large by many small keys: only keys over the budget are hot."""
    from rategrid.operators.skew import hot_keys

    rows = [("big", 900_000_000)] + [(f"k{i}", 500_000_000) for i in range(2000)] + [(f"s{i}", 1000) for i in range(3000)]
    rows += [(f"m{i}", 1_900_000) for i in range(3000)] + [(None, 5_000_000)]
    df = spark.createDataFrame(rows, "llave string, _n long")
    got = {r._hot: r._salts for r in hot_keys(df, n="_n").table.collect()}
    assert got["big"] == 450 and got[None] == 3 and all(got[f"k{i}"] == 250 for i in range(2000))
    assert len(got) == 2002
    assert hot_keys(df.where("_n < 2000000"), n="_n").table is None


def test_hot_key_rows_are_salted_over_many_tasks(spark):
    from rategrid.catalog import grid_hot_key
    from rategrid.operators.skew import hot_keys, key_join, salted

    g = stage(grid_hot_key(spark, "/root/testdata/sf0.01").select("llave", "iter", "tasa_propuesta", "van").repartition(8), "hot")
    hot = hot_keys(g, rows_per_task=2000)
    per = salted(g, hot, "llave", g.columns).groupBy("llave", "_salt").count()
    sizes = [r["count"] for r in per.where("llave = 'R'").collect()]
    n = g.where("llave = 'R'").count()
    assert len(sizes) >= 8 and max(sizes) < n / 4
    assert per.where("llave <> 'R' AND _salt > 0").count() == 0
    side = g.groupBy("llave").agg(F.max("van").alias("m"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = key_join(g, side, hot)
        assert j.count() == g.count() and j.where("m IS NULL").count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_equal_rows_get_different_salts(spark):
    from rategrid.operators.skew import hot_keys, salted

    g = spark.range(10_000, numPartitions=32).select(F.lit("a").alias("llave"), F.lit(1.0).alias("x"))
    hot = hot_keys(g, rows_per_task=1250)
    s = salted(g, hot, "llave", ["llave", "x"])
    per = [r["count"] for r in s.groupBy("_salt").count().collect()]
    assert len(per) >= 6 and max(per) < 5000
    assert s.exceptAll(salted(g, hot, "llave", ["llave", "x"])).count() == 0


def test_null_and_hot_keys_survive_a_left_join(spark):
    from rategrid.operators.skew import key_join

    g = spark.createDataFrame([("a", i) for i in range(40)] + [(None, i) for i in range(30)] + [("b", 0)], "llave string, v int")
    side = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "llave string, w int")
    out = key_join(g, side, how="left", rows_per_task=10, by=["v"])
    got = {(r.llave, r.w): r["count"] for r in out.groupBy("llave", "w").count().collect()}
    assert got == {("a", 1): 40, (None, None): 30, ("b", 2): 1}


def test_hot_key_joins_without_broadcast(spark):
    from rategrid.catalog import QUERIES

    names = ["nearest_rate_hot_key", "rate_floor_hot_key", "enrich_hot_key", "rate_change_hot_key", "best_rate_hot_key"]
    want = {n: QUERIES[n](spark, SF_SMALL).collect() for n in names}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for n in names:
            got = QUERIES[n](spark, SF_SMALL).collect()
            assert sorted(map(repr, got)) == sorted(map(repr, want[n])), n
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rate_change_output_is_bounded_by_distinct_lead_rates(spark):
    from rategrid.catalog import QUERIES, grid_hot_key

    sf = "/root/testdata/sf0.01"
    g = grid_hot_key(spark, sf)
    leads = g.where("iter = 0 AND llave = 'R'").select("tasa_propuesta").distinct().count()
    rows = QUERIES["rate_change_hot_key"](spark, sf).where("llave = 'R'")
    chosen = QUERIES["chosen_rows_hot_key"](spark, sf).where("llave = 'R'").count()
    assert 0 < rows.count() <= chosen * leads


def test_rows_of_large_buckets_stay_in_their_partitions(spark):
    """The rows of a hot key share one bucket: they are not exchanged by it."""
    from rategrid.operators.skew import in_buckets, key_bucket
    from rategrid.session import BROADCAST_CONF

    df = spark.createDataFrame([("R",)] * 5 + [("a",), (None,)], "llave string")
    before = spark.conf.get(BROADCAST_CONF)
    spark.conf.set(BROADCAST_CONF, "-1")
    try:
        large = df.groupBy(key_bucket("llave").alias("_bucket")).count().where("count > 2").select("_bucket")
        out = in_buckets(df, large, "llave")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert [r.llave for r in out.collect()] == ["R"] * 5
    finally:
        spark.conf.set(BROADCAST_CONF, before)


def test_gaps_are_joined_before_the_steps(spark):
    """Orders, not their 17 steps, are exchanged for their status and priority."""
    from rategrid.sources.tables import dense_grid, gappy_grid, gappy_lead_grid

    sf = "/root/testdata/sf0.001"
    for grid in (gappy_grid(spark, sf), gappy_lead_grid(spark, sf)):
        lines = grid._jdf.queryExecution().optimizedPlan().toString().splitlines()
        generate = [i for i, x in enumerate(lines) if "Generate explode" in x]
        joins = [i for i, x in enumerate(lines) if "Join Inner" in x]
        assert len(generate) == 1 and joins and min(joins) > generate[0]
        assert sorted(grid.columns) == sorted(dense_grid(spark, sf).columns) and grid.columns[0] == "llave"


def test_run_multi_stages_no_expected_values(spark):
    """Expected values are products of staged columns: they are made again on reading."""
    from rategrid.operators.limits import expected, rate_floor, score_filter
    from rategrid.plans.pipelines import run_multi
    from rategrid.sources.tables import dense_grid, floor_table

    sf = "/root/testdata/sf0.001"
    g, floors = dense_grid(spark, sf), floor_table(spark, sf)
    r = run_multi(g, floors, exps=[2.0])
    staged = [p for p in r.stages if "/stage-capped-multi-" in p]
    assert staged and not [c for c in spark.read.parquet(staged[0]).columns if c.endswith("_estimado")]
    want = rate_floor(expected(score_filter(g), ("roa", "avg_balance", "roa_saldo")), floors)
    assert r.capped.columns == want.columns
    assert r.capped.exceptAll(want).isEmpty() and want.exceptAll(r.capped).isEmpty()


def test_run_multi_sorts_the_grid_once(spark, monkeypatch):
    """The floors are the hash table of the join before the stage: the grid's rows are sorted for the stage only."""
    from importlib import import_module

    from rategrid.plans.pipelines import run_multi
    from rategrid.sources.tables import dense_grid, floor_table

    skew, written = import_module("rategrid.operators.skew"), []
    real = skew.stage_by

    def spy(df, by, name=None):
        written.append(plan(df.repartition(8, *by)))
        return real(df, by, name)

    monkeypatch.setattr(skew, "stage_by", spy)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run_multi(dense_grid(spark, SF_SMALL), floor_table(spark, SF_SMALL), exps=[2.0])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(written) == 1 and "ShuffledHashJoin" in written[0]
    assert "SortMergeJoin" not in written[0] and "Sort [" not in written[0]


def test_hashed_floors_of_hot_and_repeated_keys(spark):
    """Hot, repeated, missing and null keys: the same rows with the floors as hash table."""
    from rategrid.operators.limits import rate_floor
    from rategrid.operators.skew import hot_keys

    g = spark.createDataFrame([("a", i, 0.01 * i) for i in range(40)] + [("b", 0, 0.2), ("b", 0, 0.2), ("c", 0, 0.3), (None, 0, 0.3)],
                              "llave string, iter int, tasa_propuesta double")
    floors = spark.createDataFrame([("a", 0.1), ("a", 0.3), ("b", 0.2), ("b", None), ("d", 0.0), (None, 0.0)],
                                   "llave string, tasapropuestamin double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for n in (10, 1000):
            hot = hot_keys(g, rows_per_task=n)
            assert (hot.table is not None) == (n == 10)
            got = [sorted(map(tuple, rate_floor(g, f, hot=hot).select("llave", "iter", "tasa_propuesta", "tasapropuestamin").collect()))
                   for f in (floors, floors.hint("shuffle_hash"))]
            assert got[0] == got[1] and len(got[0]) == 30 + 10 + 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
