"""Queries over the exploded grid send no table of the orders' size through the driver."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from rategrid.session import BROADCAST_CONF

QUERIES = ("nansum_variants", "objective_fill_variants", "objective_values", "pipeline_pandas_rules",
           "rate_band_rules_drop", "rate_band_rules_keep", "key_stats_multi")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("orders"))
    n, people = 250_000, 2_500
    k = F.col("id")
    spark.range(n).select(
        k.alias("o_orderkey"), (k % people).alias("o_custkey"),
        F.element_at(F.array(*map(F.lit, "FOP")), (k % 3 + 1).cast("int")).alias("o_orderstatus"),
        (F.rand(1) * 1e5).alias("o_totalprice"),
        F.timestamp_seconds(F.lit(8e8) + F.rand(2) * 1e7).alias("o_orderdate"),
        F.element_at(F.array(*map(F.lit, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])),
                     (k % 5 + 1).cast("int")).alias("o_orderpriority")).write.parquet(f"{d}/orders.parquet")
    spark.range(people).select(k.alias("c_custkey"), F.element_at(F.array(*map(F.lit, [
        "AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])), (k % 5 + 1).cast("int")).alias(
        "c_mktsegment")).write.parquet(f"{d}/customer.parquet")
    return d


def _broadcast(plan: str) -> list[str]:
    """The plan below each BroadcastExchange."""
    lines = plan.splitlines()
    depth = [next((i for i, c in enumerate(x) if c.isalnum() or c == "*"), 0) for x in lines]
    out = []
    for i, x in enumerate(lines):
        if "BroadcastExchange" in x:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            out.append("\n".join(lines[i:end]))
    return out


@pytest.mark.parametrize("name", QUERIES)
def test_no_rows_of_the_orders_are_broadcast(spark, tables, name):
    before = spark.conf.get(BROADCAST_CONF)
    try:
        spark.conf.set(BROADCAST_CONF, "10485760b")  # Spark's default
        plan = __spark_entry__.queries()[name](spark, tables)._jdf.queryExecution().executedPlan().toString()
        assert "Generate" in plan
        assert not [x for x in _broadcast(plan) if "Generate" in x or "o_orderkey" in x]
    finally:
        spark.conf.set(BROADCAST_CONF, before)


def test_floors_are_joined_without_sorting_the_grid(spark, tables):
    plan = __spark_entry__.queries()["key_stats_multi"](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
