"""Scenario grids and side tables derived from the benchmark tables.

The benchmark ships TPC-H-like tables, not rate grids; these builders map
them onto the grid schema so every operator runs on data that grows with the
scale factor.  Everything is a lazy DataFrame over the Parquet files.

* ``dense_grid``: every order x steps -8..8 (a complete grid, unique steps).
* ``gappy_grid``: the dense grid with nulls and NaN derived from order
  attributes (missing value, probability and rate cells).
* ``natural_grid``: line items as steps of their order; keys may lack a
  lead row, repeat a step and share rates (ties).
* ``product_table`` / ``floor_table``: per-order side tables; some orders have
  no row (so left joins leave unmatched keys).
* ``offers_table``: orders as offers of their customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEPS = 8  # dense grid steps -STEPS..STEPS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rate_columns(df: DataFrame) -> DataFrame:
    t = F.col("tasa_propuesta")
    m = F.col("mtofinalofertadosol")
    df = df.withColumn("prob_adj_ef", F.greatest(F.lit(0.01), F.lit(0.9) - F.lit(1.2) * t))
    p = F.col("prob_adj_ef")
    return df.withColumns(
        {
            "van": m * (t - F.lit(0.08)),
            "roa": m * F.lit(0.01) * (t - F.lit(0.05)),
            "avg_balance": m * F.lit(0.6),
        }
    ).withColumn("roa_saldo", F.col("roa") * p)


def dense_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order and step -8..8.

    ``tasa_propuesta = 0.10 + (orderkey % 40)/100 + iter*0.005``,
    ``prob_adj_ef = greatest(0.01, 0.9 - 1.2*tasa)``, ``van = mto*(tasa-0.08)``,
    ``roa = mto*0.01*(tasa-0.05)``, ``avg_balance = mto*0.6``,
    ``roa_saldo = roa*prob_adj_ef``; segment ``1 + custkey % 7``,
    risk score ``300 + orderkey % 120``.
    """
    return _rate_columns(_with_steps(_order_columns(spark, sf_dir)))


def _order_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: what the dense grid repeats at every step."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("int").alias("codmes"),
        (F.lit(1) + F.col("o_custkey") % 7).cast("int").alias("seg_wtp_cef"),
        (F.lit(300) + k % 120).cast("int").alias("numscoreriesgo"),
        F.col("o_custkey").alias("codclavecic"),
        k.cast("string").alias("llave"),
        F.col("o_totalprice").alias("mtofinalofertadosol"),
        (k % 40).alias("_band"),
    )


def _with_steps(orders: DataFrame) -> DataFrame:
    """Every row at each step, with its rate."""
    g = orders.withColumn("iter", F.explode(F.sequence(F.lit(-STEPS), F.lit(STEPS))))
    return g.withColumn(
        "tasa_propuesta", F.lit(0.10) + F.col("_band") / F.lit(100) + F.col("iter") * F.lit(0.005)
    ).drop("_band")


def gappy_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense grid with missing cells derived from order attributes:
    ``van`` is null for status 'P' orders at steps >= 5, ``prob_adj_ef`` is
    NaN for priority '4-NOT SPECIFIED' at steps <= -6, and ``tasa_propuesta``
    is null for priority '1-URGENT' at step 7.

    The attributes are joined to the orders, before these are repeated per step."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("llave"), "o_orderstatus", "o_orderpriority"
    )
    return _gaps(_order_columns(spark, sf_dir).join(o, on="llave", how="inner"))


def _gaps(orders: DataFrame) -> DataFrame:
    """Orders with their status and priority as a grid with missing cells."""
    it = F.col("iter")
    return _rate_columns(_with_steps(orders)).withColumns(
        {
            "van": F.when((F.col("o_orderstatus") == "P") & (it >= 5), F.lit(None).cast("double")).otherwise(
                F.col("van")
            ),
            "prob_adj_ef": F.when(
                (F.col("o_orderpriority") == "4-NOT SPECIFIED") & (it <= -6), F.lit(float("nan"))
            ).otherwise(F.col("prob_adj_ef")),
            "tasa_propuesta": F.when(
                (F.col("o_orderpriority") == "1-URGENT") & (it == 7), F.lit(None).cast("double")
            ).otherwise(F.col("tasa_propuesta")),
        }
    ).drop("o_orderstatus", "o_orderpriority")


def gappy_lead_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gappy grid with missing cells in lead rows too: at step 0 ``prob_adj_ef``
    is NaN for priority '2-HIGH', ``van`` is null for priority '3-MEDIUM' and NaN for
    '4-NOT SPECIFIED', ``tasa_propuesta`` is null for '1-URGENT'; orders whose key is a
    multiple of 5 have no ``van`` at any step (all-null keys), of 7 a NaN at step 1."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_k"),
                                              F.col("o_orderkey").cast("string").alias("llave"),
                                              "o_orderstatus", "o_orderpriority")
    other = o.select("llave", F.col("_k"), F.col("o_orderpriority").alias("_p"))
    g = _gaps(_order_columns(spark, sf_dir).join(o.drop("_k"), on="llave", how="inner").join(other, on="llave", how="inner"))
    nan, none, p, lead = F.lit(float("nan")), F.lit(None).cast("double"), F.col("_p"), F.col("iter") == 0
    van = (F.when((F.col("_k") % 5 == 0) | (lead & (p == "3-MEDIUM")), none)
           .when((lead & (p == "4-NOT SPECIFIED")) | ((F.col("_k") % 7 == 0) & (F.col("iter") == 1)), nan)
           .otherwise(F.col("van")))
    return g.withColumns({
        "van": van,
        "prob_adj_ef": F.when(lead & (p == "2-HIGH"), nan).otherwise(F.col("prob_adj_ef")),
        "tasa_propuesta": F.when(lead & (p == "1-URGENT"), none).otherwise(F.col("tasa_propuesta")),
    }).drop("_k", "_p")


def natural_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the steps ``linenumber - 4`` of their order.

    ``llave = orderkey``, ``codclavecic = orderkey``, ``tasa = discount``,
    ``mto = extendedprice``, ``prob = 0.9 - 5*discount``,
    ``van = mto*(discount - 0.02)``, segment 1 (no cap applies).
    """
    li = table(spark, sf_dir, "lineitem")
    d = F.col("l_discount")
    return li.select(
        F.lit(1).alias("seg_wtp_cef"),
        F.col("l_orderkey").alias("codclavecic"),
        F.col("l_orderkey").cast("string").alias("llave"),
        F.col("l_extendedprice").alias("mtofinalofertadosol"),
        (F.col("l_linenumber") - F.lit(4)).cast("int").alias("iter"),
        d.alias("tasa_propuesta"),
        (F.lit(0.9) - F.lit(5.0) * d).alias("prob_adj_ef"),
        (F.col("l_extendedprice") * (d - F.lit(0.02))).alias("van"),
    )


def hot_key_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line-item grid with every returned item (flag 'R', a third of all
    rows) under one offer key 'R': a single key holding a third of the data."""
    flag = table(spark, sf_dir, "lineitem")
    return flag.select(
        F.lit(1).alias("seg_wtp_cef"),
        F.col("l_orderkey").alias("codclavecic"),
        F.when(F.col("l_returnflag") == "R", F.lit("R")).otherwise(F.col("l_orderkey").cast("string")).alias("llave"),
        F.col("l_extendedprice").alias("mtofinalofertadosol"),
        (F.col("l_linenumber") - F.lit(4)).cast("int").alias("iter"),
        F.col("l_discount").alias("tasa_propuesta"),
        (F.lit(0.9) - F.lit(5.0) * F.col("l_discount")).alias("prob_adj_ef"),
        (F.col("l_extendedprice") * (F.col("l_discount") - F.lit(0.02))).alias("van"),
    )


def product_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product attributes per order: subsegment = customer market segment.
    Orders of priority '5-LOW' have no product row."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    return (
        o.where(F.col("o_orderpriority") != "5-LOW")
        .join(c, o.o_custkey == c.c_custkey, "inner")
        .select(
            F.col("o_custkey").alias("codclavecic"),
            F.col("o_orderkey").cast("string").alias("llave"),
            F.col("c_mktsegment").alias("flg_subsegmento_consumo"),
            (F.lit(0.10) + (F.col("o_orderkey") % 40) / F.lit(100) + F.lit(0.0123)).alias("tasa_objetivo"),
        )
    )


def floor_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimum rate per order ``0.12 + (orderkey % 5)/50``; orders of priority
    '1-URGENT' have none."""
    o = table(spark, sf_dir, "orders")
    return o.where(F.col("o_orderpriority") != "1-URGENT").select(
        F.col("o_orderkey").cast("string").alias("llave"),
        (F.lit(0.12) + (F.col("o_orderkey") % 5) / F.lit(50)).alias("tasapropuestamin"),
    )


def offers_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as offers of their customer: amount = total price, lot = order
    month (yyyymm), sale type = priority digit (1..5), offer type = order
    status (F=1, O=2, P=3)."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("codclavecic"),
        F.col("o_orderkey").alias("codoferta"),
        (F.lit(0.10) + (F.col("o_orderkey") % 40) / F.lit(100)).alias("pcttasaofertada"),
        F.col("o_totalprice").alias("mtofinalofertadosol"),
        (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("int").alias("codloteoferta"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("tipventa"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2)
        .when(F.col("o_orderstatus") == "P", 3).cast("int").alias("tipoferta"),
    )
