"""Column names of the scenario grid and its companion tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class GridColumns:
    """Names of the grid columns the operators read (all lower case)."""

    key: str = "llave"
    client: str = "codclavecic"
    step: str = "iter"
    rate: str = "tasa_propuesta"
    amount: str = "mtofinalofertadosol"
    prob: str = "prob_adj_ef"
    segment: str = "seg_wtp_cef"
    score: str = "numscoreriesgo"
    subsegment: str = "flg_subsegmento_consumo"
    expected_amount: str = "mto_estimado"
    month: str = "codmes"


COLS = GridColumns()

# Full grid schema (one row per offer and rate step).
GRID_SCHEMA = T.StructType(
    [
        T.StructField("codmes", T.IntegerType()),
        T.StructField("campana", T.StringType()),
        T.StructField("seg_wtp_cef", T.IntegerType()),
        T.StructField("numscoreriesgo", T.IntegerType()),
        T.StructField("codsubsegmento", T.StringType()),
        T.StructField("codclavecic", T.LongType()),
        T.StructField("llave", T.StringType()),
        T.StructField("mtofinalofertadosol", T.DoubleType()),
        T.StructField("rng_prob", T.StringType()),
        T.StructField("num_sen", T.DoubleType()),
        T.StructField("iter", T.IntegerType()),
        T.StructField("tasa_propuesta", T.DoubleType()),
        T.StructField("prob_adj", T.DoubleType()),
        T.StructField("prob", T.DoubleType()),
        T.StructField("van", T.DoubleType()),
        T.StructField("van_estimado", T.DoubleType()),
        T.StructField("mto_estimado", T.DoubleType()),
        T.StructField("ec_efect_i", T.DoubleType()),
        T.StructField("b0", T.DoubleType()),
        T.StructField("b1", T.DoubleType()),
        T.StructField("prob_adj_ef", T.DoubleType()),
    ]
)

# Grid of the multi-indicator pipeline.
MULTI_GRID_SCHEMA = T.StructType(
    GRID_SCHEMA.fields + [T.StructField(c, T.DoubleType()) for c in ("roa", "avg_balance", "roa_saldo")]
)

# Product attributes per offer (CSV with header).
PRODUCT_SCHEMA = T.StructType(
    [
        T.StructField("codclavecic", T.LongType()),
        T.StructField("campana", T.StringType()),
        T.StructField("tasapropuesta", T.DoubleType()),
        T.StructField("llave", T.StringType()),
        T.StructField("flg_subsegmento_consumo", T.StringType()),
        T.StructField("desembolso", T.LongType()),
        T.StructField("plazo", T.LongType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("mtomejoringresoajustadosol", T.DoubleType()),
        T.StructField("flg_indicator_target", T.StringType()),
        T.StructField("indicator_target", T.DoubleType()),
        T.StructField("tipcampana_ori", T.StringType()),
        T.StructField("tipo_iniciativa", T.StringType()),
    ]
)

# Minimum rate per offer (CSV with header).
FLOOR_SCHEMA = T.StructType(
    [
        T.StructField("llave", T.StringType()),
        T.StructField("tasapropuestamin", T.DoubleType()),
    ]
)

# Offers per client (feeds the top-offer selection).
OFFERS_SCHEMA = T.StructType(
    [
        T.StructField("codclavecic", T.LongType()),
        T.StructField("pcttasaofertada", T.DoubleType()),
        T.StructField("mtofinalofertadosol", T.DoubleType()),
        T.StructField("codloteoferta", T.IntegerType()),
        T.StructField("tipventa", T.IntegerType()),
        T.StructField("tipoferta", T.IntegerType()),
    ]
)
