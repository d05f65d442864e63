"""Caps, rate bands (three-valued and two-valued), floors, score filter."""

import pytest
from pyspark.sql import functions as F

from rategrid.operators.limits import cap_iterations, rate_band, rate_floor, score_filter
from rategrid.rules import Band

BANDS = (Band("S1", 0.145, 0.959), Band("S4", 0.235, 0.959), Band("S6", 0.125, 0.199))

RATES = [0.01, 0.15, 0.21, 0.30, 0.97, None]


@pytest.fixture(scope="module")
def banded(spark):
    rows = []
    for flag in [None, "UNLISTED", "S1"]:
        for i, r in enumerate(RATES):
            rows.append((f"{flag}-{i}", flag, r))
    return spark.createDataFrame(rows, "llave string, flg_subsegmento_consumo string, tasa_propuesta double")


def kept(df):
    return {(r.flg_subsegmento_consumo, r.tasa_propuesta) for r in df.collect()}


def test_band_drop_three_valued(banded):
    got = kept(rate_band(banded, BANDS, unmatched="drop"))
    # no product match: always dropped; unlisted flag: always kept (also with a null rate)
    assert not any(f is None for f, _ in got)
    assert {r for f, r in got if f == "UNLISTED"} == set(RATES)
    # first listed flag (0.145 .. 0.959): inside kept, outside and null rate dropped
    assert {r for f, r in got if f == "S1"} == {0.15, 0.21, 0.30}


def test_band_keep_two_valued(banded):
    got = kept(rate_band(banded, BANDS, unmatched="keep"))
    assert {r for f, r in got if f is None} == set(RATES)
    assert {r for f, r in got if f == "UNLISTED"} == set(RATES)
    assert {r for f, r in got if f == "S1"} == {0.15, 0.21, 0.30, None}


def test_bands_are_required(banded):
    with pytest.raises(ValueError):
        rate_band(banded, ())


def test_when_rows_without_flag_always_fail(banded):
    from rategrid.operators.limits import bands_need_flag

    assert bands_need_flag(BANDS)
    loose = (Band("S1", 0.1, 0.9), Band("S2", 0.2, None))
    assert not bands_need_flag(loose)
    assert (None, 0.30) in kept(rate_band(banded, loose))


def test_enrich_dedupe_is_deterministic(spark):
    from rategrid.operators.limits import enrich

    g = spark.createDataFrame([("a", 1), ("b", 2)], "llave string, x int")
    side = spark.createDataFrame([("a", "z", 2), ("a", "y", 1), ("a", "x", 3)], "llave string, flg_subsegmento_consumo string, o int")
    rows = {r.llave: r.flg_subsegmento_consumo for r in enrich(g, side, dedupe=["o"]).collect()}
    assert rows == {"a": "y", "b": None}


def test_band_is_idempotent(banded):
    once = rate_band(banded, BANDS)
    assert kept(rate_band(once, BANDS)) == kept(once)


def test_caps(spark):
    rows = [(seg, it) for seg in [None, 0, 1, 4, 7, 8] for it in range(-9, 10)]
    g = spark.createDataFrame(rows, "seg_wtp_cef int, iter int")
    got = {(r.seg_wtp_cef, r.iter) for r in cap_iterations(g).collect()}
    expect = {(seg, it) for seg, it in rows if seg in (1, 4, 7) and abs(it) <= 9 - seg}
    assert got == expect


def test_caps_never_widen(spark):
    g = spark.createDataFrame([(s, i) for s in range(1, 8) for i in range(-8, 9)], "seg_wtp_cef int, iter int")
    capped = cap_iterations(g)
    assert capped.count() <= g.count()
    assert cap_iterations(capped).count() == capped.count()


def test_floor_and_score(spark):
    g = spark.createDataFrame([("a", 0.10, 400), ("a", 0.20, 300), ("b", 0.30, 360), ("c", None, 500)],
                              "llave string, tasa_propuesta double, numscoreriesgo int")
    floors = spark.createDataFrame([("a", "0.15"), ("c", "0.1")], "llave string, tasapropuestamin string")
    got = {(r.llave, r.tasa_propuesta) for r in rate_floor(g, floors).collect()}
    assert got == {("a", 0.20)}  # b has no floor, c has a null rate
    assert {r.llave for r in score_filter(g).collect()} == {"a", "b", "c"}
    assert score_filter(g).count() == 3
