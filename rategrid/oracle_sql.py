"""ANSI SQL (DuckDB dialect) equivalents of the registered queries.

These are the correctness oracle: the same grids built from the benchmark
tables, and the selection written the way the original job states it (per
exponent, candidates by decimal(32,10) equality, recovery by a distinct rows
join with its real fan-out).  Double literals are written as
``CAST('…' AS DOUBLE)`` so both engines compute in binary floating point.
"""

from __future__ import annotations

# The rules' values are written out here, not imported, so a wrong value in the
# library shows up as a difference.  Fixed values of the original job:
CAP_STEPS = ((1, 8), (2, 7), (3, 6), (4, 5), (5, 4), (6, 3), (7, 2))
EXPONENTS = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5,
             5.0, 5.5, 6.0, 6.5, 7.0, 7.5, 8.0, 8.5, 9.0, 9.5)
BUCKETS = ((5000.0, '1.[-;5k>'),
           (8000.0, '2.[5k;8k>'),
           (12000.0, '3.[8k;12k>'),
           (18000.0, '4.[12k;18k>'),
           (30000.0, '5.[18k;30k>'),
           (50000.0, '6.[30k;50k>'),
           (80000.0, '7.[50k;80k>'),
           (120000.0, '8.[80k;120k>'),
           (None, '9.[120k;+>'))
RATE_CEILING = 0.959
MIN_SCORE = 360
BINS = 60
# Parameters of the registered queries:
BANDS = (("AUTOMOBILE", 0.145, 0.959), ("BUILDING", 0.235, 0.959), ("FURNITURE", 0.135, 0.429),
         ("HOUSEHOLD", 0.125, 0.199))
SINGLE = ("van",)
MULTI = ("roa", "avg_balance", "roa_saldo")
MULTI_TARGET = "roa_saldo"
EXP_SINGLE = 2.5
EXP_MULTI = 2.0
NATURAL_EXP = 2.5
PANDAS_EXP = 0.5
SAMPLE_KEYS = 1000
PREVIEW_ROWS = 100
LOT_SALE_TYPE = 1
LOT_OFFER_TYPE = 1
STEPS = 8
# Rounding of aggregated doubles, as the queries round:
AMOUNT_DIGITS = 0
RATIO_DIGITS = 9
PCT_DIGITS = 6
SCORE_DIGITS = 4
NATURAL_DIGITS = {"oferta": 3, "prob_": 3, "tasa_": 3, "mto_": 5, "van_": 7}


def D(x) -> str:
    """Double literal."""
    return f"CAST('{x}' AS DOUBLE)"


def fill(x: str) -> str:
    """Null and NaN -> 0 (``fillna(0)`` on a double)."""
    return f"(CASE WHEN {x} IS NULL OR isnan({x}) THEN {D(0)} ELSE {x} END)"


def nan0(x: str) -> str:
    """NaN -> 0, null stays null."""
    return f"(CASE WHEN isnan({x}) THEN {D(0)} ELSE {x} END)"


def div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN NULL ELSE ({a}) / ({b}) END)"


def dec(x: str) -> str:
    return f"TRY_CAST({x} AS DECIMAL(32,10))"


def rnd(x: str, digits: int) -> str:
    """Round; adding zero turns a negative zero into zero, as Spark's round gives."""
    return f"(round({x}, {digits}) + {D(0)})"


# ---------------------------------------------------------------------------
# Grids
# ---------------------------------------------------------------------------

DENSE = f"""
dense AS (
  SELECT CAST(1 + o_custkey % 7 AS INTEGER) AS seg_wtp_cef,
         CAST(300 + o_orderkey % 120 AS INTEGER) AS numscoreriesgo,
         o_custkey AS codclavecic,
         CAST(o_orderkey AS VARCHAR) AS llave,
         o_totalprice AS mtofinalofertadosol,
         CAST(s.i AS INTEGER) AS iter,
         {D(0.10)} + (o_orderkey % 40) / {D(100)} + CAST(s.i AS INTEGER) * {D(0.005)} AS tasa_propuesta
  FROM orders CROSS JOIN range(-{STEPS}, {STEPS + 1}) AS s(i)
),
dense_p AS (
  SELECT *, greatest({D(0.01)}, {D(0.9)} - {D(1.2)} * tasa_propuesta) AS prob_adj_ef FROM dense
),
dense_v AS (
  SELECT *, mtofinalofertadosol * (tasa_propuesta - {D(0.08)}) AS van,
            mtofinalofertadosol * {D(0.01)} * (tasa_propuesta - {D(0.05)}) AS roa,
            mtofinalofertadosol * {D(0.6)} AS avg_balance
  FROM dense_p
),
grid AS (
  SELECT *, roa * prob_adj_ef AS roa_saldo FROM dense_v
)"""


def expected_cols(inds) -> str:
    cols = [f"{i} * prob_adj_ef AS {i}_estimado" for i in inds]
    cols.append("mtofinalofertadosol * prob_adj_ef AS mto_estimado")
    return ", ".join(cols)


PRODUCT = f"""
product AS (
  SELECT o.o_custkey AS codclavecic, CAST(o.o_orderkey AS VARCHAR) AS llave,
         c.c_mktsegment AS flg_subsegmento_consumo,
         {D(0.10)} + (o.o_orderkey % 40) / {D(100)} + {D(0.0123)} AS tasa_objetivo
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  WHERE o.o_orderpriority <> '5-LOW'
)"""

FLOOR = f"""
floors AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS llave, {D(0.12)} + (o_orderkey % 5) / {D(50)} AS tasapropuestamin
  FROM orders WHERE o_orderpriority <> '1-URGENT'
)"""

CAPS = " OR ".join(f"(seg_wtp_cef = {k} AND iter >= {-c} AND iter <= {c})" for k, c in CAP_STEPS)


def band_terms() -> list[str]:
    out = []
    for flag, lo, hi in BANDS:
        out.append(f"(tasa_propuesta < {D(lo)} AND flg_subsegmento_consumo = '{flag}')")
        out.append(f"(tasa_propuesta > {D(hi)} AND flg_subsegmento_consumo = '{flag}')")
    return out


BAND_DROP = "NOT (" + " OR ".join(band_terms()) + ")"
BAND_KEEP = "NOT (" + " OR ".join(f"coalesce({t}, false)" for t in band_terms()) + ")"

G_SINGLE = f"g_single AS (SELECT *, {expected_cols(SINGLE)} FROM grid)"


def capped_single(mode: str = "drop") -> str:
    band = BAND_DROP if mode == "drop" else BAND_KEEP
    return f"""
capped AS (
  SELECT g.*, p.flg_subsegmento_consumo
  FROM (SELECT * FROM g_single WHERE {CAPS}) g
  LEFT JOIN product p ON g.llave = p.llave
  WHERE {band}
)"""


G_MULTI = f"""
g_multi AS (SELECT *, {expected_cols(MULTI)} FROM grid WHERE numscoreriesgo >= {MIN_SCORE})"""

CAPPED_MULTI = """
capped AS (
  SELECT g.*, f.tasapropuestamin FROM g_multi g JOIN floors f ON g.llave = f.llave
  WHERE g.tasa_propuesta >= f.tasapropuestamin
)"""

NATURAL = f"""
natural_grid AS (
  SELECT CAST(1 AS INTEGER) AS seg_wtp_cef, l_orderkey AS codclavecic, CAST(l_orderkey AS VARCHAR) AS llave,
         l_extendedprice AS mtofinalofertadosol, CAST(l_linenumber - 4 AS INTEGER) AS iter,
         l_discount AS tasa_propuesta, {D(0.9)} - {D(5.0)} * l_discount AS prob_adj_ef,
         l_extendedprice * (l_discount - {D(0.02)}) AS van
  FROM lineitem
),
capped AS (SELECT *, {expected_cols(SINGLE)} FROM natural_grid)"""

HOT = NATURAL.replace("CAST(l_orderkey AS VARCHAR) AS llave",
                      "CASE WHEN l_returnflag = 'R' THEN 'R' ELSE CAST(l_orderkey AS VARCHAR) END AS llave")


def weighted_tradeoff_sql(base_ctes, inds, target, baseline_where: str, baseline_src: str,
                          exps=EXPONENTS) -> str:
    """Trade-off with the recovery's repetition as a weight (``copies`` =
    distinct (client, step) tuples at the chosen rate) instead of the
    repeated rows: for fixtures where one key holds a large share of rows."""
    sums = ", ".join(f"sum({nan0(f'{i}_estimado')}) AS s_{i}" for i in inds)
    per = ", ".join(f"sum(s_{i} * copies) AS {i}_estimado_e" for i in inds)
    return w(*base_ctes, exps_cte(exps), picks_ctes("capped", inds, target, "ex.exp", "min", True, False)) + f""",
grp AS (
  SELECT llave, tasa_propuesta, count(DISTINCT (codclavecic, iter)) AS copies,
         sum(prob_adj_ef) AS s_prob, count(prob_adj_ef) AS n_prob, sum(tasa_propuesta) AS s_rate,
         count(tasa_propuesta) AS n_rate, sum(tasa_propuesta * mtofinalofertadosol) AS s_ra,
         sum(mtofinalofertadosol) AS s_a, sum(mto_estimado) AS s_mto, {sums}
  FROM capped WHERE llave IS NOT NULL AND tasa_propuesta IS NOT NULL GROUP BY llave, tasa_propuesta),
hit AS (SELECT pk.exp, grp.* FROM pk JOIN grp ON pk.llave = grp.llave AND pk.tasa_of_1 = grp.tasa_propuesta),
es AS (
  SELECT exp, {div('sum(s_prob * copies)', 'sum(n_prob * copies)')} AS prob_e,
         {div('sum(s_rate * copies)', 'sum(n_rate * copies)')} AS tasa_cli_e,
         {div('sum(s_ra * copies)', 'sum(s_a * copies)')} AS tasa_pnd_e,
         sum(s_mto * copies) AS mto_estimado_e, {per}
  FROM hit GROUP BY exp),
b AS (SELECT {portfolio_raw(inds)} FROM {baseline_src} WHERE {baseline_where}),
e2 AS (SELECT ex.exp, es.* EXCLUDE (exp) FROM ex LEFT JOIN es ON ex.exp = es.exp)
SELECT {tradeoff_select(inds)} FROM b CROSS JOIN e2 e"""


GAPPY = f"""
gappy AS (
  SELECT g.llave, g.iter, g.seg_wtp_cef, g.codclavecic, g.mtofinalofertadosol,
         CASE WHEN o.o_orderpriority = '1-URGENT' AND g.iter = 7 THEN NULL ELSE g.tasa_propuesta END AS tasa_propuesta,
         CASE WHEN o.o_orderpriority = '4-NOT SPECIFIED' AND g.iter <= -6 THEN CAST('NaN' AS DOUBLE)
              ELSE g.prob_adj_ef END AS prob_adj_ef,
         CASE WHEN o.o_orderstatus = 'P' AND g.iter >= 5 THEN NULL ELSE g.van END AS van
  FROM grid g JOIN orders o ON g.llave = CAST(o.o_orderkey AS VARCHAR)
)"""


# the gappy grid with missing cells in lead rows and all-null keys
GAPPY_LEAD = """
gappy_lead AS (
  SELECT g.llave, g.iter, g.seg_wtp_cef, g.codclavecic, g.mtofinalofertadosol,
         CASE WHEN g.iter = 0 AND o.o_orderpriority = '1-URGENT' THEN NULL ELSE g.tasa_propuesta END AS tasa_propuesta,
         CASE WHEN g.iter = 0 AND o.o_orderpriority = '2-HIGH' THEN CAST('NaN' AS DOUBLE) ELSE g.prob_adj_ef END AS prob_adj_ef,
         CASE WHEN o.o_orderkey % 5 = 0 OR (g.iter = 0 AND o.o_orderpriority = '3-MEDIUM') THEN NULL
              WHEN (g.iter = 0 AND o.o_orderpriority = '4-NOT SPECIFIED') OR (o.o_orderkey % 7 = 0 AND g.iter = 1)
              THEN CAST('NaN' AS DOUBLE) ELSE g.van END AS van
  FROM gappy g JOIN orders o ON g.llave = CAST(o.o_orderkey AS VARCHAR)
)"""


def skip(x: str) -> str:
    """NaN -> null, so aggregates skip it."""
    return f"(CASE WHEN isnan({x}) THEN NULL ELSE {x} END)"


HOT_TARGETS = f"""
targets AS (
  SELECT llave, {D(0.01)} * length(llave) AS tasa_objetivo, {D(0.005)} * length(llave) AS tasapropuestamin,
         'F' || CAST(length(llave) AS VARCHAR) AS flg_subsegmento_consumo
  FROM (SELECT DISTINCT llave FROM natural_grid))"""


def w(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


SINGLE_CAPPED = (DENSE, G_SINGLE, PRODUCT, capped_single())
MULTI_CAPPED = (DENSE, G_MULTI, FLOOR, CAPPED_MULTI)


def round_cols(cols, digits) -> str:
    return ", ".join(f"{rnd(c, digits)} AS {c}" for c in cols)


# ---------------------------------------------------------------------------
# Portfolio summaries
# ---------------------------------------------------------------------------

def portfolio_select(inds, suffix: str = "", counts: bool = True) -> str:
    parts = []
    if counts:
        parts += ["CAST(count(*) AS BIGINT) AS clientes",
                  f"{rnd('sum(mtofinalofertadosol)', AMOUNT_DIGITS)} AS oferta"]
    parts += [
        f"{rnd('avg(prob_adj_ef)', RATIO_DIGITS)} AS prob{suffix}",
        f"{rnd('avg(tasa_propuesta)', RATIO_DIGITS)} AS tasa_cli{suffix}",
        f"{rnd(div('sum(tasa_propuesta * mtofinalofertadosol)', 'sum(mtofinalofertadosol)'), RATIO_DIGITS)}"
        f" AS tasa_pnd{suffix}",
        f"{rnd('sum(mto_estimado)', AMOUNT_DIGITS)} AS mto_estimado{suffix}",
    ]
    parts += [f"{rnd(f'sum({nan0(f"{i}_estimado")})', AMOUNT_DIGITS)} AS {i}_estimado{suffix}" for i in inds]
    return ", ".join(parts)


def portfolio_raw(inds, suffix: str = "", counts: bool = True) -> str:
    """Unrounded portfolio aggregates (inputs of differences)."""
    parts = []
    if counts:
        parts += ["CAST(count(*) AS BIGINT) AS clientes", "sum(mtofinalofertadosol) AS oferta"]
    parts += [
        f"avg(prob_adj_ef) AS prob{suffix}",
        f"avg(tasa_propuesta) AS tasa_cli{suffix}",
        f"{div('sum(tasa_propuesta * mtofinalofertadosol)', 'sum(mtofinalofertadosol)')} AS tasa_pnd{suffix}",
        f"sum(mto_estimado) AS mto_estimado{suffix}",
    ]
    parts += [f"sum({nan0(f'{i}_estimado')}) AS {i}_estimado{suffix}" for i in inds]
    return ", ".join(parts)


def tradeoff_select(inds) -> str:
    """Final projection of a trade-off table from ``b`` (baseline) and ``e`` (scenario)."""
    metrics = [("prob", "prob_e", "prob", RATIO_DIGITS), ("tasa_cli", "tasa_cli_e", "t_cli", RATIO_DIGITS),
               ("tasa_pnd", "tasa_pnd_e", "t_pnd", RATIO_DIGITS),
               ("mto_estimado", "mto_estimado_e", "mto_est", AMOUNT_DIGITS)]
    metrics += [(f"{i}_estimado", f"{i}_estimado_e", f"{i}_est", AMOUNT_DIGITS) for i in inds]
    parts = ["b.clientes", f"{rnd('b.oferta', AMOUNT_DIGITS)} AS oferta"]
    for base, sc, _, d in metrics:
        parts.append(f"{rnd(f'b.{base}', d)} AS {base}")
        parts.append(f"{rnd(f'e.{sc}', d)} AS {sc}")
    parts.append("e.exp")
    for base, sc, short, d in metrics:
        parts.append(f"{rnd(f'e.{sc} - b.{base}', d)} AS dif_{short}")
    for base, sc, short, _ in metrics:
        parts.append(f"{rnd(div(f'e.{sc} - b.{base}', f'b.{base}'), PCT_DIGITS)} AS pct_{short}")
    return ", ".join(parts)


# ---------------------------------------------------------------------------
# Selection kernel (one exponent, or a table of exponents)
# ---------------------------------------------------------------------------

def picks_ctes(src: str, inds, target: str, exp_expr: str, tie: str, with_exp: bool, full: bool) -> str:
    """CTEs ``sc`` (filled scores), ``st`` (key stats) and ``pk`` (picks).

    ``exp_expr`` is the exponent (a literal or ``ex.exp`` when the source is
    crossed with the exponent table ``ex``)."""
    agg = "min" if tie == "min" else "sum"
    grp = "exp, llave" if with_exp else "llave"
    src_from = f"{src} CROSS JOIN ex" if with_exp else src
    exp_col = "ex.exp AS exp, " if with_exp else ""
    vals = ["tasa_propuesta", "mtofinalofertadosol", "prob_adj_ef", "mto_estimado"] + [f"{i}_estimado" for i in inds]
    sc = (f"sc AS (SELECT {exp_col}llave, coalesce(iter, 0) AS iter, "
          + ", ".join(f"{fill(v)} AS {v}" for v in vals)
          + f", {fill(f'{target} * pow(prob_adj_ef, {exp_expr})')} AS obj FROM {src_from})")
    st = (f"st AS (SELECT {grp}, "
          + ", ".join([f"max({i}_estimado) AS m_{i}, sum({i}_estimado) AS s_{i}" for i in inds])
          + f", max(obj) AS m_obj, sum(obj) AS s_obj FROM sc GROUP BY {grp})")
    on = "sc.exp = st.exp AND sc.llave = st.llave" if with_exp else "sc.llave = st.llave"

    def pick(value: str, score: str, best: str, total: str, decimal: bool = True) -> str:
        eq = f"{dec(f'sc.{score}')} = {dec(f'st.{best}')}" if decimal else f"sc.{score} = st.{best}"
        return (f"{agg}(CASE WHEN st.{total} = 0 AND sc.iter = 0 THEN sc.{value} "
                f"ELSE (CASE WHEN {eq} THEN sc.{value} END) END)")

    def lead(value: str) -> str:
        return f"sum(CASE WHEN sc.iter = 0 THEN sc.{value} END)"

    sr = (f"{target}_estimado", f"m_{target}", f"s_{target}")
    of = ("obj", "m_obj", "s_obj")
    if full:
        cols = [
            f"{lead('mtofinalofertadosol')} AS oferta",
            f"{lead('prob_adj_ef')} AS prob_lead",
            f"CAST({lead('iter')} AS BIGINT) AS iter_lead",
            f"CAST({pick('iter', *sr, decimal=False)} AS BIGINT) AS iter_sr",
            f"CAST({pick('iter', *of, decimal=False)} AS BIGINT) AS iter_of_1",
            f"{lead('tasa_propuesta')} AS tasa_lead",
            f"{pick('tasa_propuesta', *sr)} AS tasa_sr",
            f"{pick('tasa_propuesta', *of)} AS tasa_of_1",
            f"{lead('mto_estimado')} AS mto_lead",
            f"{pick('mto_estimado', *sr)} AS mto_sr",
            f"{pick('mto_estimado', *of)} AS mto_of_1",
        ]
        for i in inds:
            cols += [f"{lead(f'{i}_estimado')} AS {i}_lead", f"{pick(f'{i}_estimado', *sr)} AS {i}_sr",
                     f"{pick(f'{i}_estimado', *of)} AS {i}_of_1"]
    else:
        cols = [f"{pick('tasa_propuesta', *of)} AS tasa_of_1"]
    sel_grp = "sc.exp, sc.llave" if with_exp else "sc.llave"
    pk = f"pk AS (SELECT {sel_grp}, " + ", ".join(cols) + f" FROM sc LEFT JOIN st ON {on} GROUP BY {sel_grp})"
    return ",\n".join([sc, st, pk])


def exps_cte(exps) -> str:
    vals = ", ".join(f"({D(e)})" for e in exps)
    return f"ex AS (SELECT e AS exp FROM (VALUES {vals}) t(e))"


def recovery_ctes(with_exp: bool, distinct_cols: str) -> str:
    """``d``: distinct chosen (key, rate, …) tuples; ``e``: grid rows joined to
    them (the reference fan-out)."""
    if with_exp:
        d = (f"d AS (SELECT DISTINCT pk.exp, {distinct_cols} FROM capped c JOIN pk ON c.llave = pk.llave "
             "WHERE c.tasa_propuesta = pk.tasa_of_1)")
        e = ("e AS (SELECT d.exp, c.* FROM capped c JOIN d ON c.llave = d.llave "
             "AND c.tasa_propuesta = d.tasa_propuesta)")
    else:
        d = (f"d AS (SELECT DISTINCT {distinct_cols} FROM capped c JOIN pk ON c.llave = pk.llave "
             "WHERE c.tasa_propuesta = pk.tasa_of_1)")
        e = "e AS (SELECT c.* FROM capped c JOIN d ON c.llave = d.llave AND c.tasa_propuesta = d.tasa_propuesta)"
    return d + ",\n" + e


DISTINCT_SWEEP = "c.codclavecic, c.llave, c.tasa_propuesta, c.iter"
DISTINCT_CLIENT = "c.codclavecic, c.llave, c.tasa_propuesta"


def chosen_unique_sql(base_ctes, inds, target, exp, tie, copies_on: str) -> str:
    """Chosen rows, each once, with ``copies`` = distinct ``copies_on`` tuples
    among the key's rows at that rate."""
    vals = ", ".join(f"c.{i}_estimado" for i in inds)
    return w(*base_ctes, picks_ctes("capped", inds, target, D(exp), tie, False, False)) + f""",
hit AS (SELECT c.* FROM capped c JOIN pk ON c.llave = pk.llave AND c.tasa_propuesta = pk.tasa_of_1),
cp AS (SELECT llave, tasa_propuesta, CAST(count(DISTINCT ({copies_on})) AS BIGINT) AS copies
       FROM hit GROUP BY llave, tasa_propuesta)
SELECT c.llave, c.codclavecic, CAST(c.iter AS BIGINT) AS iter, c.tasa_propuesta, c.mtofinalofertadosol, {vals},
       cp.copies
FROM hit c JOIN cp ON c.llave = cp.llave AND c.tasa_propuesta = cp.tasa_propuesta"""


def best_rate_sql(base_ctes, inds, target, exp, tie, cols: str = "*") -> str:
    return w(*base_ctes, picks_ctes("capped", inds, target, D(exp), tie, False, True)) + f"\nSELECT {cols} FROM pk"


def tradeoff_sql(base_ctes, inds, target, baseline_where: str, baseline_src: str, exps=EXPONENTS) -> str:
    return w(*base_ctes, exps_cte(exps), picks_ctes("capped", inds, target, "ex.exp", "min", True, False),
             recovery_ctes(True, DISTINCT_SWEEP)) + f""",
b AS (SELECT {portfolio_raw(inds)} FROM {baseline_src} WHERE {baseline_where}),
es AS (SELECT exp, {portfolio_raw(inds, "_e", counts=False)} FROM e GROUP BY exp),
e2 AS (SELECT ex.exp, es.* EXCLUDE (exp) FROM ex LEFT JOIN es ON ex.exp = es.exp)
SELECT {tradeoff_select(inds)} FROM b CROSS JOIN e2 e"""


def bucket_expr(col: str) -> str:
    *bounded, (_, last) = BUCKETS
    whens = " ".join(f"WHEN {col} < {D(u)} THEN '{lab}'" for u, lab in bounded)
    return f"CASE {whens} ELSE '{last}' END"


def bucket_select(inds, suffix: str) -> str:
    parts = ["CAST(count(*) AS BIGINT) AS clientes",
             f"{rnd('sum(mtofinalofertadosol)', AMOUNT_DIGITS)} AS oferta",
             f"{rnd('avg(tasa_propuesta)', RATIO_DIGITS)} AS tasa_cli{suffix}",
             f"{rnd(div('sum(tasa_propuesta * mtofinalofertadosol)', 'sum(mtofinalofertadosol)'), RATIO_DIGITS)}"
             f" AS tasa_pnd{suffix}",
             f"{rnd('sum(mto_estimado)', AMOUNT_DIGITS)} AS mto_estimado{suffix}"]
    parts += [f"{rnd(f'sum({nan0(f"{i}_estimado")})', AMOUNT_DIGITS)} AS {i}_estimado{suffix}" for i in inds]
    parts.append(f"{rnd('avg(prob_adj_ef)', RATIO_DIGITS)} AS prob{suffix}")
    return ", ".join(parts)


FINAL_SINGLE = (*SINGLE_CAPPED, picks_ctes("capped", SINGLE, "van", D(EXP_SINGLE), "sum", False, False),
                recovery_ctes(False, DISTINCT_SWEEP))


def rate_change_ctes() -> str:
    return w(*FINAL_SINGLE) + """,
base AS (SELECT llave, tasa_propuesta AS tasa_base FROM g_single WHERE iter = 0),
rc AS (SELECT e.*, base.tasa_base, e.tasa_propuesta - base.tasa_base AS dif_tasa FROM e JOIN base ON e.llave = base.llave)"""


def histogram_sql() -> str:
    n = BINS
    return rate_change_ctes() + f""",
rng AS (SELECT min(dif_tasa) AS mn, max(dif_tasa) AS mx FROM rc),
bins AS (
  SELECT CASE WHEN rng.mx - rng.mn = 0 THEN CAST(1 AS BIGINT)
              ELSE least(CAST(floor({D(n)} * (rc.dif_tasa - rng.mn) / (rng.mx - rng.mn)) AS BIGINT) + 1,
                         CAST({n} AS BIGINT)) END AS bin
  FROM rc CROSS JOIN rng WHERE rc.dif_tasa IS NOT NULL
)
SELECT bins.bin, rng.mn + (bins.bin - 1) * ((rng.mx - rng.mn) / {D(n)}) AS lo,
       rng.mn + bins.bin * ((rng.mx - rng.mn) / {D(n)}) AS hi, CAST(count(*) AS BIGINT) AS n
FROM bins CROSS JOIN rng GROUP BY bins.bin, rng.mn, rng.mx"""


def rate_change_sql() -> str:
    return w(*SINGLE_CAPPED, picks_ctes("capped", SINGLE, "van", D(EXP_SINGLE), "sum", False, False)) + f""",
hit AS (SELECT c.* FROM capped c JOIN pk ON c.llave = pk.llave AND c.tasa_propuesta = pk.tasa_of_1),
cp AS (SELECT llave, tasa_propuesta, CAST(count(DISTINCT (codclavecic, iter)) AS BIGINT) AS copies
       FROM hit GROUP BY llave, tasa_propuesta),
base AS (SELECT llave, tasa_propuesta AS tasa_base, count(*) AS leads FROM g_single WHERE iter = 0 GROUP BY 1, 2)
SELECT h.llave, CAST(h.iter AS BIGINT) AS iter, h.tasa_propuesta, base.tasa_base,
       h.tasa_propuesta - base.tasa_base AS dif_tasa, CAST(cp.copies * base.leads AS BIGINT) AS copies
FROM hit h JOIN cp ON h.llave = cp.llave AND h.tasa_propuesta = cp.tasa_propuesta
JOIN base ON h.llave = base.llave"""


def rate_change_hot_sql() -> str:
    return w(HOT, picks_ctes("capped", SINGLE, "van", D(NATURAL_EXP), "min", False, False)) + """,
hit AS (SELECT c.* FROM capped c JOIN pk ON c.llave = pk.llave AND c.tasa_propuesta = pk.tasa_of_1),
cp AS (SELECT llave, tasa_propuesta, CAST(count(DISTINCT (codclavecic, iter)) AS BIGINT) AS copies
       FROM hit GROUP BY llave, tasa_propuesta),
base AS (SELECT llave, tasa_propuesta AS tasa_base, count(*) AS leads FROM capped WHERE iter = 0 GROUP BY 1, 2)
SELECT h.llave, h.codclavecic, CAST(h.iter AS BIGINT) AS iter, h.tasa_propuesta, h.mtofinalofertadosol, base.tasa_base,
       h.tasa_propuesta - base.tasa_base AS dif_tasa, CAST(cp.copies * base.leads AS BIGINT) AS copies
FROM hit h JOIN cp ON h.llave = cp.llave AND h.tasa_propuesta = cp.tasa_propuesta
JOIN base ON h.llave = base.llave"""


def key_stats_sql(base_ctes, inds, target, exp) -> str:
    cols = [f"max({i}_estimado) AS m_{i}_estimado" for i in inds]
    cols += [f"{rnd(f'sum({i}_estimado)', 8 if i == 'van' else SCORE_DIGITS)} AS s_{i}_estimado" for i in inds]
    cols += [f"{rnd('max(obj)', SCORE_DIGITS)} AS m_obj_funct_p_1",
             f"{rnd('sum(obj)', SCORE_DIGITS)} AS s_obj_funct_p_1"]
    inner = w(*base_ctes, picks_ctes("capped", inds, target, D(exp), "min", False, False))
    return inner + f"\nSELECT llave, {', '.join(cols)} FROM sc GROUP BY llave"


def best_cols(inds, digits: dict[str, int] | None = None) -> str:
    """Pick columns; ``digits`` rounds sums over repeated rows (prefix -> digits)."""
    names = ["oferta", "prob_lead", "iter_lead", "iter_sr", "iter_of_1", "tasa_lead", "tasa_sr", "tasa_of_1",
             "mto_lead", "mto_sr", "mto_of_1"]
    for i in inds:
        names += [f"{i}_lead", f"{i}_sr", f"{i}_of_1"]
    out = ["llave"]
    for n in names:
        d = None if digits is None else next((v for k, v in digits.items() if n.startswith(k)), None)
        out.append(n if d is None else f"{rnd(n, d)} AS {n}")
    return ", ".join(out)


def scenario_summary_sql(base_ctes, inds, target, exp) -> str:
    return w(*base_ctes, picks_ctes("capped", inds, target, D(exp), "min", False, False),
             recovery_ctes(False, DISTINCT_SWEEP)) + f"\nSELECT {portfolio_select(inds, '_e', counts=False)} FROM e"


def compare_one_sql() -> str:
    return w(*SINGLE_CAPPED, picks_ctes("capped", SINGLE, "van", D(EXP_SINGLE), "min", False, False),
             recovery_ctes(False, DISTINCT_SWEEP)) + f""",
b AS (SELECT {portfolio_raw(SINGLE)} FROM g_single WHERE iter = 0),
e1 AS (SELECT {portfolio_raw(SINGLE, "_e", counts=False)}, {D(EXP_SINGLE)} AS exp FROM e)
SELECT {tradeoff_select(SINGLE)} FROM b CROSS JOIN e1 e"""


PROFILE_TYPES = {
    "codmes": "int", "seg_wtp_cef": "int", "numscoreriesgo": "int", "codclavecic": "bigint", "llave": "string",
    "mtofinalofertadosol": "double", "iter": "int", "tasa_propuesta": "double", "prob_adj_ef": "double",
    "van": "double", "roa": "double", "avg_balance": "double", "roa_saldo": "double",
}


def profile_sql() -> str:
    whole = """
whole AS (
  SELECT g.* EXCLUDE (van, prob_adj_ef, tasa_propuesta), p.van, p.prob_adj_ef, p.tasa_propuesta,
         CAST(year(o.o_orderdate) * 100 + month(o.o_orderdate) AS INTEGER) AS codmes
  FROM grid g JOIN gappy p ON g.llave = p.llave AND g.iter = p.iter JOIN orders o ON g.llave = CAST(o.o_orderkey AS VARCHAR))"""
    parts = [f"SELECT '{c}' AS \"column\", '{t}' AS \"type\", CAST(count({c}) AS BIGINT) AS non_null, "
             f"CAST(count(DISTINCT {c}) AS BIGINT) AS \"distinct\", CAST(count(*) AS BIGINT) AS \"rows\" FROM whole"
             for c, t in PROFILE_TYPES.items()]
    return w(DENSE, GAPPY, whole) + "\n" + "\nUNION ALL\n".join(parts)


def _sql() -> dict[str, str]:
    s: dict[str, str] = {}
    s["expected_values"] = w(DENSE, G_SINGLE) + "\nSELECT llave, CAST(iter AS BIGINT) AS iter, van_estimado, mto_estimado FROM g_single"
    s["expected_values_multi"] = w(DENSE) + (
        f"\nSELECT llave, CAST(iter AS BIGINT) AS iter, {expected_cols(MULTI)} FROM grid")
    s["iteration_caps"] = w(DENSE, G_SINGLE) + (
        f"\nSELECT llave, CAST(iter AS BIGINT) AS iter, CAST(seg_wtp_cef AS BIGINT) AS seg_wtp_cef "
        f"FROM g_single WHERE {CAPS}")
    for mode in ("drop", "keep"):
        s[f"rate_band_{mode}"] = w(DENSE, G_SINGLE, PRODUCT, capped_single(mode)) + (
            "\nSELECT llave, CAST(iter AS BIGINT) AS iter, tasa_propuesta, flg_subsegmento_consumo FROM capped")
    s["rate_floor"] = w(DENSE, FLOOR) + (
        "\nSELECT g.llave, CAST(g.iter AS BIGINT) AS iter, g.tasa_propuesta, f.tasapropuestamin "
        "FROM grid g JOIN floors f ON g.llave = f.llave WHERE g.tasa_propuesta >= f.tasapropuestamin")
    s["score_filter"] = w(DENSE) + (
        f"\nSELECT llave, CAST(iter AS BIGINT) AS iter, CAST(numscoreriesgo AS BIGINT) AS numscoreriesgo "
        f"FROM grid WHERE numscoreriesgo >= {MIN_SCORE}")
    s["scenario_slice"] = w(DENSE, G_SINGLE) + (
        "\nSELECT llave, CAST(iter AS BIGINT) AS iter, tasa_propuesta, van_estimado FROM g_single WHERE iter = -8")
    s["conform_types"] = w(DENSE) + (
        "\nSELECT CAST(seg_wtp_cef AS BIGINT) AS seg_wtp_cef, CAST(numscoreriesgo AS BIGINT) AS numscoreriesgo, "
        "codclavecic, llave, mtofinalofertadosol, CAST(iter AS BIGINT) AS iter, tasa_propuesta, prob_adj_ef, van "
        "FROM grid")
    s["lead_summary"] = w(DENSE, G_SINGLE) + f"\nSELECT {portfolio_select(SINGLE)} FROM g_single WHERE iter = 0"
    s["lead_summary_ceiling"] = w(DENSE, G_MULTI, FLOOR, CAPPED_MULTI) + (
        f"\nSELECT {portfolio_select(MULTI)} FROM capped WHERE iter = 0 AND tasa_propuesta <= {D(RATE_CEILING)}")
    s["weighted_mean"] = w(DENSE) + (
        f"\nSELECT CAST(seg_wtp_cef AS BIGINT) AS seg_wtp_cef, "
        f"{rnd(div('sum(tasa_propuesta * mtofinalofertadosol)', 'sum(mtofinalofertadosol)'), RATIO_DIGITS)} "
        "AS tasa_pnd FROM grid WHERE iter = 0 GROUP BY seg_wtp_cef")
    s["nansum_variants"] = w(DENSE, GAPPY) + f""",
ge AS (SELECT *, van * prob_adj_ef AS van_estimado FROM gappy)
SELECT CAST(iter AS BIGINT) AS iter, CAST(CAST(van IS NULL AS INTEGER) AS BIGINT) AS van_missing,
       {rnd(f"sum({nan0('van_estimado')})", AMOUNT_DIGITS)} AS van_nansum,
       {rnd(f"coalesce(sum({fill('van_estimado')}), 0)", AMOUNT_DIGITS)} AS van_nansum_zero,
       CAST(count(*) AS BIGINT) AS n
FROM ge GROUP BY iter, van IS NULL"""
    s["column_profile"] = profile_sql()
    s["objective_values"] = w(*SINGLE_CAPPED) + (
        f"\nSELECT llave, CAST(iter AS BIGINT) AS iter, "
        f"{rnd(fill(f'van * pow(prob_adj_ef, {D(EXP_SINGLE)})'), SCORE_DIGITS)} AS obj_funct_p_1 FROM capped")
    pw = f"pow(prob_adj_ef, {D(EXP_SINGLE)})"
    s["objective_fill_variants"] = w(DENSE, GAPPY) + (
        f"\nSELECT llave, CAST(iter AS BIGINT) AS iter, {rnd(fill(f'van * {pw}'), SCORE_DIGITS)} AS obj_fill, "
        f"{rnd(f'van * coalesce(CASE WHEN isnan({pw}) THEN NULL ELSE {pw} END, {D(0)})', SCORE_DIGITS)} AS obj_pandas "
        "FROM gappy")
    s["key_stats"] = key_stats_sql(SINGLE_CAPPED, SINGLE, "van", EXP_SINGLE)
    s["key_stats_multi"] = key_stats_sql(MULTI_CAPPED, MULTI, MULTI_TARGET, EXP_MULTI)
    s["best_rate_min"] = best_rate_sql(SINGLE_CAPPED, SINGLE, "van", EXP_SINGLE, "min", best_cols(SINGLE))
    s["best_rate_sum"] = best_rate_sql(SINGLE_CAPPED, SINGLE, "van", EXP_SINGLE, "sum", best_cols(SINGLE))
    s["best_rate_multi"] = best_rate_sql(MULTI_CAPPED, MULTI, MULTI_TARGET, EXP_MULTI, "min", best_cols(MULTI))
    s["best_rate_natural_min"] = best_rate_sql((NATURAL,), SINGLE, "van", NATURAL_EXP, "min",
                                               best_cols(SINGLE, NATURAL_DIGITS))
    s["best_rate_natural_sum"] = best_rate_sql((NATURAL,), SINGLE, "van", NATURAL_EXP, "sum",
                                               best_cols(SINGLE, NATURAL_DIGITS))
    sr = "llave, iter_sr, tasa_sr, mto_sr, van_sr"
    s["sr_rate_min"] = best_rate_sql(SINGLE_CAPPED, SINGLE, "van", EXP_SINGLE, "min", sr)
    s["sr_rate_sum"] = best_rate_sql(SINGLE_CAPPED, SINGLE, "van", EXP_SINGLE, "sum", sr)
    lead_vals = ["mtofinalofertadosol", "prob_adj_ef", "iter", "tasa_propuesta", "mto_estimado", "van_estimado"]
    names = ["oferta", "prob_lead", "iter_lead", "tasa_lead", "mto_lead", "van_lead"]
    lead_sel = ", ".join(
        (f"CAST(sum(CASE WHEN iter = 0 THEN coalesce(iter, 0) END) AS BIGINT) AS {n}" if v == "iter"
         else f"sum(CASE WHEN iter = 0 THEN {fill(v)} END) AS {n}")
        for v, n in zip(lead_vals, names))
    s["lead_pivots"] = w(*SINGLE_CAPPED) + f"\nSELECT llave, {lead_sel} FROM capped GROUP BY llave"
    sweep_copies = "codclavecic, iter"
    s["chosen_rows_unique"] = chosen_unique_sql(SINGLE_CAPPED, SINGLE, "van", EXP_SINGLE, "min", sweep_copies)
    s["chosen_rows_natural_min"] = chosen_unique_sql((NATURAL,), SINGLE, "van", NATURAL_EXP, "min", sweep_copies)
    s["chosen_rows_natural_sum"] = chosen_unique_sql((NATURAL,), SINGLE, "van", NATURAL_EXP, "sum", sweep_copies)
    s["final_selection_single"] = chosen_unique_sql(SINGLE_CAPPED, SINGLE, "van", EXP_SINGLE, "sum", sweep_copies)
    s["final_selection_multi"] = chosen_unique_sql(MULTI_CAPPED, MULTI, MULTI_TARGET, EXP_MULTI, "sum", "codclavecic")
    s["scenario_summary"] = scenario_summary_sql(SINGLE_CAPPED, SINGLE, "van", EXP_SINGLE)
    s["scenario_summary_natural"] = scenario_summary_sql((NATURAL,), SINGLE, "van", NATURAL_EXP)
    s["compare_one"] = compare_one_sql()
    s["tradeoff_single"] = tradeoff_sql(SINGLE_CAPPED, SINGLE, "van", "iter = 0", "g_single")
    s["tradeoff_multi"] = tradeoff_sql(MULTI_CAPPED, MULTI, MULTI_TARGET,
                                       f"iter = 0 AND tasa_propuesta <= {D(RATE_CEILING)}", "capped")
    s["tradeoff_natural"] = tradeoff_sql((NATURAL,), SINGLE, "van", "iter = 0", "capped")
    s["best_rate_hot_key"] = best_rate_sql((HOT,), SINGLE, "van", NATURAL_EXP, "min",
                                           best_cols(SINGLE, NATURAL_DIGITS))
    s["chosen_rows_hot_key"] = chosen_unique_sql((HOT,), SINGLE, "van", NATURAL_EXP, "min", "codclavecic, iter")
    s["tradeoff_hot_key"] = weighted_tradeoff_sql((HOT,), SINGLE, "van", "iter = 0", "capped")
    s["bucket_report_base"] = w(DENSE, G_SINGLE) + (
        f"\nSELECT {bucket_expr('mtofinalofertadosol')} AS rng_mto_v2, {bucket_select(SINGLE, '')} "
        f"FROM g_single WHERE iter = 0 AND tasa_propuesta <= {D(RATE_CEILING)} GROUP BY 1")
    s["bucket_report_final"] = w(*FINAL_SINGLE) + (
        f"\nSELECT {bucket_expr('mtofinalofertadosol')} AS rng_mto_v2, {bucket_select(SINGLE, '_e')} "
        "FROM e GROUP BY 1")
    s["rate_change"] = rate_change_sql()
    s["rate_change_histogram"] = histogram_sql()
    offers = f"""
offers AS (
  SELECT o_custkey AS codclavecic, o_orderkey AS codoferta,
         {D(0.10)} + (o_orderkey % 40) / {D(100)} AS pcttasaofertada, o_totalprice AS mtofinalofertadosol,
         CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS codloteoferta,
         CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS tipventa,
         CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 END AS INTEGER) AS tipoferta
  FROM orders)"""
    top = """
SELECT codclavecic, codoferta, pcttasaofertada, mtofinalofertadosol, CAST(codloteoferta AS BIGINT) AS codloteoferta,
       CAST(tipventa AS BIGINT) AS tipventa, CAST(tipoferta AS BIGINT) AS tipoferta
FROM (SELECT *, row_number() OVER (PARTITION BY codclavecic ORDER BY mtofinalofertadosol DESC NULLS LAST, codoferta)
             AS ord FROM {src}) t
WHERE ord = 1"""
    s["top_offer"] = w(offers) + top.format(src="offers")
    s["top_offer_lot"] = w(offers) + top.format(
        src=f"(SELECT * FROM offers WHERE tipventa = {LOT_SALE_TYPE} AND tipoferta = {LOT_OFFER_TYPE})")
    s["indicator_max"] = w(DENSE, G_SINGLE) + (
        "\nSELECT CAST(year(o.o_orderdate) * 100 + month(o.o_orderdate) AS BIGINT) AS codmes, "
        "max(g.van_estimado) AS max_van_estimado "
        "FROM g_single g JOIN orders o ON g.llave = CAST(o.o_orderkey AS VARCHAR) GROUP BY 1")
    pandas_lead = f"""
SELECT CAST(count(*) AS BIGINT) AS clientes,
       {rnd(f"coalesce(sum({skip('mtofinalofertadosol')}), 0)", AMOUNT_DIGITS)} AS oferta,
       {rnd(f"avg({skip('prob_adj_ef')})", RATIO_DIGITS)} AS prob,
       {rnd(f"avg({skip('tasa_propuesta')})", RATIO_DIGITS)} AS tasa_cli,
       {rnd(div('sum(tasa_propuesta * mtofinalofertadosol)', 'sum(mtofinalofertadosol)'), RATIO_DIGITS)} AS tasa_pnd,
       {rnd(f"coalesce(sum({skip('mtofinalofertadosol * prob_adj_ef')}), 0)", AMOUNT_DIGITS)} AS mto_estimado,
       {rnd(f"coalesce(sum({skip('van * prob_adj_ef')}), 0)", AMOUNT_DIGITS)} AS van_estimado
FROM gappy_lead WHERE iter = 0"""
    s["lead_summary_pandas"] = w(DENSE, GAPPY, GAPPY_LEAD) + pandas_lead
    final_cols = {"single": s["final_selection_single"], "multi": s["final_selection_multi"]}
    s["pipeline_single"] = s["tradeoff_single"]
    s["pipeline_multi"] = s["tradeoff_multi"]
    s["pipeline_single_baseline"] = s["lead_summary"]
    s["pipeline_single_capped"] = s["rate_band_drop"]
    s["pipeline_single_final"] = final_cols["single"]
    s["pipeline_single_bucket_base"] = s["bucket_report_base"]
    s["pipeline_single_bucket_final"] = s["bucket_report_final"]
    s["pipeline_single_rate_change"] = s["rate_change"]
    s["pipeline_single_histogram"] = s["rate_change_histogram"]
    s["pipeline_multi_baseline"] = s["lead_summary_ceiling"]
    s["pipeline_multi_final"] = final_cols["multi"]
    pw = f"pow(prob_adj_ef, {D(PANDAS_EXP)})"
    s["pipeline_pandas_rules"] = w(DENSE, GAPPY, GAPPY_LEAD, PRODUCT) + f""",
pc AS (
  SELECT g.llave, g.iter, g.van * coalesce({skip(pw)}, {D(0)}) AS obj
  FROM (SELECT * FROM gappy_lead WHERE {CAPS}) g LEFT JOIN product p ON g.llave = p.llave)
SELECT llave, {rnd(f"max({skip('obj')})", SCORE_DIGITS)} AS m_obj_funct_p_1,
       {rnd(f"coalesce(sum({skip('obj')}), 0)", SCORE_DIGITS)} AS s_obj_funct_p_1
FROM pc GROUP BY llave"""
    s["pipeline_pandas_baseline"] = w(DENSE, GAPPY, GAPPY_LEAD) + pandas_lead
    s["pipeline_pandas_capped"] = w(DENSE, GAPPY, GAPPY_LEAD, PRODUCT) + f"""
SELECT g.llave, CAST(g.iter AS BIGINT) AS iter, g.tasa_propuesta, p.flg_subsegmento_consumo
FROM (SELECT * FROM gappy_lead WHERE {CAPS}) g LEFT JOIN product p ON g.llave = p.llave
WHERE {BAND_KEEP}"""
    s["pipeline_outputs"] = f"""
SELECT n.name, CAST(m.codmes AS BIGINT) AS codmes, 'A' AS campana, n.item, n.a, n.b
FROM (SELECT 'baseline' AS name, '' AS item, roa_saldo_estimado AS a, tasa_pnd AS b
      FROM (SELECT DISTINCT roa_saldo_estimado, tasa_pnd FROM ({s["tradeoff_multi"]}))
      UNION ALL SELECT 'tradeoff', CAST(exp AS VARCHAR), roa_saldo_estimado_e, tasa_pnd_e FROM ({s["tradeoff_multi"]})
      UNION ALL SELECT 'final', llave || ':' || CAST(iter AS VARCHAR), mtofinalofertadosol, tasa_propuesta
      FROM ({final_cols["multi"]})) n CROSS JOIN (VALUES (202401), (202402)) m(codmes)"""
    s["published_runs"] = s["pipeline_outputs"]
    month = "CAST(year(o.o_orderdate) * 100 + month(o.o_orderdate) AS BIGINT) AS codmes"
    bands = f"""
bands AS (
  SELECT codmes, seg, CASE WHEN a % 9 <> 0 THEN {D(0.12)} + (a % 8) / {D(100)} END AS lo,
         CASE WHEN b % 9 <> 0 THEN {D(0.25)} + (b % 30) / {D(100)} END AS hi
  FROM (SELECT {month}, p.flg_subsegmento_consumo AS seg, min(o.o_orderkey) AS a, max(o.o_orderkey) AS b
        FROM orders o JOIN product p ON p.llave = CAST(o.o_orderkey AS VARCHAR)
        WHERE p.flg_subsegmento_consumo <> 'MACHINERY' GROUP BY 1, 2) t),
rows AS (
  SELECT {month}, g.llave, g.iter, g.tasa_propuesta, p.flg_subsegmento_consumo
  FROM gappy g JOIN orders o ON g.llave = CAST(o.o_orderkey AS VARCHAR) LEFT JOIN product p ON g.llave = p.llave)"""
    term = ("(b.lo IS NOT NULL AND r.tasa_propuesta < b.lo AND r.flg_subsegmento_consumo = b.seg) OR "
            "(b.hi IS NOT NULL AND r.tasa_propuesta > b.hi AND r.flg_subsegmento_consumo = b.seg)")
    for mode, unknown in (("drop", "true"), ("keep", "false")):
        s[f"rate_band_rules_{mode}"] = w(DENSE, GAPPY, PRODUCT, bands) + f"""
SELECT r.llave, CAST(r.iter AS BIGINT) AS iter, r.tasa_propuesta, r.flg_subsegmento_consumo
FROM rows r LEFT JOIN bands b ON r.codmes = b.codmes
GROUP BY ALL HAVING NOT coalesce(bool_or(coalesce({term}, b.codmes IS NOT NULL AND {unknown})), false)"""
    s["bucket_report_rules"] = w(DENSE, G_SINGLE, PRODUCT) + f""",
leads AS (SELECT {month}, g.* FROM g_single g JOIN orders o ON g.llave = CAST(o.o_orderkey AS VARCHAR) WHERE g.iter = 0),
ends AS (
  SELECT codmes, min(l.mtofinalofertadosol) AS a, max(l.mtofinalofertadosol) AS b
  FROM leads l JOIN product p ON l.llave = p.llave GROUP BY codmes),
named AS (
  SELECT l.*, CASE WHEN mtofinalofertadosol < a + (b - a) * {D(0.125)} THEN '1.low'
                   WHEN mtofinalofertadosol < a + (b - a) * {D(0.5)} THEN '2.middle' ELSE '3.open' END AS rng_mto_v2
  FROM leads l LEFT JOIN ends e ON l.codmes = e.codmes)
SELECT codmes, rng_mto_v2, CAST(count(*) AS BIGINT) AS clientes, {rnd('sum(mtofinalofertadosol)', 3)} AS oferta,
       {rnd('avg(tasa_propuesta)', RATIO_DIGITS)} AS tasa_cli,
       {rnd('sum(tasa_propuesta * mtofinalofertadosol) / sum(mtofinalofertadosol)', RATIO_DIGITS)} AS tasa_pnd,
       {rnd('sum(mto_estimado)', 6)} AS mto_estimado, {rnd('sum(van_estimado)', 3)} AS van_estimado,
       {rnd('avg(prob_adj_ef)', RATIO_DIGITS)} AS prob
FROM named GROUP BY 1, 2"""
    s["csv_floor_table"] = w(FLOOR) + "\nSELECT llave, tasapropuestamin FROM floors"
    s["partitioned_output"] = w(DENSE) + """,
g AS (SELECT CAST(year(o.o_orderdate) * 100 + month(o.o_orderdate) AS BIGINT) AS codmes, d.llave, d.tasa_propuesta
      FROM dense d JOIN orders o ON d.llave = CAST(o.o_orderkey AS VARCHAR) WHERE d.iter = 0)
SELECT *, 'A' AS campana FROM g UNION ALL SELECT *, 'B' AS campana FROM g WHERE tasa_propuesta > CAST('0.3' AS DOUBLE)"""
    s["sort_scenarios"] = w(DENSE) + """
SELECT llave, CAST(iter AS BIGINT) AS iter, CAST(row_number() OVER (ORDER BY llave, iter) - 1 AS BIGINT) AS place FROM grid"""
    s["column_profile_approximate"] = (
        f"SELECT \"column\", \"type\", non_null, \"rows\", true AS close FROM ({s['column_profile']})")
    s["column_profile_merged"] = s["column_profile_approximate"]
    hot_cols = "g.llave, g.codclavecic, CAST(g.iter AS BIGINT) AS iter, g.tasa_propuesta, g.mtofinalofertadosol"
    s["rate_change_hot_key"] = rate_change_hot_sql()
    s["rate_floor_hot_key"] = w(HOT, HOT_TARGETS) + f"""
SELECT {hot_cols}, t.tasapropuestamin FROM natural_grid g JOIN targets t ON g.llave = t.llave
WHERE g.tasa_propuesta >= t.tasapropuestamin"""
    s["enrich_hot_key"] = w(HOT, HOT_TARGETS) + f"""
SELECT {hot_cols}, t.flg_subsegmento_consumo FROM natural_grid g LEFT JOIN targets t ON g.llave = t.llave"""
    s["nearest_rate_hot_key"] = w(HOT, HOT_TARGETS) + f""",
wd AS (SELECT g.*, {dec('abs(g.tasa_propuesta - t.tasa_objetivo)')} AS dif_abs
       FROM natural_grid g JOIN targets t ON g.llave = t.llave),
mn AS (SELECT llave, min(dif_abs) AS least FROM wd GROUP BY llave)
SELECT {hot_cols}, CAST(g.dif_abs AS DOUBLE) AS dif_abs FROM wd g JOIN mn ON g.llave = mn.llave AND g.dif_abs = mn.least"""
    s["nearest_rate"] = w(*SINGLE_CAPPED) + f""",
wd AS (SELECT c.llave, CAST(c.iter AS BIGINT) AS iter, c.tasa_propuesta, p.tasa_objetivo,
              {dec('abs(c.tasa_propuesta - p.tasa_objetivo)')} AS dif_abs
       FROM capped c JOIN product p ON c.llave = p.llave),
mn AS (SELECT llave, min(dif_abs) AS dif_abs FROM wd GROUP BY llave)
SELECT wd.llave, wd.iter, wd.tasa_propuesta, wd.tasa_objetivo, CAST(wd.dif_abs AS DOUBLE) AS dif_abs
FROM wd JOIN mn ON wd.llave = mn.llave AND wd.dif_abs = mn.dif_abs"""
    s["key_sample"] = w(DENSE) + f""",
k AS (SELECT llave FROM (SELECT DISTINCT llave FROM grid WHERE llave IS NOT NULL) ORDER BY llave LIMIT {SAMPLE_KEYS})
SELECT g.llave, CAST(g.iter AS BIGINT) AS iter, g.tasa_propuesta FROM grid g WHERE g.llave IN (SELECT llave FROM k)"""
    s["preview"] = w(DENSE) + (
        f"\nSELECT llave, CAST(iter AS BIGINT) AS iter, tasa_propuesta FROM grid ORDER BY llave, iter "
        f"LIMIT {PREVIEW_ROWS}")
    return s


SQL: dict[str, str] = _sql()
