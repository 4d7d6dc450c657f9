"""DuckDB SQL of the facts, for the oracle comparison.

States each fact from its definition over the driver tables. Ratios are rounded here
with DuckDB's own ``round`` on doubles, not with the library's integer formula; only the
vocabulary maps are shared.
"""

from __future__ import annotations

from tidewise import vocab as V
from tidewise.sources import bindings as B


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in values) + ")"


def case_map(col: str, pairs) -> str:
    return "CASE " + " ".join(f"WHEN {col} = {q(k)} THEN {q(v)}" for k, v in pairs) + " END"


def half_up(x: str, scale: int) -> str:
    """Round half away from zero. The nudge lifts quotients that a double holds just below a tie."""
    nudge = "1e-9" if scale <= 2 else "1e-12"
    return f"(round(({x}) + sign({x}) * {nudge}, {scale}) + 0)"  # + 0: no negative zero


def round_div(n: str, d: str, scale: int = 0, factor: int = 1) -> str:
    return half_up(f"CAST({n} AS DOUBLE) * {factor} / NULLIF(CAST({d} AS DOUBLE), 0)", scale)


def pct(n: str, d: str, scale: int = 1) -> str:
    return round_div(n, d, scale, 100)


def growth(new: str, old: str, scale: int = 1) -> str:
    return round_div(f"(({new}) - ({old}))", old, scale, 100)


def round_div_decimal(n: str, d: str, scale: int = 2, factor: int = 1, precision: int = 14) -> str:
    return f"CAST({round_div(n, d, scale, factor)} AS DECIMAL({precision},{scale}))"


DATE_O = "CAST(o.o_orderdate AS DATE)"
MONTH_L = "CAST(date_trunc('month', CAST(l.l_shipdate AS DATE)) AS DATE)"
DUR = B.DURATION

FX = {}   # name -> list of (cte_name, sql)

FX["fx_trips_q"] = [
    ("fxq_per_order", "SELECT l_orderkey, CAST(SUM(l_quantity) AS BIGINT) AS qty, COUNT(*) AS nl "
                      "FROM lineitem GROUP BY l_orderkey"),
    ("fxq_agg", f"""SELECT CAST(c.c_nationkey AS INTEGER) AS id_ccaa,
        CAST(year({DATE_O}) AS INTEGER) AS anio, CAST(quarter({DATE_O}) AS INTEGER) AS trimestre,
        COUNT(*) AS viajes, SUM(CAST(o.o_totalprice AS DECIMAL(14,2))) AS spend,
        SUM(p.qty) AS qty, SUM(p.nl) AS nl
      FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
      LEFT JOIN fxq_per_order p ON p.l_orderkey = o.o_orderkey
      GROUP BY 1, 2, 3"""),
    ("fxq_long", f"""SELECT id_ccaa, anio, trimestre, {q(V.TRIPS)} AS metrica,
            CAST(viajes AS DECIMAL(14,2)) AS valor FROM fxq_agg
      UNION ALL SELECT id_ccaa, anio, trimestre, {q(V.SPEND_TOTAL)}, {round_div_decimal('spend', '1000', 2)} FROM fxq_agg
      UNION ALL SELECT id_ccaa, anio, trimestre, {q(DUR)}, {round_div_decimal('qty', 'nl', 2)} FROM fxq_agg"""),
    ("fx_trips_q", """SELECT a.id_ccaa, n.n_name AS destino, a.metrica, a.anio, a.trimestre,
        make_date(a.anio, (a.trimestre - 1) * 3 + 1, 1) AS fecha, a.valor
      FROM fxq_long a JOIN nation n ON n.n_nationkey = a.id_ccaa WHERE a.valor IS NOT NULL"""),
]

FX["fx_foreign_m"] = [
    ("fxf_lines", f"""SELECT CAST(s.s_nationkey AS INTEGER) AS id_ccaa, l.l_returnflag, {MONTH_L} AS fecha
      FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey"""),
    ("fx_foreign_m", f"""SELECT a.id_ccaa, n.n_name AS destino, a.motivo, a.fecha, a.turistas FROM (
        SELECT id_ccaa, {case_map('l_returnflag', B.FLAG_FOREIGN_MOTIVE)} AS motivo, fecha,
               COUNT(*) AS turistas
        FROM fxf_lines
        GROUP BY 1, 2, 3) a JOIN nation n ON n.n_nationkey = a.id_ccaa"""),
]

FX["fx_spend_y"] = [
    ("fxs_agg", f"""SELECT CAST(s.s_nationkey AS INTEGER) AS id_ccaa,
        CAST(year(CAST(l.l_shipdate AS DATE)) AS INTEGER) AS anio, COUNT(*) AS n,
        SUM(CAST(l.l_extendedprice AS DECIMAL(14,2))) AS amount,
        CAST(SUM(l.l_quantity) AS BIGINT) AS qty
      FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
      GROUP BY 1, 2"""),
    ("fx_spend_y", f"""SELECT a.id_ccaa, n.n_name AS destino, a.metrica, a.anio, a.valor FROM (
        SELECT id_ccaa, anio, {q(V.SPEND_PER_PERSON)} AS metrica, {round_div_decimal('amount', 'n', 2)} AS valor FROM fxs_agg
        UNION ALL SELECT id_ccaa, anio, {q(DUR)}, {round_div_decimal('qty', 'n', 2)} FROM fxs_agg
      ) a JOIN nation n ON n.n_nationkey = a.id_ccaa WHERE a.valor IS NOT NULL"""),
]

_SUB = f"CASE WHEN o_orderpriority = '1-URGENT' THEN {case_map('o_orderstatus', B.STATUS_LEISURE_SUB)} END"
_L1 = f"CASE WHEN p.p_type IN {in_list(B.MARKET_PTYPES)} THEN {q(V.MARKET)} ELSE {q(V.NON_MARKET)} END"

FX["fx_residents_y"] = [
    ("fxr_oc", f"""SELECT CAST(c.c_nationkey AS INTEGER) AS id_ccaa, CAST(year({DATE_O}) AS INTEGER) AS anio,
        o.o_orderpriority, o.o_orderstatus
      FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"""),
    ("fxr_mot", f"""SELECT id_ccaa, anio, motivo, COUNT(*) AS viajes FROM (
        SELECT id_ccaa, anio, {q(V.TOTAL)} AS motivo FROM fxr_oc
        UNION ALL SELECT id_ccaa, anio, {case_map('o_orderpriority', B.PRIORITY_MOTIVE)} FROM fxr_oc
        UNION ALL SELECT id_ccaa, anio, {_SUB} FROM fxr_oc) t
      WHERE motivo IS NOT NULL GROUP BY 1, 2, 3"""),
    ("fxr_lines", f"""SELECT CAST(c.c_nationkey AS INTEGER) AS id_ccaa, CAST(year({DATE_O}) AS INTEGER) AS anio,
        {_L1} AS l1, {case_map('p.p_type', B.PTYPE_LEVEL2)} AS l2
      FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
      JOIN customer c ON o.o_custkey = c.c_custkey JOIN part p ON l.l_partkey = p.p_partkey"""),
    ("fxr_lod", """SELECT id_ccaa, anio, l1, l2, COUNT(*) AS viajes FROM (
        SELECT id_ccaa, anio, l1, l2 FROM fxr_lines
        UNION ALL SELECT id_ccaa, anio, l1, CAST(NULL AS VARCHAR) FROM fxr_lines) t
      GROUP BY 1, 2, 3, 4"""),
    ("fx_residents_y", f"""SELECT u.id_ccaa, n.n_name AS destino, u.motivo, u.alojamiento_nivel1,
        u.alojamiento_nivel2, u.anio, u.viajes FROM (
        SELECT id_ccaa, motivo, {q(V.TOTAL)} AS alojamiento_nivel1,
               CAST(NULL AS VARCHAR) AS alojamiento_nivel2, anio, viajes FROM fxr_mot
        UNION ALL SELECT id_ccaa, {q(V.TOTAL)}, l1, l2, anio, viajes FROM fxr_lod
      ) u JOIN nation n ON n.n_nationkey = u.id_ccaa"""),
]

_LINES_FULL = """FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
      JOIN part p ON l.l_partkey = p.p_partkey"""

FX["fx_capacity_m"] = [
    ("fx_capacity_m", f"""SELECT a.id_ccaa, n.n_name AS destino, a.tipo_alojamiento, a.fecha, a.plazas FROM (
        SELECT CAST(s.s_nationkey AS INTEGER) AS id_ccaa,
               {case_map('p.p_type', B.PTYPE_ACCOMMODATION)} AS tipo_alojamiento,
               {MONTH_L} AS fecha, COUNT(DISTINCT l.l_partkey) AS plazas
        {_LINES_FULL} GROUP BY 1, 2, 3) a JOIN nation n ON n.n_nationkey = a.id_ccaa"""),
]

FX["fx_demand_m"] = [
    ("fxd_cells", f"""SELECT CAST(s.s_nationkey AS INTEGER) AS id_ccaa,
        {case_map('p.p_type', B.PTYPE_ACCOMMODATION)} AS tipo_alojamiento, {MONTH_L} AS fecha,
        l.l_orderkey, l.l_quantity,
        CASE WHEN c.c_nationkey = s.s_nationkey THEN {q(V.NATIONAL)} ELSE {q(V.FOREIGN)} END AS res
      {_LINES_FULL}
      JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey"""),
    ("fxd_agg", f"""SELECT id_ccaa, tipo_alojamiento, residencia, fecha,
        COUNT(DISTINCT l_orderkey) AS viajeros, CAST(SUM(l_quantity) AS BIGINT) AS noches FROM (
          SELECT id_ccaa, tipo_alojamiento, fecha, l_orderkey, l_quantity, res AS residencia FROM fxd_cells
          UNION ALL SELECT id_ccaa, tipo_alojamiento, fecha, l_orderkey, l_quantity,
                           CAST(NULL AS VARCHAR) FROM fxd_cells) t
      GROUP BY 1, 2, 3, 4"""),
    ("fx_demand_m", f"""SELECT a.id_ccaa, n.n_name AS destino, a.tipo_alojamiento, a.residencia,
        a.metrica, a.fecha, a.valor FROM (
        SELECT id_ccaa, tipo_alojamiento, residencia, fecha, {q(V.TRAVELLERS)} AS metrica, viajeros AS valor FROM fxd_agg
        UNION ALL SELECT id_ccaa, tipo_alojamiento, residencia, fecha, {q(V.NIGHTS)}, noches FROM fxd_agg
      ) a JOIN nation n ON n.n_nationkey = a.id_ccaa"""),
]

FACT_CTE = {"quarterly_spend": "fx_trips_q", "foreign_motives": "fx_foreign_m",
            "foreign_spend": "fx_spend_y", "residents": "fx_residents_y",
            "capacity": "fx_capacity_m", "demand": "fx_demand_m"}


def with_facts(facts, ctes=(), final: str = "") -> str:
    """Assemble ``WITH <bindings>, <ctes> <final>`` for the named fixture CTEs."""
    parts, seen = [], set()
    for n, sql in [c for f in facts for c in FX[f]] + list(ctes):
        if n not in seen:
            seen.add(n)
            parts.append((n, sql))
    body = ",\n".join(f"{n} AS (\n{s}\n)" for n, s in parts)
    return f"WITH {body}\n{final}" if parts else final
