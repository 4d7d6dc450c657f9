"""DuckDB SQL for the measure and page-dataset keys."""

from __future__ import annotations

from tidewise import vocab as V
from tidewise.plans.registry import P
from tidewise.plans.registry_measures import BASE, CAMPING_GROUP, G0, G1, GRID, HOTEL_GROUP, RURAL_GROUP, Y
from tidewise.sources.bindings_sql import in_list, q, round_div, with_facts

ORACLE = {}
TF = ["fx_trips_q", "fx_foreign_m"]


def r6(a, b, factor=1):
    return round_div(a, b, 6, factor)


def _totals(quarter=False):
    qk = ", CAST(quarter(fecha) AS INTEGER) AS trimestre" if quarter else ""
    tk = ", trimestre" if quarter else ""
    on = " AND d.trimestre = e.trimestre" if quarter else ""
    sel_q = ", COALESCE(d.trimestre, e.trimestre) AS trimestre" if quarter else ""
    n = "mtq" if quarter else "mt"
    return [
        (f"{n}_dom", f"""SELECT id_ccaa, destino, anio{tk}, CAST(SUM(valor) AS DOUBLE) AS total_viajes_nacionales
          FROM fx_trips_q WHERE metrica = 'Viajes' GROUP BY ALL"""),
        (f"{n}_ext", f"""SELECT id_ccaa, destino, CAST(year(fecha) AS INTEGER) AS anio{qk},
          CAST(SUM(turistas) AS DOUBLE) AS total_turistas_extranjeros FROM fx_foreign_m GROUP BY ALL"""),
        (n, f"""SELECT COALESCE(d.id_ccaa, e.id_ccaa) AS id_ccaa, COALESCE(d.destino, e.destino) AS destino,
          COALESCE(d.anio, e.anio) AS anio{sel_q}, d.total_viajes_nacionales, e.total_turistas_extranjeros,
          CASE WHEN COALESCE(d.total_viajes_nacionales, e.total_turistas_extranjeros) IS NOT NULL
               THEN COALESCE(d.total_viajes_nacionales, 0) + COALESCE(e.total_turistas_extranjeros, 0) END AS total_turismo
          FROM {n}_dom d FULL OUTER JOIN {n}_ext e
            ON d.id_ccaa = e.id_ccaa AND d.destino = e.destino AND d.anio = e.anio{on}"""),
    ]


def _season():
    return _totals(True) + [
        ("si_t", f"""SELECT id_ccaa, destino, anio,
          {', '.join(f'COALESCE(CAST(SUM(CASE WHEN trimestre = {i} THEN total_turismo END) AS DOUBLE), 0.0) AS t{i}' for i in range(1, 5))}
          FROM mtq GROUP BY 1, 2, 3"""),
        ("si_m", "SELECT *, (((t1 + t2) + t3) + t4) / 4.0 AS m FROM si_t"),
        ("si", """SELECT id_ccaa, destino, anio, ROUND(sqrt(((((t1 - m) * (t1 - m) + (t2 - m) * (t2 - m))
          + (t3 - m) * (t3 - m)) + (t4 - m) * (t4 - m)) / 4.0) / NULLIF(m, 0), 6) AS indice_estacionalidad
          FROM si_m"""),
    ]


def _grid(s, p, ic=GRID["index_cut"], sc=GRID["share_cut"]):
    c = V.GRID_CLASSES
    return (f"CASE WHEN {s} >= {ic} AND {p} >= {sc} THEN {q(c[0])} WHEN {s} < {ic} AND {p} >= {sc} THEN {q(c[1])} "
            f"WHEN {s} >= {ic} AND {p} < {sc} THEN {q(c[2])} WHEN {s} < {ic} AND {p} < {sc} THEN {q(c[3])} "
            f"ELSE {q(c[4])} END")


def _classification():
    return _season() + _totals() + [
        ("fs", f"SELECT id_ccaa, destino, anio, {r6('total_turistas_extranjeros', 'total_turismo')} AS pct_turistas_extranjeros FROM mt"),
        ("cl", f"""SELECT COALESCE(s.id_ccaa, f.id_ccaa) AS id_ccaa, COALESCE(s.destino, f.destino) AS destino,
          COALESCE(s.anio, f.anio) AS anio, s.indice_estacionalidad, f.pct_turistas_extranjeros,
          {_grid('s.indice_estacionalidad', 'f.pct_turistas_extranjeros')} AS clasificacion
          FROM si s FULL OUTER JOIN fs f ON s.id_ccaa = f.id_ccaa AND s.destino = f.destino AND s.anio = f.anio"""),
        ("clf", f"SELECT id_ccaa, destino, clasificacion AS clasificacion_col FROM cl WHERE anio = {Y}"),
    ]


ORACLE["m_foreign_total"] = with_facts(["fx_foreign_m"], [], """SELECT destino, CAST(year(fecha) AS INTEGER) AS anio,
    CAST(SUM(turistas) AS BIGINT) AS total_turistas_extranjeros FROM fx_foreign_m GROUP BY 1, 2""")
ORACLE["m_domestic_total"] = with_facts(["fx_trips_q"], [], """SELECT destino, anio,
    CAST(SUM(valor) AS DOUBLE) AS total_viajes_nacionales FROM fx_trips_q WHERE metrica = 'Viajes' GROUP BY 1, 2""")
ORACLE["m_total"] = with_facts(TF, _totals(), """SELECT destino, anio, total_viajes_nacionales,
    total_turistas_extranjeros, total_turismo FROM mt""")

_TOP5 = [("rk", "SELECT anio, destino, total_turismo, RANK() OVER (PARTITION BY anio ORDER BY total_turismo DESC) AS r "
                "FROM mt WHERE total_turismo IS NOT NULL"),
         ("top5", f"""SELECT anio, {r6('SUM(CASE WHEN r <= 5 THEN total_turismo END)', 'SUM(total_turismo)')} AS pct_top5
           FROM rk GROUP BY anio""")]
ORACLE["m_top5_share"] = with_facts(TF, _totals() + _TOP5, "SELECT anio, pct_top5 FROM top5")
_QS = ("qs", f"""SELECT destino, anio, trimestre, total_turismo,
    {r6('total_turismo', 'SUM(total_turismo) OVER (PARTITION BY id_ccaa, anio)')} AS pct_trimestral FROM mtq""")
ORACLE["m_quarter_share"] = with_facts(TF, _totals(True) + [_QS], "SELECT * FROM qs")
ORACLE["m_foreign_share"] = with_facts(TF, _totals(), f"""SELECT destino, anio,
    {r6('total_turistas_extranjeros', 'total_turismo')} AS pct_turistas_extranjeros FROM mt""")
ORACLE["m_seasonality_index"] = with_facts(TF, _season(), "SELECT destino, anio, indice_estacionalidad FROM si")
ORACLE["m_classification"] = with_facts(TF, _classification(), """SELECT destino, anio, indice_estacionalidad,
    pct_turistas_extranjeros, clasificacion FROM cl""")
ORACLE["m_classification_blank_as_zero"] = with_facts(TF, _classification(), f"""SELECT destino, anio, indice_estacionalidad,
    pct_turistas_extranjeros, {_grid('COALESCE(indice_estacionalidad, 0)', 'COALESCE(pct_turistas_extranjeros, 0)')} AS clasificacion
    FROM cl""")
ORACLE["m_classification_fixed"] = with_facts(TF, _classification(), "SELECT * FROM clf")
for _key, _col in (("", "total_turismo"), ("_foreign", "total_turistas_extranjeros"), ("_domestic", "total_viajes_nacionales")):
    ORACLE[f"m_active_metric{_key}"] = with_facts(TF, _totals(), f"SELECT destino, anio, {_col} AS metrica_activa FROM mt")
ORACLE["m_indexed"] = with_facts(TF, _totals(), f"""SELECT destino, anio, total_turismo AS metrica_activa,
    {r6('total_turismo', f'SUM(CASE WHEN anio = {BASE} THEN total_turismo END) OVER (PARTITION BY id_ccaa)', 100)}
      AS metrica_indexada FROM mt""")


def _growth(col="total_turismo"):
    return [("gr", f"""SELECT id_ccaa, destino, {r6(f'COALESCE(SUM(CASE WHEN anio = {G1} THEN {col} END), 0) - SUM(CASE WHEN anio = {G0} THEN {col} END)',
                                             f'SUM(CASE WHEN anio = {G0} THEN {col} END)')} AS crecimiento
      FROM mt WHERE anio IN ({G0}, {G1}) GROUP BY 1, 2""")]


ORACLE["m_growth"] = with_facts(TF, _totals() + _growth(), "SELECT destino, crecimiento FROM gr")
ORACLE["m_total_year"] = with_facts(TF, _totals(), f"SELECT destino, total_turismo AS total_anio FROM mt WHERE anio = {Y}")
_GAP = [("cov", f"""SELECT id_ccaa, CAST(year(fecha) AS INTEGER) AS anio, COUNT(DISTINCT fecha) AS meses
          FROM fx_foreign_m WHERE year(fecha) IN ({G0}, {G1}) GROUP BY 1, 2"""),
        ("gap", f"""SELECT id_ccaa, abs(COALESCE(SUM(CASE WHEN anio = {G1} THEN meses END), 0)
          - COALESCE(SUM(CASE WHEN anio = {G0} THEN meses END), 0)) AS gap FROM cov GROUP BY 1""")]
ORACLE["m_growth_filtered"] = with_facts(TF, _totals() + _growth("total_turistas_extranjeros") + _GAP, """
    SELECT g.destino, CASE WHEN COALESCE(p.gap, 0) >= 3 THEN NULL ELSE g.crecimiento END AS crecimiento_filtrado
    FROM gr g LEFT JOIN gap p ON g.id_ccaa = p.id_ccaa""")

_TRAV = "metrica = 'Viajeros' AND residencia IS NULL"
def _lodging_index(extra="", rows=_TRAV):
    return with_facts(["fx_demand_m"], [
        ("tv", f"""SELECT tipo_alojamiento, CAST(year(fecha) AS INTEGER) AS anio, CAST(SUM(valor) AS BIGINT) AS viajeros
          FROM fx_demand_m WHERE {rows} {extra} GROUP BY 1, 2""")],
        f"""SELECT tipo_alojamiento, anio, viajeros,
          {r6('viajeros', f'SUM(CASE WHEN anio = {BASE} THEN viajeros END) OVER (PARTITION BY tipo_alojamiento)', 100)}
            AS indice_alojamiento FROM tv""")


for _key, _res in (("", "IS NULL"), ("_national", f"= {q(V.NATIONAL)}"), ("_foreign", f"= {q(V.FOREIGN)}")):
    _rows = f"metrica = 'Viajeros' AND residencia {_res}"
    ORACLE[f"m_lodging_index{_key}"] = _lodging_index(rows=_rows)
    ORACLE[f"m_travellers{_key}"] = with_facts(["fx_demand_m"], [], f"""SELECT destino, tipo_alojamiento,
        CAST(year(fecha) AS INTEGER) AS anio, CAST(SUM(valor) AS BIGINT) AS viajeros
        FROM fx_demand_m WHERE {_rows} GROUP BY 1, 2, 3""")
ORACLE["m_accommodation_mix"] = with_facts(["fx_demand_m"], [
    ("tv", f"""SELECT destino, CAST(year(fecha) AS INTEGER) AS anio, tipo_alojamiento, CAST(SUM(valor) AS BIGINT) AS viajeros
      FROM fx_demand_m WHERE {_TRAV} GROUP BY 1, 2, 3""")],
    f"""SELECT destino, anio, tipo_alojamiento, viajeros,
      {r6('viajeros', 'SUM(viajeros) OVER (PARTITION BY destino, anio)')} AS pct_tipo_alojamiento FROM tv""")
ORACLE["m_non_market_share"] = with_facts(["fx_residents_y"], [
    ("nm", f"""SELECT destino,
      CAST(SUM(CASE WHEN alojamiento_nivel1 IN {in_list(V.MARKET_LEVEL1)} THEN viajes END) AS DOUBLE) AS mercado,
      CAST(SUM(CASE WHEN alojamiento_nivel1 = {q(V.NON_MARKET)} THEN viajes END) AS DOUBLE) AS no_mercado
      FROM fx_residents_y WHERE motivo = 'Total' AND alojamiento_nivel2 IS NULL AND anio = {Y} GROUP BY 1""")],
    f"""SELECT destino, mercado, no_mercado, {r6('no_mercado',
        'CASE WHEN COALESCE(mercado, no_mercado) IS NOT NULL THEN COALESCE(mercado, 0) + COALESCE(no_mercado, 0) END')}
      AS pct_no_mercado FROM nm""")
ORACLE["dim_calendar"] = with_facts(["fx_capacity_m", "fx_demand_m"], [
    ("b", "SELECT MIN(fecha) AS a, MAX(fecha) AS z FROM (SELECT fecha FROM fx_capacity_m UNION ALL SELECT fecha FROM fx_demand_m) t"),
    ("m", "SELECT CAST(unnest(generate_series(CAST(date_trunc('month', a) AS DATE), CAST(date_trunc('month', z) AS DATE), INTERVAL 1 MONTH)) AS DATE) AS fecha FROM b")],
    """SELECT fecha, CAST(year(fecha) AS INTEGER) AS anio, CAST(quarter(fecha) AS INTEGER) AS trimestre,
      CAST(month(fecha) AS INTEGER) AS mes, CAST(day(last_day(fecha)) AS INTEGER) AS dias_mes FROM m""")


def _occ(keys, where_d="TRUE", where_c="TRUE"):
    k = ", ".join(keys)
    on = " AND ".join(f"n.{c} IS NOT DISTINCT FROM b.{c}" for c in keys)
    return [
        ("occ_n", f"""SELECT {k}, SUM(valor) AS pernoctaciones FROM (SELECT *, CAST(year(fecha) AS INTEGER) AS anio
          FROM fx_demand_m) d WHERE metrica = 'Pernoctaciones' AND residencia IS NULL AND {where_d} GROUP BY ALL"""),
        ("occ_b", f"""SELECT {k}, SUM(plazas * day(last_day(fecha))) AS plazas_dia FROM (SELECT *, CAST(year(fecha) AS INTEGER) AS anio
          FROM fx_capacity_m) c WHERE {where_c} GROUP BY ALL"""),
        ("occ", f"""SELECT {', '.join(f'COALESCE(n.{c}, b.{c}) AS {c}' for c in keys)},
          CAST(n.pernoctaciones AS BIGINT) AS pernoctaciones, CAST(b.plazas_dia AS BIGINT) AS plazas_dia,
          {r6('n.pernoctaciones', 'b.plazas_dia')} AS tasa_ocupacion
          FROM occ_n n FULL OUTER JOIN occ_b b ON {on}"""),
    ]


ORACLE["m_occupancy"] = with_facts(["fx_capacity_m", "fx_demand_m"],
                                   _occ(["destino", "tipo_alojamiento", "anio"]), "SELECT * FROM occ")


def _occ_group(group, by=None, with_cls=True):
    acc, classes = group
    regions = f"id_ccaa IN (SELECT id_ccaa FROM clf WHERE clasificacion_col IN {in_list(classes)})"
    flt = (f"year(fecha) = {Y} AND month(fecha) IN (6, 7, 8) AND tipo_alojamiento = {q(acc)} AND {regions}")
    keys = [by] if by else ["grupo"]
    pre = [] if not with_cls else _classification()
    if by:
        return pre, _occ(keys, flt, flt)
    # constant group key
    occ = _occ(["grupo"], flt, flt)
    occ[0] = (occ[0][0], occ[0][1].replace("SELECT grupo,", f"SELECT {q(acc)} AS grupo,"))
    occ[1] = (occ[1][0], occ[1][1].replace("SELECT grupo,", f"SELECT {q(acc)} AS grupo,"))
    return pre, occ


def _occ_sql(group, by=None):
    pre, occ = _occ_group(group, by)
    return with_facts(TF + ["fx_capacity_m", "fx_demand_m"], pre + occ, "SELECT * FROM occ")


ORACLE["m_occupancy_group"] = _occ_sql(HOTEL_GROUP)
ORACLE["p5_rural_occupancy"] = _occ_sql(RURAL_GROUP, "destino")
ORACLE["p5_camping_occupancy"] = _occ_sql(CAMPING_GROUP, "destino")
_pre, _o1 = _occ_group(HOTEL_GROUP)
_, _o2 = _occ_group(RURAL_GROUP, with_cls=False)
_o2 = [(n + "2", s.replace("occ_n", "occ_n2").replace("occ_b", "occ_b2")) for n, s in _o2]
ORACLE["p5_kpis"] = with_facts(TF + ["fx_capacity_m", "fx_demand_m"], _pre + _o1 + _o2,
                               "SELECT * FROM occ UNION ALL SELECT * FROM occ2")

ORACLE["p1_volume_ranking"] = with_facts(TF, _totals(), """SELECT destino, anio, total_turismo,
    CAST(DENSE_RANK() OVER (PARTITION BY anio ORDER BY total_turismo DESC NULLS LAST) AS INTEGER) AS ranking FROM mt""")
ORACLE["p1_quarter_heatmap"] = with_facts(TF, _totals(True) + [_QS],
                                          f"SELECT destino, trimestre, pct_trimestral FROM qs WHERE anio = {Y}")
ORACLE["p1_kpis"] = with_facts(TF, _totals() + _TOP5, f"""SELECT k.anio, k.total_viajes_nacionales,
    k.total_turistas_extranjeros, t.pct_top5 FROM (SELECT anio, SUM(total_viajes_nacionales) AS total_viajes_nacionales,
      SUM(total_turistas_extranjeros) AS total_turistas_extranjeros FROM mt WHERE anio = {Y} GROUP BY anio) k
    LEFT JOIN top5 t ON k.anio = t.anio""")
ORACLE["p2_scatter"] = with_facts(TF, _classification(), f"""SELECT c.destino, c.indice_estacionalidad,
    c.pct_turistas_extranjeros, m.total_turismo, f.clasificacion_col
    FROM cl c LEFT JOIN (SELECT id_ccaa, total_turismo FROM mt WHERE anio = {Y}) m ON c.id_ccaa = m.id_ccaa
    LEFT JOIN clf f ON c.id_ccaa = f.id_ccaa WHERE c.anio = {Y}""")
ORACLE["p2_table"] = with_facts(TF, _classification(), f"""SELECT destino, clasificacion, pct_turistas_extranjeros
    FROM cl WHERE anio = {Y}""")
_ey = P["evo_years"]
ORACLE["p3_group_evolution"] = with_facts(TF, _classification(), f"""SELECT f.clasificacion_col, m.anio,
    SUM(m.total_turismo) AS volumen FROM mt m JOIN clf f ON m.id_ccaa = f.id_ccaa
    WHERE m.anio BETWEEN {_ey[0]} AND {_ey[1]} GROUP BY 1, 2""")
ORACLE["p3_growth_scatter"] = with_facts(TF, _classification() + _growth(), f"""SELECT g.destino,
    g.crecimiento AS crecimiento_filtrado, m.total_turismo AS total_anio, f.clasificacion_col
    FROM gr g LEFT JOIN (SELECT id_ccaa, total_turismo FROM mt WHERE anio = {Y}) m ON g.id_ccaa = m.id_ccaa
    LEFT JOIN clf f ON g.id_ccaa = f.id_ccaa""")
ORACLE["p3_growth_scatter_foreign"] = with_facts(TF, _classification() + _growth("total_turistas_extranjeros") + _GAP, f"""
    SELECT g.destino, CASE WHEN COALESCE(p.gap, 0) >= 3 THEN NULL ELSE g.crecimiento END AS crecimiento_filtrado,
      m.total_turistas_extranjeros AS total_anio, f.clasificacion_col
    FROM gr g LEFT JOIN gap p ON g.id_ccaa = p.id_ccaa
    LEFT JOIN (SELECT id_ccaa, total_turistas_extranjeros FROM mt WHERE anio = {Y}) m ON g.id_ccaa = m.id_ccaa
    LEFT JOIN clf f ON g.id_ccaa = f.id_ccaa""")
ORACLE["p4_lodging_index"] = _lodging_index("AND tipo_alojamiento IS DISTINCT FROM 'Albergue'")
ORACLE["p4_lodging_mix"] = with_facts(["fx_demand_m"], [
    ("tv", f"""SELECT destino, tipo_alojamiento, CAST(SUM(valor) AS BIGINT) AS viajeros
      FROM fx_demand_m WHERE {_TRAV} AND year(fecha) = {Y} GROUP BY 1, 2""")],
    f"""SELECT destino, tipo_alojamiento, viajeros,
      {r6('viajeros', 'SUM(viajeros) OVER (PARTITION BY destino)')} AS pct_tipo_alojamiento FROM tv""")

_cells = {"0 AS todas_regiones, 0 AS todos_trimestres, destino, trimestre": "destino, trimestre", "0, 1, destino, NULL": "destino",
          "1, 0, NULL, trimestre": "trimestre", "1, 1, NULL, NULL": None}
_matrix = " UNION ALL ".join(f"""SELECT {c}, SUM(total_turismo) AS total_turismo FROM mtq WHERE anio = {Y}
    {f"GROUP BY {g}" if g else "HAVING SUM(total_turismo) IS NOT NULL"}""" for c, g in _cells.items())
ORACLE["p1_quarter_heatmap_totals"] = with_facts(TF, _totals(True) + [("cells", _matrix)], f"""
    SELECT c.todas_regiones, c.todos_trimestres, c.destino, CAST(c.trimestre AS INTEGER) AS trimestre, c.total_turismo,
      {r6('c.total_turismo', 't.total_turismo')} AS pct_trimestral
    FROM cells c JOIN cells t ON t.todos_trimestres = 1 AND t.todas_regiones = c.todas_regiones AND t.destino IS NOT DISTINCT FROM c.destino
    WHERE c.total_turismo IS NOT NULL""")
