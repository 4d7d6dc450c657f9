"""DuckDB SQL for the building-block and derived-flag keys."""

from __future__ import annotations

from tidewise import vocab as V
from tidewise.plans.oracle_sql import ORACLE as BASE_ORACLE, lodging_mix
from tidewise.plans.registry import P
from tidewise.plans.registry_blocks import BANDS
from tidewise.sources.bindings_sql import growth, in_list, pct, q, with_facts

ORACLE = {}
Y = P["last_year"]
MAINS = in_list(V.MAIN_MOTIVES)
PTS = (P["first_year"], P["pre_year"], P["last_year"])


def cs(cond, v):
    return f"SUM(CASE WHEN {cond} THEN {v} END)"


ORACLE["safe_ratio_pct"] = with_facts(["fx_residents_y"], [], f"""SELECT destino, anio,
    {pct(cs(f"motivo = {q(V.LEISURE)}", 'viajes'), cs("motivo = 'Total'", 'viajes'))} AS pct_ocio_sobre_total
    FROM fx_residents_y WHERE alojamiento_nivel1 = 'Total' GROUP BY 1, 2""")
ORACLE["pivot_sum_by_category"] = with_facts(["fx_residents_y"], [], f"""SELECT destino,
    {', '.join(f"{cs(f'motivo = {q(m)}', 'viajes')} AS {a}" for a, m in
               (("ocio", V.LEISURE), ("negocios", V.BUSINESS), ("familia", V.FAMILY), ("otros", V.OTHER)))}
    FROM fx_residents_y WHERE alojamiento_nivel1 = 'Total' AND anio = {Y} GROUP BY 1""")
ORACLE["pivot_avg_by_category"] = with_facts(["fx_capacity_m"], [], f"""SELECT destino,
    {', '.join(f"ROUND(AVG(CASE WHEN tipo_alojamiento = {q(t)} THEN plazas END), 6) AS plazas_{a}" for a, t in V.ACCOMMODATION_TYPES)}
    FROM fx_capacity_m WHERE year(fecha) = {Y} GROUP BY 1""")
ORACLE["pivot_by_year"] = with_facts(["fx_trips_q"], [], f"""SELECT destino,
    {', '.join(f"CAST({cs(f'anio = {p}', 'valor')} AS DOUBLE) AS viajes_{p}" for p in PTS)}
    FROM fx_trips_q WHERE metrica = 'Viajes' AND anio IN {in_list(PTS)} GROUP BY 1""")
ORACLE["eav_pick"] = with_facts(["fx_spend_y"], [], f"""SELECT destino, anio,
    CAST(MAX(CASE WHEN metrica = {q(V.SPEND_PER_PERSON)} THEN valor END) AS DOUBLE) AS gasto_medio,
    CAST(MAX(CASE WHEN metrica LIKE 'Duraci%' THEN valor END) AS DOUBLE) AS duracion_media
    FROM fx_spend_y GROUP BY 1, 2""")
ORACLE["share_within_group"] = with_facts(["fx_residents_y"], [], f"""SELECT destino, anio,
    {cs(f'motivo IN {MAINS}', 'viajes')} AS total_principales,
    {pct(cs(f"motivo = {q(V.LEISURE)}", 'viajes'), cs(f'motivo IN {MAINS}', 'viajes'))} AS pct_ocio,
    {pct(cs(f"motivo = {q(V.BUSINESS)}", 'viajes'), cs(f'motivo IN {MAINS}', 'viajes'))} AS pct_negocios
    FROM fx_residents_y WHERE alojamiento_nivel1 = 'Total' GROUP BY 1, 2""")
# as written: every level-2-NULL row counts in the denominator, grand total included
ORACLE["hierarchical_share"] = lodging_mix("alojamiento_nivel2 IS NULL")
_cy = P["cv_years"]
ORACLE["seasonality_cv_pooled"] = with_facts(["fx_foreign_m"], [], f"""SELECT destino,
    ROUND(STDDEV_SAMP(v) / NULLIF(AVG(v), 0) * 100, 1) AS cv_mensual FROM (
      SELECT destino, fecha, CAST(SUM(turistas) AS DOUBLE) AS v FROM fx_foreign_m
      WHERE year(fecha) BETWEEN {_cy[0]} AND {_cy[1]} GROUP BY 1, 2) s GROUP BY 1""")
ORACLE["period_coverage"] = with_facts(["fx_foreign_m"], [], """SELECT destino, CAST(year(fecha) AS INTEGER) AS anio,
    COUNT(DISTINCT fecha) AS meses_con_datos FROM fx_foreign_m GROUP BY 1, 2""")
_YF = ("yf", """SELECT id_ccaa, destino, CAST(year(fecha) AS INTEGER) AS anio, SUM(turistas) AS turistas
    FROM fx_foreign_m GROUP BY 1, 2, 3""")
_LAGGED = ("yl", """SELECT *, LAG(turistas) OVER (PARTITION BY id_ccaa ORDER BY anio) AS prev,
    LAG(anio) OVER (PARTITION BY id_ccaa ORDER BY anio) AS prev_anio FROM yf""")
ORACLE["yoy_lag"] = with_facts(["fx_foreign_m"], [_YF, _LAGGED], f"""SELECT destino, anio, CAST(turistas AS BIGINT) AS turistas,
    CAST(CASE WHEN prev_anio = anio - 1 THEN prev END AS BIGINT) AS turistas_anterior,
    {growth('turistas', 'CASE WHEN prev_anio = anio - 1 THEN prev END')} AS crecimiento_pct FROM yl""")
ORACLE["yoy_growth_pct"] = with_facts(["fx_foreign_m"], [_YF, _LAGGED], f"""SELECT destino, anio,
    CAST(turistas AS BIGINT) AS turistas, CAST(prev AS BIGINT) AS turistas_anterior,
    {growth('turistas', 'prev')} AS crecimiento_pct FROM yl""")
ORACLE["filter_entity_list"] = with_facts(["fx_foreign_m"], [],
                                          f"SELECT * FROM fx_foreign_m WHERE destino IN {in_list(P['focus'])}")
ORACLE["filter_year_range"] = with_facts(["fx_trips_q"], [],
                                         f"SELECT * FROM fx_trips_q WHERE anio BETWEEN {_cy[0]} AND {_cy[1]}")
ORACLE["classify_seasonality_level"] = f"""SELECT destino, cv_nac_trimestral, cv_ext_mensual, nivel_estacionalidad
    FROM ({BASE_ORACLE['q02_scorecard']}) s"""
ORACLE["classify_destination"] = f"""SELECT destino, viajes_nac, turistas_ext, pct_ocio_nacional, clasificacion
    FROM ({BASE_ORACLE['q02_scorecard']}) s"""
ORACLE["grain_bridge_year"] = with_facts(["fx_foreign_m", "fx_spend_y"], [_YF], f"""SELECT y.destino, y.anio,
    CAST(y.turistas AS BIGINT) AS turistas, CAST(g.gasto_medio AS DOUBLE) AS gasto_medio,
    CAST(y.turistas * g.gasto_medio AS DOUBLE) AS gasto_estimado
    FROM yf y JOIN (SELECT id_ccaa, anio, MAX(CASE WHEN metrica = {q(V.SPEND_PER_PERSON)} THEN valor END) AS gasto_medio
                    FROM fx_spend_y GROUP BY 1, 2) g ON y.id_ccaa = g.id_ccaa AND y.anio = g.anio""")
ORACLE["coverage_flag"] = with_facts(["fx_foreign_m"], [], f"""SELECT destino, COUNT(DISTINCT month(fecha)) AS meses_con_datos,
    COUNT(DISTINCT month(fecha)) >= 11 AS fiable FROM fx_foreign_m WHERE year(fecha) = {Y} GROUP BY 1""")
ORACLE["low_season_windows"] = f"SELECT * FROM ({BASE_ORACLE['q01_monthly_share']}) s WHERE pct_del_anual < 7.5"
_l1 = f"crec_ext_{PTS[0] % 100:02d}_{PTS[1] % 100:02d}"
_l2 = f"crec_ext_{PTS[1] % 100:02d}_{PTS[2] % 100:02d}"
ORACLE["growth_regime"] = f"""SELECT destino, {_l1}, {_l2},
    CASE WHEN {_l1} > 0 AND {_l2} > 0 THEN 'estructural' WHEN {_l1} <= 0 AND {_l2} > 0 THEN 'rebote'
         WHEN {_l2} < 0 THEN 'retroceso' WHEN {_l2} = 0 THEN 'estable' END AS regimen
    FROM ({BASE_ORACLE['q10_emerging']}) s"""


def _band(key, col, name):
    cuts, labels = BANDS[key]
    whens = " ".join(f"WHEN {col} < {c} THEN {q(l)}" for c, l in zip(cuts, labels))
    return (f"SELECT destino, {col}, CASE WHEN {col} IS NULL THEN NULL {whens} ELSE {q(labels[-1])} END AS {name} "
            f"FROM ({BASE_ORACLE['q11_capacity_demand']}) s")


ORACLE["pressure_band"] = _band("pressure", "presion_comercial", "banda_presion")
ORACLE["stay_band"] = _band("stay", "estancia_media", "banda_estancia")
ORACLE["dependence_band"] = _band("dependence", "pct_extranjero", "banda_dependencia")

# ---- mergeable states: the same over all rows ------------------------------------------
ORACLE["coverage_merged"] = with_facts(["fx_foreign_m"], [], """SELECT destino, CAST(year(fecha) AS INTEGER) AS anio,
    COUNT(DISTINCT month(fecha)) AS meses_con_datos, COUNT(DISTINCT month(fecha)) >= 12 AS fiable FROM fx_foreign_m GROUP BY 1, 2""")
ORACLE["absent_months"] = with_facts(["fx_foreign_m"], [], """SELECT y.destino, y.anio, CAST(m.mes AS INTEGER) AS mes
    FROM (SELECT DISTINCT destino, CAST(year(fecha) AS INTEGER) AS anio FROM fx_foreign_m) y, range(1, 13) m(mes)
    WHERE NOT EXISTS (SELECT 1 FROM fx_foreign_m f WHERE f.destino = y.destino AND year(f.fecha) = y.anio AND month(f.fecha) = m.mes)""")
ORACLE["seasonality_cv_merged"] = ORACLE["seasonality_cv_pooled"]

# ---- dense calendar: every region with every month of its span --------------------------
_SPARSE = ("sparse", "SELECT * FROM fx_foreign_m WHERE (month(fecha) + id_ccaa) % 5 <> 0")


def _dense(source, lo, hi, value):
    """Months from lo to hi of each region, by month number; ``value`` of a month without rows."""
    return ("dense", f"""SELECT e.destino, CAST(make_date(e.k // 12, e.k % 12 + 1, 1) AS DATE) AS fecha,
        CASE WHEN h.n IS NULL THEN {value} ELSE h.turistas END AS turistas, h.n IS NULL AS ausente
      FROM (SELECT destino, unnest(range({lo}, {hi} + 1)) AS k FROM {source} GROUP BY destino) e
      LEFT JOIN (SELECT destino, year(fecha) * 12 + month(fecha) - 1 AS k, COUNT(*) AS n, CAST(SUM(turistas) AS BIGINT) AS turistas
                 FROM {source} GROUP BY 1, 2) h ON h.destino = e.destino AND h.k = e.k""")


_number = "year(fecha) * 12 + month(fecha) - 1"
_own = _dense("sparse", f"MIN({_number})", f"MAX({_number})", "NULL")
ORACLE["dense_calendar"] = with_facts(["fx_foreign_m"], [_SPARSE, _own], "SELECT * FROM dense")
ORACLE["dense_calendar_zero"] = with_facts(["fx_foreign_m"], [
    _SPARSE, ("spanned", f"SELECT * FROM sparse WHERE year(fecha) BETWEEN {PTS[0]} AND {PTS[2]}"),
    _dense("spanned", PTS[0] * 12, PTS[2] * 12 + 11, "0")], "SELECT * FROM dense")
ORACLE["growth_by_calendar"] = with_facts(["fx_foreign_m"], [_SPARSE, _own], f"""SELECT a.destino, a.fecha, a.turistas, b.turistas AS anterior,
    {growth('a.turistas', 'b.turistas')} AS crecimiento_pct
    FROM dense a LEFT JOIN dense b ON b.destino = a.destino AND b.fecha = a.fecha - INTERVAL 12 MONTH""")

ORACLE["q03_from_sql"] = BASE_ORACLE["q03_motive_share"]
ORACLE["q07_from_sql"] = BASE_ORACLE["q07_spend_compare"]
