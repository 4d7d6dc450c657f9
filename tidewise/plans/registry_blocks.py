"""Registered building-block operators and derived flags over the bound facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewise import vocab as V
from tidewise.functions.labels import band_expr
from tidewise.functions.ratios import pct
from tidewise.operators import calendar as CA
from tidewise.operators import evolution as EV
from tidewise.operators import pivots as PV
from tidewise.operators import seasonality as SE
from tidewise.operators import shares as SH
from tidewise.operators import states as ST
from tidewise.plans import queries as Q
from tidewise.plans.registry import QUERIES, YEAR, P, facts, register, trips
from tidewise.session import scratch_path
from tidewise.sources.sql_views import run_sql

Y = P["last_year"]
MAINS = list(V.MAIN_MOTIVES)
BANDS = {
    "pressure": ((12, 13.5), ("baja", "moderada", "alta")),
    "stay": ((25, 26), ("corta", "media", "larga")),
    "dependence": ((94, 96, 98), ("baja", "media", "alta", "muy alta")),
}


def _yearly_foreign(spark, d):
    (f,) = facts(spark, d, "foreign_motives")
    return f.groupBy("id_ccaa", "destino", F.year("fecha").alias("anio")).agg(F.sum("turistas").alias("turistas"))


@register("safe_ratio_pct")
def _b1(spark, d):
    (r,) = facts(spark, d, "residents")
    m = r.where(F.col("alojamiento_nivel1") == V.TOTAL)
    g = PV.pivot_agg(m, ["destino", "anio"], "motivo", "viajes", {"ocio": V.LEISURE, "total": V.TOTAL})
    return g.select("destino", "anio", pct("ocio", "total").alias("pct_ocio_sobre_total"))


@register("pivot_sum_by_category")
def _b2(spark, d):
    (r,) = facts(spark, d, "residents", years=YEAR)
    m = r.where((F.col("alojamiento_nivel1") == V.TOTAL) & (F.col("anio") == Y))
    return PV.pivot_agg(m, "destino", "motivo", "viajes",
                        {"ocio": V.LEISURE, "negocios": V.BUSINESS, "familia": V.FAMILY, "otros": V.OTHER})


@register("pivot_avg_by_category")
def _b3(spark, d):
    (c,) = facts(spark, d, "capacity", years=YEAR)
    g = PV.pivot_agg(c, "destino", "tipo_alojamiento", "plazas",
                     {f"plazas_{a}": t for a, t in V.ACCOMMODATION_TYPES}, "avg")
    return g.select("destino", *[F.round(f"plazas_{a}", 6).alias(f"plazas_{a}") for a, _ in V.ACCOMMODATION_TYPES])


@register("pivot_by_year")
def _b4(spark, d):
    pts = (P["first_year"], P["pre_year"], P["last_year"])
    g = PV.pivot_by_year(trips(spark, d, V.TRIPS, years=[(y, y) for y in pts]), "destino", "anio", "valor", pts, "viajes_")
    return g.select("destino", *[F.col(f"viajes_{p}").cast("double").alias(f"viajes_{p}") for p in pts])


@register("eav_pick")
def _b5(spark, d):
    (s,) = facts(spark, d, "foreign_spend")
    g = PV.eav_pick(s, ["destino", "anio"], "metrica", "valor",
                    {"gasto_medio": V.SPEND_PER_PERSON, "duracion_media": V.DURATION_PREFIX + "%"})
    return g.select("destino", "anio", F.col("gasto_medio").cast("double").alias("gasto_medio"),
                    F.col("duracion_media").cast("double").alias("duracion_media"))


@register("share_within_group")
def _b6(spark, d):
    (r,) = facts(spark, d, "residents")
    m = r.where(F.col("alojamiento_nivel1") == V.TOTAL)
    return SH.share_within_group(m, ["destino", "anio"], "motivo", "viajes", MAINS,
                                 {"pct_ocio": V.LEISURE, "pct_negocios": V.BUSINESS}, "total_principales")


@register("hierarchical_share")
def _b7(spark, d):
    """Lodging shares with the denominator exactly as first written (grand total counted too)."""
    (r,) = facts(spark, d, "residents", years=YEAR)
    return Q.q06_lodging_mix(r, Y, exclude_level1=())


@register("seasonality_cv_pooled")
def _b8(spark, d):
    (f,) = facts(spark, d, "foreign_motives", years=[P["cv_years"]])
    return SE.cv_pooled(f, "destino", ["fecha"], "turistas",
                        "cv_mensual")


@register("period_coverage")
def _b9(spark, d):
    (f,) = facts(spark, d, "foreign_motives")
    return SE.period_coverage(f, ["destino", F.year("fecha").alias("anio")], "fecha", "meses_con_datos")


@register("yoy_lag")
def _b10(spark, d):
    y = _yearly_foreign(spark, d)
    return EV.yoy(y, "id_ccaa", "anio", "turistas", "turistas_anterior", "crecimiento_pct",
                  strict_year=True).drop("id_ccaa")


@register("yoy_growth_pct")
def _b11(spark, d):
    y = _yearly_foreign(spark, d)
    return EV.yoy(y, "id_ccaa", "anio", "turistas", "turistas_anterior", "crecimiento_pct").drop("id_ccaa")


@register("filter_entity_list")
def _b12(spark, d):
    (f,) = facts(spark, d, "foreign_motives")
    return f.where(F.col("destino").isin(*P["focus"]))


@register("filter_year_range")
def _b13(spark, d):
    (t,) = facts(spark, d, "quarterly_spend", years=[P["cv_years"]])
    return t.where(F.col("anio").between(*P["cv_years"]))


@register("classify_seasonality_level")
def _b14(spark, d):
    return QUERIES["q02_scorecard"](spark, d).select("destino", "cv_nac_trimestral", "cv_ext_mensual",
                                                     "nivel_estacionalidad")


@register("classify_destination")
def _b15(spark, d):
    return QUERIES["q02_scorecard"](spark, d).select("destino", "viajes_nac", "turistas_ext",
                                                     "pct_ocio_nacional", "clasificacion")


@register("grain_bridge_year")
def _b16(spark, d):
    """Monthly fact rolled to the year, bridged to an annual fact on (region, year)."""
    (s,) = facts(spark, d, "foreign_spend")
    y = _yearly_foreign(spark, d)
    g = PV.eav_pick(s, ["id_ccaa", "anio"], "metrica", "valor", {"gasto_medio": V.SPEND_PER_PERSON})
    j = y.join(g, ["id_ccaa", "anio"])
    return j.select("destino", "anio", "turistas", F.col("gasto_medio").cast("double").alias("gasto_medio"),
                    (F.col("turistas") * F.col("gasto_medio")).cast("double").alias("gasto_estimado"))


@register("coverage_flag")
def _f1(spark, d):
    (f,) = facts(spark, d, "foreign_motives", years=YEAR)
    return SE.coverage_flag(f, "destino", "fecha", reliable_months=11)


@register("low_season_windows")
def _f2(spark, d):
    return SE.low_season_windows(QUERIES["q01_monthly_share"](spark, d), threshold=7.5)


@register("growth_regime")
def _f3(spark, d):
    q10 = QUERIES["q10_emerging"](spark, d)
    a, b = (P["first_year"] % 100, P["pre_year"] % 100), (P["pre_year"] % 100, P["last_year"] % 100)
    l1, l2 = f"crec_ext_{a[0]:02d}_{a[1]:02d}", f"crec_ext_{b[0]:02d}_{b[1]:02d}"
    return q10.select("destino", l1, l2, EV.growth_regime(l1, l2).alias("regimen"))


def _band(key, col, name):
    def run(spark, d):
        cuts, labels = BANDS[key]
        q11 = QUERIES["q11_capacity_demand"](spark, d)
        return q11.select("destino", col, band_expr(col, cuts, labels).alias(name))
    return run


register("pressure_band")(_band("pressure", "presion_comercial", "banda_presion"))
register("stay_band")(_band("stay", "estancia_media", "banda_estancia"))
register("dependence_band")(_band("dependence", "pct_extranjero", "banda_dependencia"))


# ---- mergeable states: two loads of one fact, merged without reading the rows again ----

def _two_loads(spark, d, years=None):
    """The foreign fact in two loads that share months: leisure, and the rest."""
    (f,) = facts(spark, d, "foreign_motives", years=years)
    leisure = F.col("motivo") == V.LEISURE
    return {"ocio": f.where(leisure), "resto": f.where(~leisure)}


def _stored(spark, d, name, state, years=None):
    path = scratch_path(spark, f"state-{name}")
    for lot, rows in _two_loads(spark, d, years).items():
        ST.write_state(state(rows), path, lot)
    return ST.read_states(spark, path)


@register("coverage_merged")
def _s1(spark, d):
    return ST.coverage(_stored(spark, d, "months", lambda r: ST.month_state(r, "destino", "fecha")), "destino")


@register("absent_months")
def _s2(spark, d):
    return ST.absent_months(_stored(spark, d, "months", lambda r: ST.month_state(r, "destino", "fecha")), "destino")


@register("seasonality_cv_merged")
def _s3(spark, d):
    states = _stored(spark, d, "totals", lambda r: ST.total_state(r, "destino", "fecha", "turistas"), [P["cv_years"]])
    return ST.cv_from_totals(states, "destino", "fecha", "cv_mensual")


# ---- dense calendar ------------------------------------------------------------------

def _sparse_months(spark, d):
    """The foreign fact without the months whose number and region's code add to a multiple of five, so that there are gaps."""
    (f,) = facts(spark, d, "foreign_motives")
    return f.where((F.month("fecha") + F.col("id_ccaa")) % 5 != 0)


@register("dense_calendar")
def _s4(spark, d):
    return CA.dense_months(_sparse_months(spark, d), "destino", "fecha", "turistas", "turistas")


@register("dense_calendar_zero")
def _s5(spark, d):
    span = (f"{P['first_year']}-01-01", f"{P['last_year']}-12-01")
    f = _sparse_months(spark, d).where(F.year("fecha").between(P["first_year"], P["last_year"]))
    return CA.dense_months(f, "destino", "fecha", "turistas", "turistas", span=span, fill=0)


@register("growth_by_calendar")
def _s6(spark, d):
    dense = CA.dense_months(_sparse_months(spark, d), "destino", "fecha", "turistas", "turistas")
    return CA.growth_by_calendar(dense, "destino", "turistas").drop("ausente")


# ---- queries written in SQL ------------------------------------------------------------

@register("q03_from_sql")
def _s7(spark, d):
    (r,) = facts(spark, d, "residents", years=YEAR)
    return run_sql(spark, SQL_Q03, {"residents": r}, anio=P["last_year"], total=V.TOTAL, ocio=V.LEISURE, negocios=V.BUSINESS, familia=V.FAMILY, otros=V.OTHER)


@register("q07_from_sql")
def _s8(spark, d):
    t = trips(spark, d, V.TRIPS, V.SPEND_TOTAL, years=YEAR)
    (s,) = facts(spark, d, "foreign_spend", years=YEAR)
    return run_sql(spark, SQL_Q07, {"quarterly_spend": t, "foreign_spend": s}, anio=P["last_year"], viajes=V.TRIPS, gasto=V.SPEND_TOTAL,
                   por_persona=V.SPEND_PER_PERSON)


SQL_Q03 = """
WITH t AS (
  SELECT destino, SUM(viajes) FILTER (WHERE motivo IN (:ocio, :negocios, :familia, :otros)) AS total_viajes,
         SUM(viajes) FILTER (WHERE motivo = :ocio) AS o, SUM(viajes) FILTER (WHERE motivo = :negocios) AS n,
         SUM(viajes) FILTER (WHERE motivo = :familia) AS f, SUM(viajes) FILTER (WHERE motivo = :otros) AS x
  FROM residents WHERE anio = :anio AND alojamiento_nivel1 = :total GROUP BY destino)
SELECT destino, total_viajes, pct_exact(o, total_viajes) AS pct_ocio, pct_exact(n, total_viajes) AS pct_negocios,
       pct_exact(f, total_viajes) AS pct_familia, pct_exact(x, total_viajes) AS pct_otros
FROM t"""

SQL_Q07 = """
WITH n AS (
  SELECT id_ccaa, destino, cociente(SUM(valor) FILTER (WHERE metrica = :gasto), SUM(valor) FILTER (WHERE metrica = :viajes), 1000) AS n_gasto
  FROM quarterly_spend WHERE anio = :anio GROUP BY id_ccaa, destino),
e AS (SELECT id_ccaa, MAX(valor) AS e_gasto FROM foreign_spend WHERE anio = :anio AND metrica = :por_persona GROUP BY id_ccaa)
SELECT COALESCE(destino, CONCAT('CC.AA. ', id_ccaa)) AS destino, CAST(n_gasto AS DOUBLE) AS gasto_medio_nacional_eur,
       CAST(e_gasto AS DOUBLE) AS gasto_medio_extranjero_eur, pct_exact(e_gasto - n_gasto, n_gasto) AS diferencia_pct
FROM n FULL JOIN e USING (id_ccaa)"""
