"""The eleven analytical questions as parametrised DataFrame jobs.

Every function takes clean fact DataFrames plus parameters (years, region list,
thresholds) and returns a lazy DataFrame. Each fact is filtered and aggregated to
region grain before any join, so every join is between region-sized inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewise import vocab as V
from tidewise.functions.labels import classify_expr
from tidewise.functions.ratios import growth_pct, pct, round_div, round_div_decimal
from tidewise.operators.capacity import demand_by_residence, mean_by_type
from tidewise.operators.common import year_between, year_in, year_is
from tidewise.operators.compare import outer_compare
from tidewise.operators.evolution import growth_between, yoy
from tidewise.operators.pivots import eav_pick, pivot_columns
from tidewise.operators.seasonality import cv_sample, monthly_share
from tidewise.operators.shares import hierarchical_share, share_within_group

MAINS = list(V.MAIN_MOTIVES)
DUR = V.DURATION_PREFIX + "%"


def _dbl(c):
    return F.col(c).cast("double").alias(c)


def _leisure_pct(residents: DataFrame, keys, name="pct_ocio") -> DataFrame:
    """Leisure trips as % of the four main motives (motive rows only)."""
    r = residents.where(F.col("alojamiento_nivel1") == V.TOTAL)
    return share_within_group(r, keys, "motivo", "viajes", MAINS, {name: V.LEISURE},
                              total_name="_mains").drop("_mains")


def q01_monthly_share(foreign: DataFrame, years, entities, key="destino") -> DataFrame:
    f = foreign.where(year_between("fecha", *years) & F.col(key).isin(*entities))
    return monthly_share(f, key, "fecha", "turistas").orderBy(key, "mes")


def seasonality_level(cv_nac, cv_ext, low=(25, 50), medium=(40, 80)):
    a, b = F.col(cv_nac), F.col(cv_ext)
    return classify_expr([((a < low[0]) & ((b < low[1]) | b.isNull()), "Baja"),
                          ((a < medium[0]) & ((b < medium[1]) | b.isNull()), "Media")], "Alta")


def destination_class(volume, cv_nac, cv_ext, leisure, massive_volume=20_000_000,
                      massive_cv=(40, 60), alt_cv=30, alt_volume=10_000_000, alt_leisure=70):
    vol, a, b, o = F.col(volume), F.col(cv_nac), F.col(cv_ext), F.col(leisure)
    return classify_expr([
        ((vol >= massive_volume) | ((a >= massive_cv[0]) & (F.coalesce(b, F.lit(0.0)) >= massive_cv[1])),
         "Tradicional masivo"),
        ((a < alt_cv) & (vol < alt_volume) & (o < alt_leisure), "Alternativo")], "Intermedio")


def q02_scorecard(trips, foreign, spend, residents, year, cv_years, level=None,
                  klass=None) -> DataFrame:
    level, klass = level or {}, klass or {}
    # one pass per fact: the CV of its period totals and the year's volume
    quarters = (trips.where(F.col("metrica") == V.TRIPS).groupBy("id_ccaa", "destino", "anio", "trimestre")
                .agg(F.sum("valor").alias("_v")))
    domestic = quarters.groupBy("id_ccaa", "destino").agg(
        F.sum(F.when(F.col("anio") == year, F.col("_v"))).alias("viajes_nac"),
        cv_sample(F.when(F.col("anio").between(*cv_years), F.col("_v"))).alias("cv_nac_trimestral"))
    months = foreign.groupBy("id_ccaa", "fecha").agg(F.sum("turistas").alias("_v"))
    visitors = months.groupBy("id_ccaa").agg(
        F.sum(F.when(year_is("fecha", year), F.col("_v"))).alias("turistas_ext"),
        cv_sample(F.when(year_between("fecha", *cv_years), F.col("_v"))).alias("cv_ext_mensual"))
    spending = eav_pick(spend.where(F.col("anio") == year), "id_ccaa", "metrica", "valor",
                        {"gasto_ext_persona": V.SPEND_PER_PERSON, "noches_ext": DUR})
    leisure = _leisure_pct(residents.where(F.col("anio") == year), "id_ccaa", "pct_ocio_nacional")
    j = (domestic.where(F.col("viajes_nac").isNotNull()).join(visitors, "id_ccaa", "left")
         .join(spending, "id_ccaa", "left").join(leisure, "id_ccaa", "left"))
    both = F.col("viajes_nac") + F.col("turistas_ext")
    vol = F.col("viajes_nac") + F.coalesce(F.col("turistas_ext"), F.lit(0))
    j = j.withColumn("_vol", vol.cast("double"))
    return j.select(
        "destino", _dbl("viajes_nac"), "turistas_ext",
        pct("viajes_nac", both).alias("pct_nacionales"),
        pct("turistas_ext", both).alias("pct_extranjeros"),
        "cv_nac_trimestral", "cv_ext_mensual", _dbl("gasto_ext_persona"), _dbl("noches_ext"),
        "pct_ocio_nacional",
        seasonality_level("cv_nac_trimestral", "cv_ext_mensual", **level).alias("nivel_estacionalidad"),
        destination_class("_vol", "cv_nac_trimestral", "cv_ext_mensual", "pct_ocio_nacional",
                          **klass).alias("clasificacion"),
    ).orderBy(F.col("cv_nac_trimestral").asc_nulls_last())


def q03_motive_share(residents, year) -> DataFrame:
    r = residents.where((F.col("alojamiento_nivel1") == V.TOTAL) & (F.col("anio") == year))
    nums = {"pct_ocio": V.LEISURE, "pct_negocios": V.BUSINESS, "pct_familia": V.FAMILY,
            "pct_otros": V.OTHER}
    return (share_within_group(r, "destino", "motivo", "viajes", MAINS, nums, "total_viajes")
            .orderBy(F.col("pct_ocio").desc_nulls_first()))


def q04_leisure_breakdown(residents, year) -> DataFrame:
    r = residents.where((F.col("alojamiento_nivel1") == V.TOTAL) & (F.col("anio") == year))
    spec = {"total_ocio": V.LEISURE}
    spec.update({f"_{a}": name for a, name in V.LEISURE_SUBMOTIVES})
    agg = r.groupBy("destino").agg(*pivot_columns("motivo", "viajes", spec))
    return agg.select("destino", "total_ocio", *[
        pct(f"_{a}", "total_ocio").alias(f"pct_{a}") for a, _ in V.LEISURE_SUBMOTIVES
    ]).orderBy(F.col("pct_sol_playa").desc_nulls_first())


def q05_foreign_motive_share(foreign, year) -> DataFrame:
    f = foreign.where(year_is("fecha", year))
    spec = {"turistas_total": F.lit(True)}
    spec.update({f"_{a}": pat for a, pat in V.FOREIGN_MOTIVE_PREFIXES})
    agg = f.groupBy("destino").agg(*pivot_columns("motivo", "turistas", spec))
    return agg.select("destino", "turistas_total", *[
        pct(f"_{a}", "turistas_total").alias(f"pct_{a}") for a, _ in V.FOREIGN_MOTIVE_PREFIXES
    ]).orderBy(F.col("pct_ocio").desc_nulls_first())


def q06_lodging_mix(residents, year, exclude_level1=(V.TOTAL,)) -> DataFrame:
    r = residents.where((F.col("motivo") == V.TOTAL) & (F.col("anio") == year))
    types = {f"pct_{a}": name for a, name in V.LODGING_LEVEL2}
    return (hierarchical_share(r, "destino", "alojamiento_nivel1", "alojamiento_nivel2", "viajes",
                               types, {"total_mercado": V.MARKET, "total_no_mercado": V.NON_MARKET},
                               exclude_level1=exclude_level1)
            .orderBy(F.col("pct_hotel").desc_nulls_first()))


def q07_spend_compare(trips, spend, year) -> DataFrame:
    t = trips.where(F.col("anio") == year)
    n = (t.groupBy("id_ccaa", "destino")
         .agg(*pivot_columns("metrica", "valor", {"_gasto": V.SPEND_TOTAL, "_viajes": V.TRIPS}))
         .select("id_ccaa", "destino",
                 round_div_decimal("_gasto", "_viajes", 2, 1000, 24).alias("n_gasto")))
    e = eav_pick(spend.where(F.col("anio") == year), "id_ccaa", "metrica", "valor",
                 {"e_gasto": V.SPEND_PER_PERSON})
    j = outer_compare(n, e, "id_ccaa", "destino")
    return j.select("destino", F.col("n_gasto").cast("double").alias("gasto_medio_nacional_eur"),
                    F.col("e_gasto").cast("double").alias("gasto_medio_extranjero_eur"),
                    growth_pct("e_gasto", "n_gasto").alias("diferencia_pct")
                    ).orderBy(F.col("diferencia_pct").desc_nulls_last())


def _mean_2dp(df, keys, name):
    return df.groupBy(*keys).agg(F.sum("valor").alias("_s"), F.count("valor").alias("_c")).select(
        *keys, round_div_decimal("_s", "_c", 2, 1, 16).alias(name))


def q08_stay_compare(trips, spend, years) -> DataFrame:
    n = _mean_2dp(trips.where(F.col("metrica").like(DUR) & F.col("anio").between(*years)),
                  ["id_ccaa", "destino"], "n_noches")
    e = _mean_2dp(spend.where(F.col("metrica").like(DUR) & F.col("anio").between(*years)),
                  ["id_ccaa"], "e_noches")
    j = outer_compare(n, e, "id_ccaa", "destino")
    return j.select("destino", F.col("n_noches").cast("double").alias("noches_nacional"),
                    F.col("e_noches").cast("double").alias("noches_extranjero"),
                    (F.col("e_noches") - F.col("n_noches")).cast("double").alias("diferencia_noches")
                    ).orderBy(F.col("noches_nacional").desc_nulls_last())


def q09_evolution(trips, foreign, residents, spend, years, entities, key="id_ccaa") -> DataFrame:
    keep = F.col("destino").isin(*entities)
    v = (trips.where((F.col("metrica") == V.TRIPS) & F.col("anio").between(*years) & keep)
         .groupBy(key, "destino", "anio").agg(F.sum("valor").cast("double").alias("viajes_nacionales")))
    t = (foreign.where(year_between("fecha", *years) & keep)
         .groupBy(key, F.year("fecha").alias("anio")).agg(F.sum("turistas").alias("turistas_extranjeros")))
    o = _leisure_pct(residents.where(keep), [key, "anio"])
    g = eav_pick(spend.where(keep), [key, "anio"], "metrica", "valor",
                 {"gasto_medio_ext": V.SPEND_PER_PERSON})
    ev = yoy(v, key, "anio", "viajes_nacionales", "viajes_nac_anterior", "crecimiento_nac_pct")
    j = (ev.join(t, [key, "anio"], "left").join(o, [key, "anio"], "left")
         .join(g, [key, "anio"], "left"))
    return j.select("destino", "anio", "viajes_nacionales", "viajes_nac_anterior",
                    "crecimiento_nac_pct", "turistas_extranjeros", "pct_ocio",
                    _dbl("gasto_medio_ext")).orderBy("destino", "anio")


def q10_emerging(trips, foreign, spend, residents, points) -> DataFrame:
    p1, p2, p3 = points
    yy = lambda y: f"{y % 100:02d}"
    n = growth_between(trips.where(F.col("metrica") == V.TRIPS), ["id_ccaa", "destino"], "anio",
                       "valor", points, "nac_", "crec_nac_")
    e = growth_between(foreign.where(year_in("fecha", points)).withColumn("anio", F.year("fecha")),
                       "id_ccaa", "anio", "turistas", points, "ext_", "crec_ext_")
    g = growth_between(spend.where(F.col("metrica") == V.SPEND_PER_PERSON), "id_ccaa", "anio",
                       "valor", points, "gasto_", agg="max")
    r = residents.where((F.col("alojamiento_nivel1") == V.TOTAL) & F.col("anio").isin(*points))
    y, m = F.col("anio"), F.col("motivo")
    spec = {}
    for p in points:
        spec[f"_o{p}"] = (y == p) & (m == V.LEISURE)
        spec[f"_t{p}"] = (y == p) & m.isin(*MAINS)
    o = r.groupBy("id_ccaa").agg(*pivot_columns(m, "viajes", spec)).select(
        "id_ccaa", *[pct(f"_o{p}", f"_t{p}").alias(f"pct_ocio_{p}") for p in points])
    j = n.join(e, "id_ccaa", "left").join(g, "id_ccaa", "left").join(o, "id_ccaa", "left")
    return j.select(
        "destino", *[_dbl(f"nac_{p}") for p in points],
        f"crec_nac_{yy(p1)}_{yy(p2)}", f"crec_nac_{yy(p2)}_{yy(p3)}",
        *[f"ext_{p}" for p in points],
        f"crec_ext_{yy(p1)}_{yy(p2)}", f"crec_ext_{yy(p2)}_{yy(p3)}",
        _dbl(f"gasto_{p1}"), _dbl(f"gasto_{p3}"),
        growth_pct(f"gasto_{p3}", f"gasto_{p1}").alias("crec_gasto_total_pct"),
        *[f"pct_ocio_{p}" for p in points],
    ).orderBy(F.col(f"crec_ext_{yy(p2)}_{yy(p3)}").desc_nulls_last())


def q11_capacity_demand(capacity, demand, year, mode="parts") -> DataFrame:
    types = dict(V.ACCOMMODATION_TYPES)
    p = mean_by_type(capacity.where(year_is("fecha", year)), ["id_ccaa", "destino"],
                     "tipo_alojamiento", "plazas", types, "plazas_")
    total = F.col("plazas_hotel")
    for a in list(types)[1:]:
        total = total + F.coalesce(F.col(f"plazas_{a}"), F.lit(0))
    p = p.withColumn("plazas_total", total)
    d = demand_by_residence(demand.where(year_is("fecha", year)), "id_ccaa", mode)
    j = p.join(d, "id_ccaa", "left")
    return j.select(
        "destino", *[f"plazas_{a}" for a in types], "plazas_total",
        "viajeros_nac", "viajeros_ext", "viajeros_total",
        round_div("viajeros_total", "plazas_total", 1).alias("presion_comercial"),
        round_div("pernoctaciones_total", "viajeros_total", 2).alias("estancia_media"),
        pct("viajeros_ext", "viajeros_total").alias("pct_extranjero"),
    ).orderBy(F.col("plazas_total").desc_nulls_first())
