"""Registered measures and dashboard page datasets over the bound facts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewise import vocab as V
from tidewise.plans import measures as M
from tidewise.plans.registry import P, YEAR, demand, facts, register, trips

GRID = {"index_cut": 0.10, "share_cut": 0.75}
CLASS_COLUMNS = ["destino", "anio", "indice_estacionalidad", "pct_turistas_extranjeros", "clasificacion"]
Y, BASE = P["last_year"], P["base_year"]
G0, G1 = P["pre_year"], P["last_year"]
POINTS = [(G0, G0), (G1, G1)]
HOTEL_GROUP = ("Hotelero", (V.GRID_CLASSES[0],))
RURAL_GROUP = ("Turismo rural", (V.GRID_CLASSES[3], V.GRID_CLASSES[2]))
CAMPING_GROUP = ("Camping", (V.GRID_CLASSES[3], V.GRID_CLASSES[2]))


def _tf(spark, d, years=None):
    (f,) = facts(spark, d, "foreign_motives", years=years)
    return trips(spark, d, V.TRIPS, years=years), f


def _totals(spark, d, quarterly=False, years=None):
    t, f = _tf(spark, d, years)
    return M.tourism_totals(t, f, quarterly)


def _classes(spark, d):
    t, f = _tf(spark, d, YEAR)
    return M.classification_fixed(t, f, Y, **GRID)


@register("m_foreign_total")
def _m1(spark, d):
    (f,) = facts(spark, d, "foreign_motives")
    return f.groupBy("destino", F.year("fecha").alias("anio")).agg(
        F.sum("turistas").alias("total_turistas_extranjeros"))


@register("m_domestic_total")
def _m2(spark, d):
    return (trips(spark, d, V.TRIPS).groupBy("destino", "anio")
            .agg(F.sum("valor").cast("double").alias("total_viajes_nacionales")))


@register("m_total")
def _m3(spark, d):
    return _totals(spark, d).drop("id_ccaa")


@register("m_top5_share")
def _m4(spark, d):
    return M.top5_share(_totals(spark, d))


@register("m_quarter_share")
def _m5(spark, d):
    return M.quarter_share(_totals(spark, d, True)).select(
        "destino", "anio", "trimestre", "total_turismo", "pct_trimestral")


@register("m_foreign_share")
def _m6(spark, d):
    return M.foreign_share(_totals(spark, d)).select("destino", "anio", "pct_turistas_extranjeros")


@register("m_seasonality_index")
def _m7(spark, d):
    return M.seasonality_index(_totals(spark, d, True)).drop("id_ccaa")


@register("m_classification")
def _m8(spark, d):
    t, f = _tf(spark, d)
    return M.classification(t, f, **GRID).select(CLASS_COLUMNS)


@register("m_classification_blank_as_zero")
def _m8b(spark, d):
    t, f = _tf(spark, d)
    return M.classification(t, f, **GRID, blank_as_zero=True).select(CLASS_COLUMNS)


@register("m_classification_fixed")
def _m9(spark, d):
    return _classes(spark, d)


def _active(choice):
    return lambda spark, d: M.active_metric(_totals(spark, d), choice).select("destino", "anio", "metrica_activa")


register("m_active_metric")(_active(None))
register("m_active_metric_foreign")(_active(V.METRIC_CHOICES[1]))
register("m_active_metric_domestic")(_active(V.METRIC_CHOICES[2]))


@register("m_indexed")
def _m11(spark, d):
    return M.indexed(_totals(spark, d), BASE).select("destino", "anio", "metrica_activa", "metrica_indexada")


@register("m_growth")
def _m12(spark, d):
    return M.growth(_totals(spark, d, years=POINTS), G0, G1).drop("id_ccaa")


@register("m_total_year")
def _m13(spark, d):
    return M.total_year(_totals(spark, d, years=YEAR), Y).drop("id_ccaa")


@register("m_growth_filtered")
def _m14(spark, d):
    t, f = _tf(spark, d, POINTS)
    return M.growth_filtered(M.tourism_totals(t, f), f, G0, G1, V.METRIC_CHOICES[1]).drop("id_ccaa")


RESIDENCES = {"": None, "_national": V.NATIONAL, "_foreign": V.FOREIGN}


def _travellers(residence):
    def run(spark, d):
        m = demand(spark, d, V.TRAVELLERS)
        return M.travellers(M.with_year(m), ["destino", "tipo_alojamiento", "anio"], residence)
    return run


def _lodging_index(residence):
    def run(spark, d):
        m = demand(spark, d, V.TRAVELLERS)
        return M.lodging_index(m, BASE, residence)
    return run


for _suffix, _residence in RESIDENCES.items():
    register(f"m_travellers{_suffix}")(_travellers(_residence))
    register(f"m_lodging_index{_suffix}")(_lodging_index(_residence))


@register("m_accommodation_mix")
def _m17(spark, d):
    return M.accommodation_mix(demand(spark, d, V.TRAVELLERS))


@register("m_non_market_share")
def _m18(spark, d):
    (r,) = facts(spark, d, "residents", years=YEAR)
    return M.non_market_share(r, Y)


@register("dim_calendar")
def _m19(spark, d):
    c, m = facts(spark, d, "capacity", "demand")
    return M.calendar(c, m)


@register("m_occupancy")
def _m20(spark, d):
    (c,) = facts(spark, d, "capacity")
    return M.occupancy_rate(demand(spark, d, V.NIGHTS), c, ["destino", "tipo_alojamiento", "anio"])


@register("m_occupancy_group")
def _m21(spark, d):
    return _group_occ(spark, d, HOTEL_GROUP)


# ---- dashboard page datasets -------------------------------------------------------

@register("p1_volume_ranking")
def _p1(spark, d):
    t = _totals(spark, d)
    w = Window.partitionBy("anio").orderBy(F.col("total_turismo").desc())
    return t.select("destino", "anio", "total_turismo", F.dense_rank().over(w).alias("ranking"))


@register("p1_quarter_heatmap")
def _p2(spark, d):
    return M.quarter_share(_totals(spark, d, True, YEAR)).select("destino", "trimestre", "pct_trimestral")


@register("p1_quarter_heatmap_totals")
def _p2t(spark, d):
    return M.quarter_matrix(*_tf(spark, d, YEAR)).drop("anio")


@register("p1_kpis")
def _p3(spark, d):
    return M.tourism_kpis(_totals(spark, d, years=YEAR))


@register("p2_scatter")
def _p4(spark, d):
    t, f = _tf(spark, d, YEAR)
    return M.classification_of_year(t, f, Y, **GRID).select(
        "destino", "indice_estacionalidad", "pct_turistas_extranjeros", "total_turismo",
        F.col("clasificacion").alias("clasificacion_col"))


@register("p2_table")
def _p5(spark, d):
    t, f = _tf(spark, d, YEAR)
    return M.classification_of_year(t, f, Y, **GRID).select("destino", "clasificacion", "pct_turistas_extranjeros")


@register("p3_group_evolution")
def _p6(spark, d):
    t = _totals(spark, d, years=[P["evo_years"]])
    j = t.join(_classes(spark, d).drop("destino"), "id_ccaa")
    return j.groupBy("clasificacion_col", "anio").agg(F.sum("total_turismo").alias("volumen"))


def _growth_scatter(choice):
    def run(spark, d):
        return M.growth_scatter(*_tf(spark, d, POINTS), G0, G1, Y, choice, **GRID)
    return run


register("p3_growth_scatter")(_growth_scatter(None))
register("p3_growth_scatter_foreign")(_growth_scatter(V.METRIC_CHOICES[1]))


@register("p4_lodging_index")
def _p8(spark, d):
    return M.lodging_index(demand(spark, d, V.TRAVELLERS), BASE, exclude_types=("Albergue",))


@register("p4_lodging_mix")
def _p9(spark, d):
    return M.accommodation_mix(demand(spark, d, V.TRAVELLERS, years=YEAR), keys=("destino",))


def _group_occ(spark, d, group, by=()):
    (c,) = facts(spark, d, "capacity", years=YEAR)
    return M.occupancy_group(demand(spark, d, V.NIGHTS, years=YEAR), c, _classes(spark, d), *group, Y, by=by)


@register("p5_rural_occupancy")
def _p10(spark, d):
    return _group_occ(spark, d, RURAL_GROUP, ("destino",))


@register("p5_camping_occupancy")
def _p11(spark, d):
    return _group_occ(spark, d, CAMPING_GROUP, ("destino",))


@register("p5_kpis")
def _p12(spark, d):
    (c,) = facts(spark, d, "capacity", years=YEAR)
    return M.occupancy_kpis(demand(spark, d, V.NIGHTS, years=YEAR), c, _classes(spark, d), dict([HOTEL_GROUP, RURAL_GROUP]), Y)
