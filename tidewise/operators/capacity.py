"""Capacity versus demand: mean beds by type, commercial pressure, occupancy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewise.functions.ratios import _rounded_int, round_div
from tidewise.operators.common import as_list, col


def days_in_month(fecha) -> F.Column:
    return F.dayofmonth(F.last_day(col(fecha)))


def mean_by_type(df: DataFrame, keys, type_col, value, types: dict, prefix: str) -> DataFrame:
    """ROUND(AVG(CASE WHEN type = t THEN value END)) per type, exact half away from zero."""
    t = col(type_col)
    aggs = []
    for a, name in types.items():
        hit = t == name
        aggs += [F.sum(F.when(hit, col(value))).alias(f"_s_{a}"),
                 F.count(F.when(hit, col(value))).alias(f"_c_{a}")]
    g = df.groupBy(*as_list(keys)).agg(*aggs)
    return g.select(*as_list(keys), *[
        _rounded_int(f"_s_{a}", f"_c_{a}", 1).cast("bigint").alias(f"{prefix}{a}") for a in types])


def demand_by_residence(demand: DataFrame, keys, mode: str = "parts",
                        travellers: str = "Viajeros", nights: str = "Pernoctaciones",
                        national: str = "Nacional", foreign: str = "Extranjero") -> DataFrame:
    """Travellers by residence, total travellers and nights in one aggregation.

    ``mode='parts'`` sums the residence rows (a suppressed part is simply absent);
    ``mode='total_row'`` takes totals from the pre-aggregated rows (residence NULL).
    """
    m, r, v = F.col("metrica"), F.col("residencia"), F.col("valor")
    is_t, is_n = m == travellers, m == nights
    scope = r.isNotNull() if mode == "parts" else r.isNull()
    d = demand.where(m.isin(travellers, nights))
    return d.groupBy(*as_list(keys)).agg(
        F.sum(F.when(is_t & (r == national), v)).alias("viajeros_nac"),
        F.sum(F.when(is_t & (r == foreign), v)).alias("viajeros_ext"),
        F.sum(F.when(is_t & scope, v)).alias("viajeros_total"),
        F.sum(F.when(is_n & scope, v)).alias("pernoctaciones_total"))


def _nights_and_beds(demand: DataFrame, capacity: DataFrame, keys, nights: str) -> DataFrame:
    """Nights (total rows) and bed-days as rows of one frame, for one aggregation without a join."""
    n = (demand.where((F.col("metrica") == nights) & F.col("residencia").isNull())
         .select(*keys, F.col("valor").cast("bigint").alias("_n"), F.lit(None).cast("bigint").alias("_b")))
    b = capacity.select(*keys, F.lit(None).cast("bigint").alias("_n"),
                        (F.col("plazas") * days_in_month("fecha")).cast("bigint").alias("_b"))
    return n.unionByName(b)


def occupancy(demand: DataFrame, capacity: DataFrame, keys, align: bool = False,
              nights: str = "Pernoctaciones", name: str = "tasa_ocupacion",
              decimals: int = 6) -> DataFrame:
    """Nights (total rows) / SUM(beds x days in month), both summed over ``keys``.

    One row per distinct key, NULL keys included. With ``align`` the bed-days only
    count months that also have nights.
    """
    keys = as_list(keys)
    months = [*keys, *([] if "fecha" in keys else ["fecha"])] if align else keys
    cells = _nights_and_beds(demand, capacity, months, nights)
    if align:
        cells = cells.groupBy(*months).agg(F.sum("_n").alias("_n"), F.sum("_b").alias("_b"))
        cells = cells.withColumn("_b", F.when(F.col("_n").isNotNull(), F.col("_b")))
    a = cells.groupBy(*keys).agg(F.sum("_n").alias("pernoctaciones"), F.sum("_b").alias("plazas_dia"))
    return a.withColumn(name, round_div("pernoctaciones", "plazas_dia", decimals))


def occupancy_in_regions(demand: DataFrame, capacity: DataFrame, regions: DataFrame, keys,
                         nights: str = "Pernoctaciones", name: str = "tasa_ocupacion", decimals: int = 6) -> DataFrame:
    """:func:`occupancy` over the regions (id_ccaa) given: both facts meet first, so the regions are joined once, to region sums."""
    keys = as_list(keys)
    both = list(dict.fromkeys(["id_ccaa", *keys]))
    cells = (_nights_and_beds(demand, capacity, both, nights).groupBy(*both)
             .agg(F.sum("_n").alias("_n"), F.sum("_b").alias("_b")).join(regions, "id_ccaa", "left_semi"))
    a = cells.groupBy(*keys).agg(F.sum("_n").alias("pernoctaciones"), F.sum("_b").alias("plazas_dia"))
    return a.withColumn(name, round_div("pernoctaciones", "plazas_dia", decimals))


def occupancy_of_groups(demand: DataFrame, capacity: DataFrame, regions: DataFrame, groups: dict,
                        nights: str = "Pernoctaciones", name: str = "tasa_ocupacion", decimals: int = 6) -> DataFrame:
    """Occupancy KPI of several groups in one pass: always one row per group, blank without data.

    ``groups`` maps an accommodation type to the region classes that count for it;
    ``regions`` has (id_ccaa, clasificacion_col). Cells are summed by region and type first.
    """
    t = F.col("tipo_alojamiento")
    wanted = t.isin(*groups)
    cells = (_nights_and_beds(demand.where(wanted), capacity.where(wanted), ["id_ccaa", "tipo_alojamiento"], nights)
             .groupBy("id_ccaa", "tipo_alojamiento").agg(F.sum("_n").alias("_n"), F.sum("_b").alias("_b"))
             .join(regions.select("id_ccaa", "clasificacion_col"), "id_ccaa"))
    member = reduce(lambda a, b: a | b, [(t == k) & F.col("clasificacion_col").isin(*c) for k, c in groups.items()])
    empty = demand.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(k) for k in groups])).alias("grupo"), F.lit(None).cast("bigint").alias("_n"),
        F.lit(None).cast("bigint").alias("_b"))
    a = (cells.where(member).select(t.alias("grupo"), "_n", "_b").unionByName(empty)
         .groupBy("grupo").agg(F.sum("_n").alias("pernoctaciones"), F.sum("_b").alias("plazas_dia")))
    return a.withColumn(name, round_div("pernoctaciones", "plazas_dia", decimals))
