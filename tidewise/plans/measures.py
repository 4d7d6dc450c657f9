"""Dashboard measures as DataFrame operators.

A BI measure is evaluated in a filter context; here the context is explicit:
grouping keys (region, year, quarter, type), a filter, or a window partition
for "remove this filter" totals. Ratios of counts are exact (6 decimals).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewise import vocab as V
from tidewise.functions.labels import classify_expr
from tidewise.functions.ratios import round_div
from tidewise.operators.capacity import occupancy, occupancy_in_regions, occupancy_of_groups
from tidewise.operators.common import as_list, year_in, year_is
from tidewise.operators.evolution import index_to_base
from tidewise.operators.seasonality import cv_fixed_buckets, period_coverage
from tidewise.operators.shares import top_n_share

R6 = 6


def ratio6(a, b):
    return round_div(a, b, R6)


def _sum_or_null(*cols):
    """BLANK + x = x; BLANK + BLANK = BLANK."""
    total = None
    for c in cols:
        total = F.coalesce(c, F.lit(0.0)) if total is None else total + F.coalesce(c, F.lit(0.0))
    return F.when(F.coalesce(*cols).isNotNull(), total)


def tourism_totals(trips: DataFrame, foreign: DataFrame, quarterly: bool = False) -> DataFrame:
    """Domestic trips, foreign visitors and their total per region and year (or quarter)."""
    k = ["id_ccaa", "destino", "anio"] + (["trimestre"] if quarterly else [])
    none = F.lit(None)
    dom = trips.where(F.col("metrica") == V.TRIPS).select(
        *k, F.col("valor").cast("decimal(20,2)").alias("_d"), none.cast("bigint").alias("_e"))
    fk = [F.col("id_ccaa"), F.col("destino"), F.year("fecha").alias("anio")]
    if quarterly:
        fk.append(F.quarter("fecha").alias("trimestre"))
    ext = foreign.select(*fk, none.cast("decimal(20,2)").alias("_d"), F.col("turistas").alias("_e"))
    both = dom.unionByName(ext).groupBy(*k).agg(
        F.sum("_d").cast("double").alias("total_viajes_nacionales"),
        F.sum("_e").cast("double").alias("total_turistas_extranjeros"))
    return both.withColumn("total_turismo", _sum_or_null(F.col("total_viajes_nacionales"),
                                                      F.col("total_turistas_extranjeros")))


def _tourism_rows(trips: DataFrame, foreign: DataFrame, *keys: str, month: bool = False) -> DataFrame:
    """Rows of both populations with their region, year and quarter; ``month`` adds the bit of a foreign row's month."""
    none = F.lit(None)
    own = [*keys, "destino"]
    bit = F.call_function("shiftleft", F.lit(1), F.month("fecha") - 1)
    dom = trips.where(F.col("metrica") == V.TRIPS).select(
        *own, "anio", "trimestre", F.col("valor").cast("decimal(20,2)").alias("_d"), none.cast("bigint").alias("_e"),
        *([none.cast("int").alias("_m")] if month else []))
    ext = foreign.select(*own, F.year("fecha").alias("anio"), F.quarter("fecha").alias("trimestre"),
                         none.cast("decimal(20,2)").alias("_d"), F.col("turistas").alias("_e"), *([bit.alias("_m")] if month else []))
    return dom.unionByName(ext)


def quarter_matrix(trips: DataFrame, foreign: DataFrame) -> DataFrame:
    """Quarter totals and shares of every region with the totals of a matrix: of regions, of quarters and of all.

    (anio, destino, trimestre, todas_regiones, todos_trimestres, total_turismo, pct_trimestral). GROUPING SETS make the
    region rows and the row of all regions in one shuffle; the four quarters and their total are aggregates of the same row. So
    each share, those of the totals too, is a ratio of sums, never a sum or mean of shares.
    """
    def total(condition):
        return _sum_or_null(*[F.sum(F.when(condition, F.col(c))).cast("double") for c in ("_d", "_e")])

    quarters = [total(F.col("trimestre") == q).alias(f"_q{q}") for q in range(1, 5)]
    rows = _tourism_rows(trips, foreign).groupingSets([["anio", "destino"], ["anio"]], "anio", "destino").agg(
        F.grouping("destino").cast("int").alias("todas_regiones"), total(F.lit(True)).alias("_all"), *quarters)
    cells = [F.struct(F.lit(q).cast("int").alias("trimestre"), F.lit(0).alias("todos_trimestres"), F.col(f"_q{q}").alias("total_turismo")) for q in range(1, 5)]
    cells.append(F.struct(F.lit(None).cast("int").alias("trimestre"), F.lit(1).alias("todos_trimestres"), F.col("_all").alias("total_turismo")))
    long = rows.select("anio", "destino", "todas_regiones", "_all", F.inline(F.array(*cells)))
    return long.where(F.col("total_turismo").isNotNull()).select(
        "anio", "destino", "trimestre", "todas_regiones", "todos_trimestres", "total_turismo", ratio6("total_turismo", "_all").alias("pct_trimestral"))


def foreign_share(totals: DataFrame) -> DataFrame:
    return totals.withColumn("pct_turistas_extranjeros",
                             ratio6("total_turistas_extranjeros", "total_turismo"))


def quarter_share(qtotals: DataFrame) -> DataFrame:
    """Quarter total over the year total of the same region (filter on quarter removed)."""
    year_total = F.sum("total_turismo").over(Window.partitionBy("id_ccaa", "anio"))
    return qtotals.withColumn("pct_trimestral", ratio6("total_turismo", year_total))


def seasonality_index(qtotals: DataFrame) -> DataFrame:
    """Population CV of the four quarter totals per region and year (missing quarter = 0)."""
    return cv_fixed_buckets(qtotals, ["id_ccaa", "destino", "anio"], "trimestre", "total_turismo")


def grid_label(index_col, share_col, index_cut=0.20, share_cut=0.30, blank_as_zero=False):
    """2x2 class; a blank leaves the region unclassified, or counts as 0 with ``blank_as_zero``."""
    s, p = F.col(index_col), F.col(share_col)
    if blank_as_zero:
        s, p = F.coalesce(s, F.lit(0.0)), F.coalesce(p, F.lit(0.0))
    return classify_expr([
        ((s >= index_cut) & (p >= share_cut), V.GRID_CLASSES[0]),
        ((s < index_cut) & (p >= share_cut), V.GRID_CLASSES[1]),
        ((s >= index_cut) & (p < share_cut), V.GRID_CLASSES[2]),
        ((s < index_cut) & (p < share_cut), V.GRID_CLASSES[3])], V.GRID_CLASSES[4])


def classification(trips, foreign, index_cut=0.20, share_cut=0.30, blank_as_zero=False) -> DataFrame:
    """Dynamic 2x2 class per region and year: seasonality index x foreign share.

    Index, share and volume come from one aggregation of the quarter totals.
    """
    quarters = tourism_totals(trips, foreign, quarterly=True)
    also = [F.sum(c).alias(c) for c in ("total_viajes_nacionales", "total_turistas_extranjeros", "total_turismo")]
    years = cv_fixed_buckets(quarters, ["id_ccaa", "destino", "anio"], "trimestre", "total_turismo", also=also)
    return foreign_share(years).withColumn(
        "clasificacion", grid_label("indice_estacionalidad", "pct_turistas_extranjeros", index_cut, share_cut,
                                    blank_as_zero))


def classification_of_year(trips, foreign, year, **grid) -> DataFrame:
    """One year's classification; the facts are cut to the year before anything else."""
    return classification(trips.where(F.col("anio") == year), foreign.where(year_is("fecha", year)), **grid)


def classification_fixed(trips, foreign, year, **grid) -> DataFrame:
    """Class pinned to one year: a labelled region dimension (one row per region)."""
    c = classification_of_year(trips, foreign, year, **grid)
    return c.select("id_ccaa", "destino", F.col("clasificacion").alias("clasificacion_col"))


def active_metric(totals: DataFrame, choice: str | None = None) -> DataFrame:
    """Metric chosen by a selector; an unknown/absent choice falls back to the total."""
    col = {V.METRIC_CHOICES[1]: "total_turistas_extranjeros",
           V.METRIC_CHOICES[2]: "total_viajes_nacionales"}.get(choice, "total_turismo")
    return totals.withColumn("metrica_activa", F.col(col))


def indexed(totals: DataFrame, base: int, choice=None) -> DataFrame:
    return index_to_base(active_metric(totals, choice), "id_ccaa", "anio", "metrica_activa", base, "metrica_indexada", R6)


def growth(totals: DataFrame, y0: int, y1: int, choice=None) -> DataFrame:
    """(end - start) / start; a blank end counts as 0, a blank or zero start gives blank."""
    a = active_metric(totals, choice).where(F.col("anio").isin(y0, y1))
    g = a.groupBy("id_ccaa", "destino").agg(
        F.sum(F.when(F.col("anio") == y0, F.col("metrica_activa"))).alias("_a"),
        F.sum(F.when(F.col("anio") == y1, F.col("metrica_activa"))).alias("_b"))
    return g.select("id_ccaa", "destino", _growth().alias("crecimiento"))


def growth_scatter(trips, foreign, y0: int, y1: int, year: int, choice=None, max_gap: int = 3, **grid) -> DataFrame:
    """Growth from y0 to y1 (blanked as by :func:`growth_filtered`), the metric in ``year`` and the class of that year, by region.

    All of it comes from one frame of quarter totals, with a mask of the months that have foreign rows.
    """
    quarters = (_tourism_rows(trips, foreign, "id_ccaa", month=True).groupBy("id_ccaa", "destino", "anio", "trimestre")
                .agg(F.sum("_d").cast("double").alias("total_viajes_nacionales"), F.sum("_e").cast("double").alias("total_turistas_extranjeros"),
                     F.bit_or("_m").alias("_m")))
    quarters = active_metric(quarters.withColumn("total_turismo", _sum_or_null(
        F.col("total_viajes_nacionales"), F.col("total_turistas_extranjeros"))), choice)

    def in_year(y, column):
        return F.when(F.col("anio") == y, F.col(column))

    also = [F.sum(in_year(y0, "metrica_activa")).alias("_a"), F.sum(in_year(y1, "metrica_activa")).alias("_b"),
            F.sum(in_year(year, "metrica_activa")).alias("total_anio"), F.count_if(F.col("anio") == year).alias("_rows"),
            *[F.sum(in_year(year, c)).alias(c) for c in ("total_turistas_extranjeros", "total_turismo")],
            *[F.coalesce(F.bit_count(F.bit_or(in_year(y, "_m"))), F.lit(0)).alias(f"_m{i}") for i, y in enumerate((y0, y1))]]
    r = foreign_share(cv_fixed_buckets(quarters, ["id_ccaa", "destino"], in_year(year, "trimestre"), "total_turismo", also=also))
    blank = F.lit(choice == V.METRIC_CHOICES[1]) & (F.abs(F.col("_m1") - F.col("_m0")) >= max_gap)
    return r.select("destino", F.when(~blank, _growth()).alias("crecimiento_filtrado"), "total_anio",
                    F.when(F.col("_rows") > 0, grid_label("indice_estacionalidad", "pct_turistas_extranjeros", **grid)).alias("clasificacion_col"))


def _growth():
    """(_b - _a) / _a; a blank end counts as 0, a blank or zero start gives blank."""
    return round_div(F.coalesce(F.col("_b"), F.lit(0.0)) - F.col("_a"), "_a", R6)


def total_year(totals: DataFrame, year: int, choice=None) -> DataFrame:
    return (active_metric(totals, choice).where(F.col("anio") == year)
            .select("id_ccaa", "destino", F.col("metrica_activa").alias("total_anio")))


def growth_filtered(totals, foreign, y0, y1, choice=None, max_gap: int = 3) -> DataFrame:
    """Growth, blanked for the foreign metric when month coverage differs by >= max_gap."""
    cov = period_coverage(foreign.where(year_in("fecha", (y0, y1))),
                          ["id_ccaa", F.year("fecha").alias("anio")], "fecha", "meses")
    gap = cov.groupBy("id_ccaa").agg(F.abs(
        F.coalesce(F.sum(F.when(F.col("anio") == y1, F.col("meses"))), F.lit(0))
        - F.coalesce(F.sum(F.when(F.col("anio") == y0, F.col("meses"))), F.lit(0))).alias("_gap"))
    g = growth(totals, y0, y1, choice).join(gap, "id_ccaa", "left")
    foreign_metric = choice == V.METRIC_CHOICES[1]
    blank = F.lit(foreign_metric) & (F.coalesce(F.col("_gap"), F.lit(0)) >= max_gap)
    return g.select("id_ccaa", "destino", F.when(~blank, F.col("crecimiento")).alias("crecimiento_filtrado"))


def travellers(demand: DataFrame, keys, residence: str | None = None) -> DataFrame:
    """Travellers for one residence, or the pre-aggregated total rows (residence NULL)."""
    r = F.col("residencia")
    d = demand.where((F.col("metrica") == V.TRAVELLERS) & (r.isNull() if residence is None else r == residence))
    return d.groupBy(*as_list(keys)).agg(F.sum("valor").alias("viajeros"))


def with_year(df: DataFrame) -> DataFrame:
    return df.withColumn("anio", F.year("fecha"))


def lodging_index(demand: DataFrame, base: int, residence=None, exclude_types=()) -> DataFrame:
    d = with_year(demand)
    if exclude_types:
        d = d.where(F.coalesce(~F.col("tipo_alojamiento").isin(*exclude_types), F.lit(True)))
    t = travellers(d, ["tipo_alojamiento", "anio"], residence)
    return index_to_base(t, "tipo_alojamiento", "anio", "viajeros", base, "indice_alojamiento", R6)


def accommodation_mix(demand: DataFrame, keys=("destino", "anio"), residence=None) -> DataFrame:
    """Share of each accommodation type in all types, per region (and year)."""
    t = travellers(with_year(demand), list(keys) + ["tipo_alojamiento"], residence)
    total = F.sum("viajeros").over(Window.partitionBy(*keys))
    return t.withColumn("pct_tipo_alojamiento", ratio6("viajeros", total))


def non_market_share(residents: DataFrame, year: int, keys=("destino",)) -> DataFrame:
    r = residents.where((F.col("motivo") == V.TOTAL) & F.col("alojamiento_nivel2").isNull()
                        & (F.col("anio") == year))
    l1 = F.col("alojamiento_nivel1")
    g = r.groupBy(*keys).agg(
        F.sum(F.when(l1.isin(*V.MARKET_LEVEL1), F.col("viajes"))).cast("double").alias("mercado"),
        F.sum(F.when(l1 == V.NON_MARKET, F.col("viajes"))).cast("double").alias("no_mercado"))
    return g.withColumn("pct_no_mercado", ratio6("no_mercado", _sum_or_null(F.col("mercado"), F.col("no_mercado"))))


def calendar(*facts: DataFrame) -> DataFrame:
    """Month calendar spanning the facts' dates: month start, year, quarter, month, days."""
    bounds = None
    for f in facts:
        b = f.select("fecha")
        bounds = b if bounds is None else bounds.unionByName(b)
    span = bounds.agg(F.min("fecha").alias("a"), F.max("fecha").alias("b"))
    m = span.select(F.explode(F.sequence(F.trunc("a", "month"), F.trunc("b", "month"),
                                         F.expr("interval 1 month"))).alias("fecha"))
    return m.select("fecha", F.year("fecha").alias("anio"), F.quarter("fecha").alias("trimestre"),
                    F.month("fecha").alias("mes"), F.dayofmonth(F.last_day("fecha")).alias("dias_mes"))


def occupancy_rate(demand, capacity, keys, align=False) -> DataFrame:
    return occupancy(with_year(demand), with_year(capacity), keys, align)


def _in_months(df: DataFrame, year: int, months) -> DataFrame:
    return df.where(year_is("fecha", year) & F.month("fecha").isin(*months))


def occupancy_group(demand, capacity, classes_dim: DataFrame, acc_type: str, classes, year: int,
                    months=(6, 7, 8), by=()) -> DataFrame:
    """Occupancy for one accommodation type over regions whose fixed class is in ``classes``."""
    if not by:
        return occupancy_kpis(demand, capacity, classes_dim, {acc_type: classes}, year, months)
    regions = classes_dim.where(F.col("clasificacion_col").isin(*classes)).select("id_ccaa")
    d, c = (_in_months(x, year, months).where(F.col("tipo_alojamiento") == acc_type) for x in (demand, capacity))
    return occupancy_in_regions(d, c, regions, list(by))


def occupancy_kpis(demand, capacity, classes_dim: DataFrame, groups: dict, year: int, months=(6, 7, 8)) -> DataFrame:
    """One occupancy figure for each group (type -> classes), all in one pass over both facts."""
    return occupancy_of_groups(_in_months(demand, year, months), _in_months(capacity, year, months), classes_dim, groups)


def tourism_kpis(totals: DataFrame, n: int = 5) -> DataFrame:
    """Both populations' totals and the share of the n largest regions (ties kept), per year, from one pass over the totals."""
    place = F.rank().over(Window.partitionBy("anio").orderBy(F.col("total_turismo").desc_nulls_last()))
    k = totals.withColumn("_rk", place).groupBy("anio").agg(
        F.sum("total_viajes_nacionales").alias("total_viajes_nacionales"), F.sum("total_turistas_extranjeros").alias("total_turistas_extranjeros"),
        F.sum(F.when(F.col("_rk") <= n, F.col("total_turismo"))).alias("_top"), F.sum("total_turismo").alias("_all"))
    return k.select("anio", "total_viajes_nacionales", "total_turistas_extranjeros", ratio6("_top", "_all").alias("pct_top5"))


def top5_share(totals: DataFrame, n: int = 5) -> DataFrame:
    """Share of the n largest regions (ties kept) in the national total, per year."""
    return top_n_share(totals.where(F.col("total_turismo").isNotNull()), "destino", "total_turismo",
                       n, by="anio", name="pct_top5", decimals=R6)
