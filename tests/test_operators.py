import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tidewise import vocab as V
from tidewise.plans import measures as M

from tidewise.operators.capacity import demand_by_residence, occupancy
from tidewise.operators.compare import outer_compare
from tidewise.operators.evolution import index_to_base, yoy
from tidewise.operators.seasonality import coverage_flag, cv_fixed_buckets, cv_pooled
from tidewise.operators.shares import hierarchical_share, top_n_share
from tidewise.operators.quality import fuse_marginals, load_audit, split_rejects, tag_rejects


def test_cv_pooled_single_period_is_null(spark):
    df = spark.createDataFrame([("a", 1, 10), ("b", 1, 10), ("b", 2, 30)], "e string, p int, v long")
    got = {r.e: r.cv for r in cv_pooled(df, "e", ["p"], "v").collect()}
    assert got["a"] is None and got["b"] == 70.7


def test_cv_fixed_buckets_missing_bucket_is_zero(spark):
    df = spark.createDataFrame([("a", 1, 4), ("a", 2, 4), ("a", 3, 4)], "e string, q int, v long")
    r = cv_fixed_buckets(df, "e", "q", "v").first()
    assert abs(r.indice_estacionalidad - (3 ** 0.5 / 3)) < 1e-6


def test_yoy_previous_row_and_strict_year(spark):
    df = spark.createDataFrame([("a", 2016, 100), ("a", 2018, 150)], "e string, y int, v long")
    loose = yoy(df, "e", "y", "v", "prev", "g").orderBy("y").collect()
    assert loose[1].prev == 100 and loose[1].g == 50.0
    strict = yoy(df, "e", "y", "v", "prev", "g", strict_year=True).orderBy("y").collect()
    assert strict[1].prev is None and strict[1].g is None


def test_outer_compare_fallback_label(spark):
    a = spark.createDataFrame([(1, "x", 5.0)], "id int, destino string, n double")
    b = spark.createDataFrame([(2, 7.0)], "id int, e double")
    got = {r.destino for r in outer_compare(a, b, "id", "destino").collect()}
    assert got == {"x", "CC.AA. 2"}


def test_hierarchical_share_grain(spark):
    rows = [("r", "Total", None, 100), ("r", "M", None, 60), ("r", "N", None, 40), ("r", "M", "h", 30)]
    df = spark.createDataFrame(rows, "d string, l1 string, l2 string, v long")
    intended = hierarchical_share(df, "d", "l1", "l2", "v", {"pct_h": "h"}).first()
    written = hierarchical_share(df, "d", "l1", "l2", "v", {"pct_h": "h"}, exclude_level1=()).first()
    assert intended.pct_h == 30.0 and written.pct_h == 15.0


def test_top_n_keeps_ties(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", 5), (1, "c", 1)], "y int, e string, v long")
    assert top_n_share(df, "e", "v", 1, by="y").first().share_top == round(10 / 11, 6)


def test_index_to_base(spark):
    df = spark.createDataFrame([("a", 2019, 50), ("a", 2024, 75), ("b", 2024, 9)], "e string, y int, v long")
    got = {(r.e, r.y): r.indice for r in index_to_base(df, "e", "y", "v", 2019).collect()}
    assert got[("a", 2019)] == 100.0 and got[("a", 2024)] == 150.0 and got[("b", 2024)] is None


def test_occupancy_align(spark):
    d = spark.createDataFrame([("r", "Pernoctaciones", None, dt.date(2024, 6, 1), 300)],
                              "k string, metrica string, residencia string, fecha date, valor long")
    c = spark.createDataFrame([("r", dt.date(2024, 6, 1), 10), ("r", dt.date(2024, 7, 1), 10)],
                              "k string, fecha date, plazas long")
    assert occupancy(d, c, ["k"]).first().tasa_ocupacion == round(300 / 610, 6)
    assert occupancy(d, c, ["k"], align=True).first().tasa_ocupacion == 1.0


def test_rejects_and_audit_conserve_rows(spark):
    df = spark.createDataFrame([("1", 1), ("x", None), ("2", None)], "raw string, v int")
    checks = {"bad": F.col("raw") == "x"}
    clean, rej = split_rejects(df, checks, ["raw"])
    assert (clean.count(), rej.count()) == (2, 1)
    a = load_audit({"t": (tag_rejects(df, checks), "v")}).first()
    assert (a.read, a.kept, a.dropped, a.rejected) == (3, 1, 1, 1)


def test_fuse_keeps_rows_of_unknown_overlap(spark):
    a = spark.createDataFrame([("x", "Total")], "d string, l string")
    b = spark.createDataFrame([("y", None), ("z", "Total"), ("w", "M")], "d string, l string")
    assert {r.d for r in fuse_marginals(a, b, F.col("l") == "Total").collect()} == {"x", "y", "w"}


def test_occupancy_joins_unmapped_types(spark):
    d = spark.createDataFrame([("r", None, "Pernoctaciones", None, dt.date(2024, 6, 1), 300)],
                              "k string, t string, metrica string, residencia string, fecha date, valor long")
    c = spark.createDataFrame([("r", None, dt.date(2024, 6, 1), 10)], "k string, t string, fecha date, plazas long")
    rows = occupancy(d, c, ["k", "t"]).collect()
    assert [(r.pernoctaciones, r.plazas_dia, r.tasa_ocupacion) for r in rows] == [(300, 300, 1.0)]


def _foreign(spark, rows):
    return spark.createDataFrame([(1, "r", "m", dt.date(y, m, 1), n) for y, m, n in rows],
                                 "id_ccaa int, destino string, motivo string, fecha date, turistas long")


def _trips(spark, rows):
    return spark.createDataFrame([(i, d, "Viajes", y, q, Decimal(v)) for i, d, y, q, v in rows],
                                 "id_ccaa int, destino string, metrica string, anio int, trimestre int, valor decimal(14,2)")


def test_growth_is_blank_when_month_coverage_differs(spark):
    """Twelve months against eight: the foreign growth is blanked, the total's is not."""
    f = _foreign(spark, [(1997, m, 10) for m in range(1, 13)] + [(2000, m, 10) for m in range(1, 9)])
    t = M.tourism_totals(_trips(spark, [(1, "r", 1997, 1, 5)]), f)
    foreign, total = V.METRIC_CHOICES[1], None
    assert M.growth_filtered(t, f, 1997, 2000, foreign).first().crecimiento_filtrado is None
    assert M.growth_filtered(t, f, 1997, 2000, total).first().crecimiento_filtrado == round(-45 / 125, 6)


def test_growth_with_a_blank_end_or_start(spark):
    t = M.tourism_totals(_trips(spark, [(1, "a", 1997, 1, 8), (2, "b", 2000, 1, 8)]), _foreign(spark, []))
    got = {r.destino: r.crecimiento for r in M.growth(t, 1997, 2000).collect()}
    assert got == {"a": -1.0, "b": None}


def test_populations_of_one_side_only(spark):
    """Regions without domestic or without foreign rows stay, with a blank counted as nothing."""
    t = M.tourism_totals(_trips(spark, [(2, "s", 1997, 1, 8)]), _foreign(spark, [(1997, 1, 3)]))
    got = {r.destino: (r.total_viajes_nacionales, r.total_turistas_extranjeros, r.total_turismo) for r in t.collect()}
    assert got == {"s": (8.0, None, 8.0), "r": (None, 3.0, 3.0)}


def test_classes_with_blanks(spark):
    t, f = _trips(spark, [(2, "s", 1997, q, 8) for q in range(1, 5)]), _foreign(spark, [(1997, 1, 3)])
    plain = {r.destino: r.clasificacion for r in M.classification(t, f).collect()}
    zero = {r.destino: r.clasificacion for r in M.classification(t, f, blank_as_zero=True).collect()}
    assert plain == {"s": V.GRID_CLASSES[4], "r": V.GRID_CLASSES[0]}
    assert zero == {"s": V.GRID_CLASSES[3], "r": V.GRID_CLASSES[0]}


def test_kpis_have_one_row_per_group(spark):
    d = spark.createDataFrame([(1, "Hotelero", "Pernoctaciones", None, dt.date(2000, 6, 1), 300)],
                              "id_ccaa int, tipo_alojamiento string, metrica string, residencia string, fecha date, valor long")
    c = spark.createDataFrame([(1, "Hotelero", dt.date(2000, 6, 1), 10), (1, "Camping", dt.date(2000, 6, 1), 10)],
                              "id_ccaa int, tipo_alojamiento string, fecha date, plazas long")
    dim = spark.createDataFrame([(1, "A")], "id_ccaa int, clasificacion_col string")
    got = {r.grupo: (r.pernoctaciones, r.plazas_dia, r.tasa_ocupacion)
           for r in M.occupancy_kpis(d, c, dim, {"Hotelero": ("A",), "Camping": ("B",)}, 2000).collect()}
    assert got == {"Hotelero": (300, 300, 1.0), "Camping": (None, None, None)}


def test_coverage_flag_of_an_incomplete_year(spark):
    f = _foreign(spark, [(2000, m, 1) for m in range(1, 11)])
    assert coverage_flag(f, "destino", "fecha", 11).first().fiable is False
    assert coverage_flag(f, "destino", "fecha", 10).first().fiable is True


def test_missing_residence_part(spark):
    """A suppressed part is absent from the sum of the parts and present in the total row."""
    rows = [(1, "Viajeros", "Nacional", 5), (1, "Viajeros", None, 9), (1, "Pernoctaciones", "Nacional", 7), (1, "Pernoctaciones", None, 12)]
    d = spark.createDataFrame(rows, "id_ccaa int, metrica string, residencia string, valor long")
    parts, total = (demand_by_residence(d, "id_ccaa", m).first() for m in ("parts", "total_row"))
    assert (parts.viajeros_total, parts.pernoctaciones_total, parts.viajeros_ext) == (5, 7, None)
    assert (total.viajeros_total, total.pernoctaciones_total) == (9, 12)
