from decimal import Decimal

from pyspark.sql import functions as F

from tidewise.functions import (band_expr, classify_expr, growth_pct, map_patterns, parse_number_es,
                                parse_period, pct, round_div, split_code_label)
from tidewise.functions.parse import format_number_es
from tidewise.vocab import SURVEY_TYPE_PATTERNS


def _one(spark, expr, data, schema):
    return [r[0] for r in spark.createDataFrame(data, schema).select(expr).collect()]


def test_spanish_numbers_and_missing_markers(spark):
    data = [("10.080.750",), ("3.576.058,81",), ("6,22",), (" . ",), ("..",), ("",), (None,), ("12,5",), ("n.d.",)]
    dec = _one(spark, parse_number_es("s", "decimal(14,2)"), data, "s string")
    assert dec[:3] == [Decimal("10080750.00"), Decimal("3576058.81"), Decimal("6.22")]
    assert dec[3:7] == [None] * 4 and dec[8] is None
    big = _one(spark, parse_number_es("s", "bigint"), data, "s string")
    assert big[0] == 10080750 and big[7] is None          # decimal comma in an integer column


def test_format_then_parse_is_identity(spark):
    df = spark.range(0, 5000).select((F.col("id") * 37.13).cast("decimal(14,2)").alias("v"))
    back = df.select(F.col("v"), parse_number_es(format_number_es("v", 2), "decimal(14,2)").alias("w"))
    assert back.where(F.col("v") != F.col("w")).count() == 0


def test_code_label_without_space_and_bad_code(spark):
    rows = spark.createDataFrame([("  01 Andalucía ",), ("05",), ("Total Nacional",)], "s string")
    code, label = split_code_label("s")
    out = rows.select(code, label).collect()
    assert tuple(out[0]) == (1, "Andalucía")
    assert tuple(out[1]) == (5, "05")
    assert out[2][0] is None


def test_periods(spark):
    df = spark.createDataFrame([("2025T3", "2026M01", "2024")], "q string, m string, y string")
    q, m, y = parse_period("q", "quarter"), parse_period("m", "month"), parse_period("y", "year")
    r = df.select(q["anio"], q["trimestre"], q["fecha"], m["fecha"], y["anio"]).first()
    assert (r[0], r[1], str(r[2]), str(r[3]), r[4]) == (2025, 3, "2025-07-01", "2026-01-01", 2024)


def test_exact_ratio_rounding_and_nulls(spark):
    df = spark.createDataFrame([(667, 2000), (-667, 2000), (1, 0), (None, 5), (1, 3)], "a long, b long")
    got = _one(spark, pct("a", "b"), df.collect(), "a long, b long")
    assert got == [33.4, -33.4, None, None, 33.3]       # 33.35 exactly -> half away from zero
    assert _one(spark, round_div("a", "b", 2), [(1001, 200)], "a long, b long") == [5.01]
    assert _one(spark, growth_pct("a", "b"), [(110, 100)], "a long, b long") == [10.0]


def test_classify_null_falls_through(spark):
    df = spark.createDataFrame([(10.0,), (None,), (50.0,)], "cv double")
    lab = classify_expr([(F.col("cv") < 25, "Baja"), (F.col("cv") < 40, "Media")], "Alta")
    assert _one(spark, lab, df.collect(), "cv double") == ["Baja", "Alta", "Alta"]
    band = band_expr("cv", (20, 40), ("a", "b", "c"))
    assert _one(spark, band, df.collect(), "cv double") == ["a", None, "c"]


def test_first_pattern_wins(spark):
    names = [("Encuesta de Ocupación Hotelera",), ("Encuesta de Ocupación en Campings",), ("Otra",)]
    got = _one(spark, map_patterns("s", SURVEY_TYPE_PATTERNS), names, "s string")
    assert got == ["Hotelero", "Camping", None]
