"""Mergeable states, dense calendars, matrix totals and the SQL interface on hand-made rows."""

import datetime as dt
import random
import re
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidewise.functions.parse import parse_number_es, split_code_label
from tidewise.functions.ratios import pct, round_div_decimal
from tidewise.operators import calendar as CA
from tidewise.operators import states as ST
from tidewise.operators.seasonality import coverage_flag, cv_pooled
from tidewise.plans import measures as M
from tidewise.plans.registry_blocks import SQL_Q03
from tidewise.sources import bindings as B
from tidewise.sources.sql_views import register_functions, run_sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fact(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), dt.date(rng.choice([2019, 2020]), rng.randrange(1, 13), 1), rng.choice([None, *range(50)])) for _ in range(60)]
    rows += [("d", None, 5), (None, dt.date(2020, 2, 1), 7)]
    return spark.createDataFrame(rows, "e string, f date, v long")


@pytest.mark.parametrize("loads", [1, 2, 5])
def test_states_of_loads_merge_to_the_whole(spark, fact, loads):
    """Loads share months; storing a load again changes nothing."""
    path = tempfile.mkdtemp(prefix="tidewise-state-")
    for k in [*range(loads), 0]:
        part = fact.where(F.pmod(F.xxhash64("e", "f", "v"), F.lit(loads)) == k)
        ST.write_state(ST.month_state(part, "e", "f"), f"{path}/months", f"l{k}")
        ST.write_state(ST.total_state(part, "e", "f", "v"), f"{path}/totals", f"l{k}")
    months, totals = ST.read_states(spark, f"{path}/months"), ST.read_states(spark, f"{path}/totals")
    got = {(r.e, r.anio): r.meses_con_datos for r in ST.coverage(months, "e").collect()}
    dated = fact.where("f is not null")
    assert got == {(r.e, r.y): r.n for r in dated.groupBy("e", F.year("f").alias("y")).agg(F.count_distinct(F.month("f")).alias("n")).collect()}
    pooled = {r.e: (r.meses_con_datos, r.fiable) for r in ST.coverage(months, "e", by_year=False, reliable_months=9).collect()}
    assert pooled == {r.e: (r.meses_con_datos, r.fiable) for r in coverage_flag(dated, "e", "f", 9).collect()}
    lacking = {(r.e, r.anio, r.mes) for r in ST.absent_months(months, "e").collect()}
    assert len(lacking) == sum(12 - n for n in got.values())
    assert not lacking & {(r.e, r.f.year, r.f.month) for r in dated.collect()}
    cv = {r.e: r.cv for r in ST.cv_from_totals(totals, "e", "f").collect()}
    assert cv == {r.e: r.cv for r in cv_pooled(fact, "e", "f", "v").collect()}


def test_dense_calendar_keeps_gaps(spark):
    d = dt.date
    df = spark.createDataFrame([("a", d(2020, 1, 15), 5), ("a", d(2020, 1, 1), 1), ("a", d(2020, 4, 1), None), ("a", d(2021, 1, 1), 9),
                                ("b", d(2020, 2, 1), 3), ("c", None, 4)], "e string, f date, v long")
    got = {(r.e, r.fecha): (r.total, r.ausente) for r in CA.dense_months(df, "e", "f", "v").collect()}
    assert len(got) == 13 + 1 and got["a", d(2020, 1, 1)] == (6, False) and got["a", d(2020, 2, 1)] == (None, True)
    assert got["a", d(2020, 4, 1)] == (None, False)  # rows, but no value
    zero = {(r.e, r.fecha): r.total for r in CA.dense_months(df.where("f is not null"), "e", "f", "v", span=("2020-01-01", "2020-03-01"), fill=0).collect()}
    assert zero == {("a", d(2020, 1, 1)): 6, ("a", d(2020, 2, 1)): 0, ("a", d(2020, 3, 1)): 0,
                    ("b", d(2020, 1, 1)): 0, ("b", d(2020, 2, 1)): 3, ("b", d(2020, 3, 1)): 0}
    assert CA.dense_months(df.limit(0), "e", "f", "v").count() == 0


def test_growth_by_calendar_is_not_the_previous_row(spark):
    d = dt.date
    df = spark.createDataFrame([("a", d(2020, 1, 1), 10), ("a", d(2021, 1, 1), 15), ("a", d(2021, 2, 1), 20), ("a", d(2022, 2, 1), 30)], "e string, f date, v long")
    got = {r.fecha: (r.anterior, r.crecimiento_pct) for r in CA.growth_by_calendar(CA.dense_months(df, "e", "f", "v", "v"), "e", "v").collect()}
    assert got[d(2021, 1, 1)] == (10, 50.0) and got[d(2021, 2, 1)] == (None, None) and got[d(2022, 2, 1)] == (20, 50.0) and got[d(2022, 1, 1)][0] == 15


def test_matrix_totals_are_ratios_of_sums(spark):
    trips = spark.createDataFrame([(1, "A", "Viajes", 2020, 1, 10.0), (1, "A", "Viajes", 2020, 2, 30.0), (2, "B", "Viajes", 2020, 1, 5.0)],
                                  "id_ccaa int, destino string, metrica string, anio int, trimestre int, valor double")
    foreign = spark.createDataFrame([(2, "B", dt.date(2020, 12, 1), 15), (3, "C", dt.date(2020, 5, 1), None)], "id_ccaa int, destino string, fecha date, turistas long")
    out = M.quarter_matrix(trips, foreign)
    got = {(r.destino, r.trimestre): (r.todas_regiones, r.todos_trimestres, r.total_turismo, r.pct_trimestral) for r in out.collect()}
    assert got == {("A", 1): (0, 0, 10.0, 0.25), ("A", 2): (0, 0, 30.0, 0.75), ("A", None): (0, 1, 40.0, 1.0), ("B", 1): (0, 0, 5.0, 0.25),
                   ("B", 4): (0, 0, 15.0, 0.75), ("B", None): (0, 1, 20.0, 1.0), (None, 1): (1, 0, 15.0, 0.25), (None, 2): (1, 0, 30.0, 0.5),
                   (None, 4): (1, 0, 15.0, 0.25), (None, None): (1, 1, 60.0, 1.0)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1 and "Window" not in plan


def test_sql_functions_are_the_library_rules(spark):
    register_functions(spark)
    rng = random.Random(9)
    rows = [(Decimal(rng.randrange(-10 ** 6, 10 ** 6)) / 100, Decimal(rng.choice([0, 1, 3, 300, rng.randrange(-10 ** 5, 10 ** 5)])) / 100) for _ in range(400)]
    rows += [(Decimal("0.01"), Decimal("0.08")), (Decimal("-0.01"), Decimal("0.08")), (None, Decimal("1")), (Decimal("1"), None), (Decimal("0"), Decimal("5"))]
    df = spark.createDataFrame(rows, "a decimal(20,2), b decimal(20,2)")
    out = df.select(F.expr("pct_exact(a, b)").alias("x"), pct("a", "b").alias("y"), F.expr("cociente(a, b, 1000)").alias("z"),
                    round_div_decimal("a", "b", 2, 1000, 24).alias("w")).collect()
    assert all(r.x == r.y and r.z == r.w for r in out)
    texts = spark.createDataFrame([("3.576.058,81",), ("..",), (" . ",), ("",), (None,), ("n.d.",), ("-1,5",), ("01 Andalucía",), ("  16 X",), ("Total",)], "t string")
    code, _ = split_code_label("t")
    for r in texts.select(F.expr("numero_es(t)").alias("x"), parse_number_es("t").alias("y"), F.expr("codigo_region(t)").alias("z"), code.alias("w")).collect():
        assert r.x == r.y and r.z == r.w


def test_sql_parameters_and_pushdown(spark):
    """The year parameter reaches the scan, and a value is never read as SQL."""
    facts = {"residents": B.fx_residents_y(spark, SF)}
    names = dict(total="Total", ocio="Ocio, recreo y vacaciones", negocios="Negocios y otros motivos profesionales", familia="Visitas a familiares o amigos")
    df = run_sql(spark, SQL_Q03, facts, anio=1998, otros="Otros motivos", **names)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"1998", plan) and df.count() > 0
    odd = run_sql(spark, "SELECT count(*) AS n FROM residents WHERE motivo = :m", facts, m="x' OR '1'='1").first().n
    assert odd == 0
