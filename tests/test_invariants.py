"""Properties that hold for any input: shares, totals, independence of the partitioning."""

import pytest
from pyspark.sql import functions as F

from tidewise.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key,keys,share", [
    ("q01_monthly_share", ["destino"], "pct_del_anual"), ("m_quarter_share", ["destino", "anio"], "pct_trimestral"),
    ("m_accommodation_mix", ["destino", "anio"], "pct_tipo_alojamiento")])
def test_shares_of_a_whole_add_up(spark, key, keys, share):
    rows = QUERIES[key](spark, SF).groupBy(*keys).agg(F.sum(share).alias("s"), F.count(share).alias("n")).where("n > 0").collect()
    whole = 100 if share == "pct_del_anual" else 1
    assert rows and all(abs(r.s - whole) <= 0.06 * r.n for r in rows)


def test_parts_do_not_exceed_totals(spark):
    q2 = QUERIES["q02_scorecard"](spark, SF)
    assert q2.where("pct_nacionales + pct_extranjeros not between 99.8 and 100.2").count() == 0
    q11 = QUERIES["q11_capacity_demand"](spark, SF)
    assert q11.where("coalesce(viajeros_nac, 0) + coalesce(viajeros_ext, 0) <> viajeros_total").count() == 0
    both = QUERIES["q11_capacity_demand_total_row"](spark, SF)
    assert q11.exceptAll(both).count() == 0  # the bound demand has no missing part


def test_occupancy_has_one_row_per_key(spark):
    df = QUERIES["m_occupancy"](spark, SF)
    assert df.count() == df.select("destino", "tipo_alojamiento", "anio").distinct().count()
    assert df.where("tipo_alojamiento is null and tasa_ocupacion is not null").count() > 0


@pytest.mark.parametrize("key", ["q02_scorecard", "q09_evolution", "m_classification", "p5_kpis"])
def test_result_does_not_depend_on_partitions(spark, key):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = []
        for n in (1, 13):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(sorted(map(str, QUERIES[key](spark, SF).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]
