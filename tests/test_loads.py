"""Malformed lines, repeated lots, natural keys, observed audits and constraints on hand-made rows."""

import os
import tempfile
from decimal import Decimal

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewise.functions.parse import map_by_rules, unmapped
from tidewise.operators import loading as L
from tidewise.operators.pivots import eav_pick
from tidewise.operators.quality import constraint_violations, load_audit
from tidewise.plans import etl as E
from tidewise.plans import loads as LD
from tidewise.schemas import FACT_KEYS, FACT_SCHEMAS, FACT_VALUE
from tidewise.sources import sinks
from tidewise.sources import staging as S
from tidewise.streaming.ingest import start_extract_stream

HEADER = "CCAA;Concepto;Dato;Periodo;Total"
LINES = ["01 Andalucía;Gasto;b;2020;1.000,50", "02 Aragón;Gasto;b;2020;..", "03 Asturias;Gasto;b;2020",
         "04 Balears;Gasto;b;2020;7,00;x", "05 Canarias;Gasto;b;2020;n.d.", "Total Nacional;Gasto;b;2020;9,00", "",
         "06 Cantabria;Gasto;b;2021;", "01 Andalucía;Gasto;b;2020;2.000,00", "01 Andalucía;Gasto;b;2021;3,00", "07 Castilla;;b;2021;4,00"]


def extract(lines, encoding="ISO-8859-1"):
    root = tempfile.mkdtemp(prefix="tidewise-lines-")
    with open(os.path.join(root, "a.csv"), "w", encoding=encoding) as f:
        f.write("\n".join([HEADER, *lines]) + "\n")
    return root


def load(spark, files, path, lot="a"):
    return LD.load_lot(spark, files, "foreign_spend", "foreign_spend", E.parse_foreign_spend, path, lot)


def rows(spark, path):
    return sorted(tuple(r)[:1] + tuple(r)[2:] for r in LD.read_lots(spark, path, "foreign_spend").collect())


def test_malformed_lines_are_rejects_not_suppressed_cells(spark):
    stg = S.scan_staging(spark, extract(LINES), 5, "ISO-8859-1")
    # counts see them although few columns are needed
    assert stg.where(F.col(S.MALFORMED).isNotNull()).agg(F.count("col1")).first()[0] == 2
    parsed = E.parse_foreign_spend(stg)
    got = {r.texto: r.motivo_rechazo for r in parsed.rejects.collect()}
    assert got == {LINES[2]: "faltan_campos", LINES[3]: "sobran_campos", LINES[4]: "valor", LINES[5]: "codigo_region"}
    audit = load_audit({"t": (parsed.tagged, "valor")}).first()
    assert (audit["read"], audit.kept, audit.dropped, audit.rejected) == (10, 4, 2, 4)


def test_source_filter_keeps_malformed_lines(spark):
    short = ["Encuesta Hotelera;Total;01 A;" + "Número de plazas estimadas" + ";2020M01", "x;y;01 A;otra;2020M01;5"]
    stg = S.scan_staging(spark, extract(short, "UTF-8"), 6, "UTF-8")
    assert [r.motivo_rechazo for r in E.parse_capacity(stg, 1990).rejects.collect()] == ["faltan_campos"]


@pytest.fixture
def loaded(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="tidewise-lots-"), "fact")
    return path, load(spark, extract(LINES), path)


EXPECTED = [(1, "Gasto", 2020, Decimal("1000.50")), (1, "Gasto", 2021, Decimal("3.00")), (7, "", 2021, Decimal("4.00"))]


def test_audit_is_observed_and_losers_are_named(spark, loaded):
    path, lot = loaded
    assert lot.audit == {"leidas": 10, L.LOADED: 3, L.SUPPRESSED: 2, L.REJECTED: 4, L.KNOWN: 0, L.REPEATED: 1}
    assert [(r.suerte, r.texto) for r in lot.losers.collect()] == [(L.REPEATED, LINES[8])]
    assert [(a, b or "", c, d) for a, b, c, d in rows(spark, path)] == EXPECTED


def test_lot_may_be_loaded_again(spark, loaded):
    path, first = loaded
    before = rows(spark, path)
    again = load(spark, extract(LINES), path)
    assert rows(spark, path) == before and again.audit == first.audit
    # a corrected delivery replaces all of the lot, also years that it no longer has
    load(spark, extract(["01 Andalucía;Gasto;b;2020;5,00"]), path)
    assert rows(spark, path) == [(1, "Gasto", 2020, Decimal("5.00"))]
    load(spark, extract([]), path)
    assert rows(spark, path) == []


def test_cell_of_another_lot_is_loaded_once(spark, loaded):
    path, _ = loaded
    before = rows(spark, path)
    other = load(spark, extract(["01 Andalucía;Gasto;b;2020;8,00", "07 Castilla;;b;2021;4,00", "08 Z;Gasto;b;2020;1,00"]), path, "b")
    # the key with an empty metric is the same cell as well
    assert (other.audit[L.KNOWN], other.audit[L.LOADED]) == (2, 1)
    assert rows(spark, path) == sorted([*before, (8, "Gasto", 2020, Decimal("1.00"))])
    # the same lot again, now with the other one there: nothing changes
    assert load(spark, extract(LINES), path).audit[L.KNOWN] == 0


def test_year_folders_of_a_lot(spark, loaded):
    path, _ = loaded
    assert {d for d in os.listdir(f"{path}/carga=a") if d.startswith("anio=")} == {"anio=2020", "anio=2021"}


def test_lot_names(spark, loaded):
    for bad in ("", "../x", "a/b", "a=b"):
        with pytest.raises(ValueError, match="lot"):
            LD.write_lot(spark, None, "foreign_spend", loaded[0], bad)


def test_null_safe_keys(spark):
    schema = "a int, b string, v int"
    left = spark.createDataFrame([(1, None, 10), (2, "x", 20)], schema)
    right = spark.createDataFrame([(1, None, 11), (2, None, 21), (2, "x", 22), (None, None, 5)], schema)
    both, losers = L.fuse_on_key(left, right, ["a", "b"])
    assert sorted((r.v for r in both.collect())) == [5, 10, 20, 21] and sorted(r.v for r in losers.collect()) == [11, 22]


def test_null_key_is_one_cell_and_rejects_do_not_meet(spark):
    tagged = spark.createDataFrame([(1, None, 5, None, "a"), (1, None, 6, None, "b"), (None, None, 7, "bad", "c"), (None, None, 8, "bad", "d"),
                                    (1, "x", None, None, "e"), (1, "x", 9, None, "f")], "k int, m string, v int, _reject string, _texto string")
    got = {r._texto: r._suerte for r in L.tag_fates(tagged, ["k", "m"], "v").collect()}
    assert got == {"a": L.LOADED, "b": L.REPEATED, "c": L.REJECTED, "d": L.REJECTED, "e": L.SUPPRESSED, "f": L.LOADED}


def test_constraints(spark):
    dim = spark.createDataFrame([(1, "A"), (2, "B")], "id_ccaa int, destino string")
    table = [(1, "A", "m", 1), (1, "A", "m", 1), (1, "a", "n", 5), (2, "B", "m", 3), (2, "B", "m", 4), (2, "B", "m", 4), (9, "Z", "m", 1),
             (9, "Z", "n", 1), (None, None, "m", 1), (2, None, None, 1)]
    df = spark.createDataFrame(table, "id_ccaa int, destino string, m string, v int")
    got = {r.regla: (r.violaciones, r.filas) for r in constraint_violations(df, ["id_ccaa", "m"], "v", dim).collect()}
    assert got == {"clave_unica": (2, 3), "celda_ambigua": (1, 3), "region_nombre": (1, 3), "region_huerfana": (1, 2), "region_sin_codigo": (1, 1)}
    assert all(r.violaciones == 0 for r in constraint_violations(df.limit(0), ["id_ccaa", "m"], "v", dim).collect())


def test_double_cell_is_not_hidden(spark):
    df = spark.createDataFrame([(1, "m", 5), (1, "n", 6), (2, "m", 7), (2, "m", None)], "k int, c string, v int")
    assert sorted(map(tuple, eav_pick(df, "k", "c", "v", {"m": "m", "n": "n"}).collect())) == [(1, 5, 6), (2, 7, None)]
    double = df.unionByName(spark.createDataFrame([(1, "m", 9)], df.schema))
    with pytest.raises(Exception, match="several rows in one cell of m"):
        eav_pick(double, "k", "c", "v", {"m": "m", "n": "n"}).collect()
    assert eav_pick(double, "k", "c", "v", {"m": "m"}, on_double="max").orderBy("k").first().m == 9


def test_clustered_files_have_few_regions(spark):
    root = tempfile.mkdtemp(prefix="tidewise-clustered-")
    rows = [(r, "x", "m", f"{y}-0{1 + r % 9}-01", r) for y in (2019, 2020) for r in range(40) for _ in range(25 if r else 400)]
    df = sinks.conform(spark.createDataFrame(rows, "id_ccaa int, destino string, motivo string, fecha string, turistas long").repartition(6),
                       FACT_SCHEMAS["foreign_motives"])
    sinks.write_clustered(df, f"{root}/f", "id_ccaa", rows_per_file=150, parts=8)
    for year in ("2019", "2020"):
        spans = []
        for name in os.listdir(f"{root}/f/anio={year}"):
            if name.endswith(".parquet"):
                meta = pq.ParquetFile(f"{root}/f/anio={year}/{name}").metadata
                assert meta.num_rows <= 150
                groups = [meta.row_group(g) for g in range(meta.num_row_groups)]
                stats = [next(g.column(c) for c in range(g.num_columns) if g.column(c).path_in_schema == "id_ccaa").statistics for g in groups]
                spans.append((min(x.min for x in stats), max(x.max for x in stats)))
        spans.sort()
        assert len(spans) > 8 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))  # files share a border region at most
        assert sum(lo <= 17 <= hi for lo, hi in spans) <= 2
    back = sinks.read_clean(spark, f"{root}/f", FACT_SCHEMAS["foreign_motives"])
    assert back.exceptAll(df).count() == 0 and df.exceptAll(back).count() == 0
    plan = back.where("id_ccaa = 17")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id_ccaa,17)" in plan


def test_rules_as_rows(spark):
    def table(rows):
        return spark.createDataFrame(rows, "precedencia int, patron string, etiqueta string")

    names = spark.createDataFrame([("a x",), ("b x",), (" b y ",), ("z",), (None,)], "n string")
    rules = table([(2, "%x", "any"), (1, "a%", "first"), (3, "b%", "later")])
    assert [r[0] for r in names.select(map_by_rules("n", rules)).collect()] == ["first", "any", None, None, None]
    assert [r[0] for r in names.select(map_by_rules("n", rules, "-", trim=True)).collect()] == ["first", "any", "later", "-", "-"]
    assert sorted(map(tuple, unmapped(names, "n", rules).collect())) == [(" b y ", 1), ("z", 1)]
    assert [r[0] for r in names.select(map_by_rules("n", table([]))).collect()] == [None] * 5
    for bad in ([(1, None, "x")], [(1, "a", None)], [(1, "a", "x"), (2, "a", "y")], [(i, f"p{i}", "x") for i in range(501)]):
        with pytest.raises(ValueError, match="rule"):
            map_by_rules("n", table(bad))


def test_every_fact_has_a_key():
    assert set(FACT_KEYS) == set(FACT_SCHEMAS)
    for fact, key in FACT_KEYS.items():
        assert set(key) <= set(FACT_SCHEMAS[fact].names) - {FACT_VALUE[fact]} and "id_ccaa" in key


def test_stream_keeps_malformed_lines_apart(spark):
    root = tempfile.mkdtemp(prefix="tidewise-stream-")
    q = start_extract_stream(spark, "foreign_spend", extract(LINES), f"{root}/fact", f"{root}/rejects", E.parse_foreign_spend, "foreign_spend")
    q.awaitTermination(120)
    got = {r.motivo_rechazo for r in spark.read.parquet(f"{root}/rejects").collect()}
    assert got == {"faltan_campos", "sobran_campos", "valor", "codigo_region"}
    assert spark.read.parquet(f"{root}/fact").count() == 4  # the stream does not compare cells


def test_load_is_one_scan_and_one_shuffle(spark, loaded):
    parsed = E.parse_foreign_spend(S.scan_staging(spark, extract(LINES), 5, "ISO-8859-1"))
    plan = L.tag_fates(parsed.tagged, FACT_KEYS["foreign_spend"], "valor")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1 and plan.count("Exchange hashpartitioning") == 1
