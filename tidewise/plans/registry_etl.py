"""Registered ingest, parsing, sink and data-quality keys over the bound facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewise.functions.parse import (empty_to_null, is_missing, map_by_rules, map_patterns, parse_number_es,
                                      parse_period, split_code_label, unmapped)
from tidewise import vocab as V
from tidewise.operators import quality as QL
from tidewise.plans import etl as E
from tidewise.plans import loads as LD
from tidewise.plans import queries as Q
from tidewise.plans.registry import P, YEAR, facts, register
from tidewise.schemas import FACT_KEYS, FACT_SCHEMAS, FACT_VALUE, STAGING_ENCODING, STAGING_WIDTH
from tidewise.session import scratch_path
from tidewise.sources import bindings as B
from tidewise.sources import sinks, staging as S
from tidewise.sources.tables import read_region_csv, region_dim

PARSERS = {
    "quarterly_spend": E.parse_quarterly_spend,
    "residents_motives": E.parse_residents_motives,
    "residents_lodging": E.parse_residents_lodging,
    "foreign_motives": E.parse_foreign_motives,
    "foreign_spend": E.parse_foreign_spend,
    "capacity": lambda s: E.parse_capacity(s, S.MIN_YEAR),
    "demand": lambda s: E.parse_demand(s, S.MIN_YEAR),
}
FACT_OF = {"quarterly_spend": "quarterly_spend", "residents_motives": "residents",
           "residents_lodging": "residents", "foreign_motives": "foreign_motives",
           "foreign_spend": "foreign_spend", "capacity": "capacity", "demand": "demand"}


def sharing(run):
    """The key reads all facts: they share their passes over the lines."""
    def with_cells(spark, d):
        with B.shared_cells(spark, d):
            return run(spark, d)
    return with_cells


def staged(spark, d, name):
    return S.EXTRACTS[name](spark, d)


def _publish_staging(spark, d, name):
    """Write an extract as files in its own encoding; returns the folder."""
    path = scratch_path(spark, f"stg-{name}")
    S.write_staging(staged(spark, d, name), path, STAGING_ENCODING[name])
    return path


def _etl(name):
    def run(spark, d):
        return E.load_file(spark, _publish_staging(spark, d, name), name, FACT_OF[name], PARSERS[name],
                           scratch_path(spark, f"fact-{name}"))
    return run


for _n in PARSERS:
    register(f"etl_{_n}")(_etl(_n))


@register("append_load")
def _append(spark, d):
    """Both residents extracts appended to one published fact."""
    fact = scratch_path(spark, "fact-residents")
    for name in ("residents_motives", "residents_lodging"):
        out = E.load_file(spark, _publish_staging(spark, d, name), name, "residents", PARSERS[name], fact)
    return out


@register("staging_scan_all")
@sharing
def _scan_all(spark, d):
    """Rows, and filled fields of the first and last column, of all seven extracts read from their files."""
    parts = []
    for name in PARSERS:
        n = STAGING_WIDTH[name]
        stg = S.read_staging(spark, _publish_staging(spark, d, name), n, STAGING_ENCODING[name])
        parts.append(stg.agg(F.count("*").alias("filas"), F.count("col1").alias("con_primera"),
                             F.count(f"col{n}").alias("con_valor")).select(F.lit(name).alias("tabla"), "*"))
    return reduce(DataFrame.unionByName, parts)


@register("fuse_marginals")
def _fuse(spark, d):
    mot = E.load(E.parse_residents_motives(staged(spark, d, "residents_motives")), "residents")
    # lodging parsed *with* its grand-total rows: the fuse removes the overlap
    lod = E.load(E._parse_residents(staged(spark, d, "residents_lodging"), "residents_lodging"), "residents")
    return E.fuse_residents(mot, lod)


@register("load_audit")
@sharing
def _audit(spark, d):
    return QL.load_audit({n: (parse(staged(spark, d, n)).tagged, FACT_VALUE[FACT_OF[n]]) for n, parse in PARSERS.items()})


@register("drop_missing_rows")
def _dropped(spark, d):
    return QL.drop_missing_rows(E.parse_foreign_motives(staged(spark, d, "foreign_motives")).clean, "turistas")


@register("table_row_counts")
@sharing
def _counts(spark, d):
    return QL.table_row_counts({n: fn(spark, d) for n, fn in B.FACTS.items()})


@register("table_preview")
def _preview(spark, d):
    return QL.table_preview(B.fx_foreign_m(spark, d), ["id_ccaa", "motivo", "fecha"], 5)


@register("constant_column_check")
def _const(spark, d):
    return QL.constant_column_check(staged(spark, d, "quarterly_spend"), ["col2", "col3"])


@register("csv_staging_scan")
def _scan(spark, d):
    df = staged(spark, d, "quarterly_spend")
    return S.roundtrip(spark, "quarterly_spend", df, scratch_path(spark, "stg-quarterly"))


@register("clean_export_roundtrip")
def _export(spark, d):
    path = scratch_path(spark, "clean-foreign")
    sinks.write_clean(B.fx_foreign_m(spark, d), path)
    return sinks.read_clean(spark, path)


def _summary(tables: dict) -> DataFrame:
    """Rows and sum of the value column by table and year."""
    parts = []
    for name, df in tables.items():
        year = F.col("anio") if "anio" in df.columns else F.year("fecha")
        parts.append(df.groupBy(year.alias("anio")).agg(
            F.count("*").alias("filas"), F.sum(F.col(FACT_VALUE[name]).cast("decimal(20,2)")).cast("double").alias("total"))
            .select(F.lit(name).alias("tabla"), "anio", "filas", "total"))
    return reduce(DataFrame.unionByName, parts)


@register("published_facts")
@sharing
def _published(spark, d):
    """All six facts conformed, published by year and read back."""
    out = {}
    for name, fact in B.FACTS.items():
        path = scratch_path(spark, f"fact-{name}")
        sinks.write_clean(sinks.conform(fact(spark, d), FACT_SCHEMAS[name]), path)
        out[name] = sinks.read_clean(spark, path, FACT_SCHEMAS[name])
    return _summary(out)


@register("csv_export_facts")
@sharing
def _csv_export(spark, d):
    """All six facts exported as text and read back with their schemas."""
    out = {}
    for name, fact in B.FACTS.items():
        path = scratch_path(spark, f"csv-{name}")
        sinks.write_csv(sinks.conform(fact(spark, d), FACT_SCHEMAS[name]), path)
        out[name] = sinks.read_csv(spark, path, FACT_SCHEMAS[name])
    return _summary(out)


@register("clustered_facts")
@sharing
def _clustered(spark, d):
    """All six facts published in ranges of the region inside each year, and read back."""
    out = {}
    for name, fact in B.FACTS.items():
        path = scratch_path(spark, f"clustered-{name}")
        sinks.write_clustered(sinks.conform(fact(spark, d), FACT_SCHEMAS[name]), path, "id_ccaa")
        out[name] = sinks.read_clean(spark, path, FACT_SCHEMAS[name])
    return _summary(out)


#: Rules that a table adds to those of the vocabulary: before all others, and for a name that none of them maps.
MORE_RULES = [(0, "%Turismo Rural", "Rural"), (99, "%Otros Alojamientos", "Otro")]


def _rules(spark, more=()):
    """The survey patterns as a table that is published and read back."""
    rows = [(i + 1, p, e) for i, (p, e) in enumerate(V.SURVEY_TYPE_PATTERNS)] + list(more)
    path = scratch_path(spark, "rules")
    spark.createDataFrame(rows, "precedencia int, patron string, etiqueta string").write.parquet(path)
    return spark.read.parquet(path)


@register("map_by_rules")
def _by_rules(spark, d):
    """Surveys by type with the patterns as rows; one row more changes a type, another names a new one."""
    s = staged(spark, d, "capacity")
    plain, more = _rules(spark), _rules(spark, MORE_RULES)
    return s.groupBy(F.col("col1").alias("texto"), map_by_rules("col1", plain).alias("tipo"), map_by_rules("col1", more).alias("tipo_ampliado")).agg(
        F.count(F.lit(1)).alias("filas"))


@register("unmapped_names")
def _unmapped(spark, d):
    return unmapped(staged(spark, d, "demand"), "col1", _rules(spark))


@register("q05_published")
def _q05_published(spark, d):
    """Foreign motive shares over the published fact: the year filter prunes its partitions."""
    path = scratch_path(spark, "fact-foreign")
    sinks.write_clean(B.fx_foreign_m(spark, d), path)
    y = P["last_year"]
    return Q.q05_foreign_motive_share(sinks.read_clean(spark, path, FACT_SCHEMAS["foreign_motives"], (y, y)), y)


@register("dim_region_join")
def _dim(spark, d):
    path = scratch_path(spark, "dim-region")
    region_dim(spark, d).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)
    dim = read_region_csv(spark, path)
    (f,) = facts(spark, d, "foreign_motives", years=YEAR)
    tot = f.groupBy("id_ccaa").agg(F.sum("turistas").alias("turistas"))
    return tot.join(dim, "id_ccaa")


@register("schema_conform")
def _conform(spark, d):
    loose = B.fx_residents_y(spark, d).select(
        F.col("id_ccaa").cast("string").alias("id_ccaa"), "destino", "motivo", "alojamiento_nivel1",
        "alojamiento_nivel2", F.col("anio").cast("string").alias("anio"),
        F.col("viajes").cast("double").alias("viajes"), F.lit("x").alias("extra"))
    return sinks.conform(loose, FACT_SCHEMAS["residents"])


# ---- loads of faulty deliveries, in lots ------------------------------------------

#: The lodging extract with its grand totals: they give way to the motives extract by the natural key.
LOT_PARSERS = PARSERS | {"residents_lodging": lambda s: E._parse_residents(s, "residents_lodging")}


def _loaded_lots(spark, d, times=1):
    """All seven extracts, with faults, loaded as lots; returns the lots by extract and the folders of the facts."""
    lots, paths = {}, {fact: scratch_path(spark, f"lots-{fact}") for fact in FACT_SCHEMAS}
    for name, parse in LOT_PARSERS.items():
        files = scratch_path(spark, f"faulty-{name}")
        S.write_faulty_staging(staged(spark, d, name), files, STAGING_ENCODING[name])
        for _ in range(times):
            lots[name] = LD.load_lot(spark, files, name, FACT_OF[name], parse, paths[FACT_OF[name]], name)
    return lots, paths


@register("load_observed")
@sharing
def _observed(spark, d):
    """Rows of each fate, observed while the lots were written."""
    names = ["leidas", *LD.L.FATES]
    rows = [(n, *[lot.audit[c] for c in names]) for n, lot in _loaded_lots(spark, d)[0].items()]  # a row an extract
    return spark.createDataFrame(rows, "tabla string, " + ", ".join(f"{c} long" for c in names))


@register("load_rejects")
@sharing
def _rejects(spark, d):
    """Rejects by reason: malformed lines have reasons of their own."""
    lots, _ = _loaded_lots(spark, d)
    parts = [lot.rejects.groupBy("motivo_rechazo").agg(F.count(F.lit(1)).alias("filas")).select(F.lit(n).alias("tabla"), "*")
             for n, lot in lots.items()]
    return reduce(DataFrame.unionByName, parts)


@register("load_losers")
@sharing
def _losers(spark, d):
    """Rows whose cell was already loaded, by another lot or by an earlier row of their own."""
    lots, _ = _loaded_lots(spark, d)
    return reduce(DataFrame.unionByName, [lot.losers.select(F.lit(n).alias("tabla"), "suerte", "texto") for n, lot in lots.items()])


@register("repeated_load")
@sharing
def _repeated(spark, d):
    """Every lot loaded twice: the facts are as after once."""
    _, paths = _loaded_lots(spark, d, times=2)
    return _summary({fact: LD.read_lots(spark, path, fact) for fact, path in paths.items()})


@register("fuse_on_key")
def _fuse_key(spark, d):
    """Motives and lodging fused on the natural key of the fact instead of a predicate."""
    mot = E.load(E.parse_residents_motives(staged(spark, d, "residents_motives")), "residents")
    lod = E.load(E._parse_residents(staged(spark, d, "residents_lodging"), "residents_lodging"), "residents")
    return LD.L.fuse_on_key(mot, lod, FACT_KEYS["residents"])[0]


@register("constraint_violations")
@sharing
def _violations(spark, d):
    """Constraints of the parsed extracts, before a load has chosen between rows."""
    dim, parts = region_dim(spark, d), []
    for name, parse in LOT_PARSERS.items():
        fact = FACT_OF[name]
        rules = QL.constraint_violations(E.load(parse(staged(spark, d, name)), fact), FACT_KEYS[fact], FACT_VALUE[fact], dim)
        parts.append(rules.select(F.lit(name).alias("tabla"), "*"))
    return reduce(DataFrame.unionByName, parts)


# ---- scalar parsers over the staging text ---------------------------------------

def _parse_key(name, col, build, distinct=True):
    def run(spark, d):
        out = staged(spark, d, name).select(F.col(col).alias("texto"), *build(F.col(col)))
        return out.distinct() if distinct else out
    return run


def _code_label(c):
    code, lab = split_code_label(c)
    return [code.alias("id_ccaa"), lab.alias("destino")]


def _quarter(c):
    p = parse_period(c, "quarter")
    return [p["anio"].alias("anio"), p["trimestre"].alias("trimestre"), p["fecha"].alias("fecha")]


def _month(c):
    p = parse_period(c, "month")
    return [p["anio"].alias("anio"), p["mes"].alias("mes"), p["fecha"].alias("fecha")]


register("parse_code_prefix")(_parse_key("quarterly_spend", "col1", _code_label))
register("parse_period_quarter")(_parse_key("quarterly_spend", "col4", _quarter))
register("parse_period_month")(_parse_key("foreign_motives", "col8", _month))
register("parse_period_year")(_parse_key("foreign_spend", "col4",
                                         lambda c: [parse_period(c, "year")["anio"].alias("anio")]))
register("parse_number_es_decimal")(_parse_key(
    "foreign_spend", "col5", lambda c: [parse_number_es(c, "decimal(14,2)").cast("double").alias("valor")], False))
register("parse_number_es_bigint")(_parse_key(
    "foreign_motives", "col9", lambda c: [parse_number_es(c, "bigint").alias("turistas")], False))
register("missing_marker_to_null")(_parse_key(
    "quarterly_spend", "col5", lambda c: [is_missing(c).alias("faltante"),
                                          parse_number_es(c, "decimal(14,2)").cast("double").alias("valor")], False))
register("empty_to_null")(_parse_key("residents_lodging", "col4",
                                     lambda c: [empty_to_null(c).alias("alojamiento_nivel2")]))
register("map_category_like")(_parse_key("capacity", "col1", lambda c: [
    map_patterns(c, V.SURVEY_TYPE_PATTERNS).alias("tipo_alojamiento")]))
register("map_residence")(_parse_key("demand", "col5", lambda c: [
    map_patterns(c, V.RESIDENCE_PATTERNS, trim=True).alias("residencia")]))
register("map_value_passthrough")(_parse_key("demand", "col6", lambda c: [
    F.when(F.trim(c) == "Viajero", F.lit(V.TRAVELLERS)).otherwise(F.trim(c)).alias("metrica")]))
