"""The seven extract -> clean-fact transforms.

Each is one narrow projection over the staging scan (whole-stage codegen, no
shuffle): trim, code/label split, period and number parsing, category mapping.
Unparseable rows go to a rejects frame instead of aborting the load; rows whose
value is a missing marker are dropped before the write.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewise import vocab as V
from tidewise.functions.parse import (empty_to_null, is_missing, map_patterns, parse_number_es,
                                      parse_period, split_code_label)
from tidewise.operators.quality import drop_missing_rows, fuse_marginals, raw_text, split_rejects, tag_rejects
from tidewise.schemas import FACT_SCHEMAS, FACT_VALUE, STAGING_ENCODING, STAGING_WIDTH
from tidewise.sources.sinks import append_clean, conform, read_clean
from tidewise.sources.staging import MALFORMED, malformed_reason, scan_staging


def _region(c):
    code, name = split_code_label(c)
    return code.alias("id_ccaa"), name.alias("destino")


class Parsed(NamedTuple):
    """Good rows, rejects, and all rows with their tag and raw text (for an audit in one pass)."""

    clean: DataFrame
    rejects: DataFrame
    tagged: DataFrame


def _finish(parsed: DataFrame, fact: str, raw: list[str], value_raw: str, period="fecha") -> Parsed:
    value = FACT_VALUE[fact]
    checks = {"codigo_region": F.col("id_ccaa").isNull(),
              "periodo": F.col(period).isNull(),
              "valor": F.col(value).isNull() & ~is_missing(value_raw)}
    if MALFORMED in parsed.columns:  # first: the padding of a short line looks like a missing value
        why = malformed_reason(len(raw))
        checks = {r: F.coalesce(why == r, F.lit(False)) for r in ("faltan_campos", "sobran_campos", "linea_ilegible")} | checks
    line = MALFORMED if MALFORMED in parsed.columns else None
    clean, rejects = split_rejects(parsed, checks, raw, line)
    cols = [f.name for f in FACT_SCHEMAS[fact].fields]
    return Parsed(clean.select(*cols), rejects, tag_rejects(parsed, checks).withColumn("_texto", raw_text(raw, line)))


def _raw(name):
    return [f"col{i}" for i in range(1, STAGING_WIDTH[name] + 1)]


def _mark(stg: DataFrame):
    """The malformed line, if the scan kept it."""
    return [MALFORMED] if MALFORMED in stg.columns else []


def _wanted(stg: DataFrame, condition):
    """Rows of the source filter; a malformed line is never filtered away, it becomes a reject."""
    return stg.where(condition | F.col(MALFORMED).isNotNull() if MALFORMED in stg.columns else condition)


def parse_quarterly_spend(stg: DataFrame):
    p = parse_period("col4", "quarter")
    parsed = stg.select(*_region("col1"), F.trim("col2").alias("metrica"), p["anio"].alias("anio"),
                        p["trimestre"].alias("trimestre"), p["fecha"].alias("fecha"),
                        parse_number_es("col5", "decimal(14,2)").alias("valor"), *_raw("quarterly_spend"), *_mark(stg))
    return _finish(parsed, "quarterly_spend", _raw("quarterly_spend"), "col5")


def _parse_residents(stg: DataFrame, name: str):
    parsed = stg.select(*_region("col1"), F.trim("col5").alias("motivo"),
                        empty_to_null("col3").alias("alojamiento_nivel1"),
                        empty_to_null("col4").alias("alojamiento_nivel2"),
                        parse_period("col10", "year")["anio"].alias("anio"),
                        parse_number_es("col11", "bigint").alias("viajes"), *_raw(name), *_mark(stg))
    return _finish(parsed, "residents", _raw(name), "col11", period="anio")


def parse_residents_motives(stg: DataFrame):
    return _parse_residents(stg, "residents_motives")


def parse_residents_lodging(stg: DataFrame):
    """Lodging marginal without its grand-total rows (the motives file has them)."""
    return _parse_residents(_wanted(stg, F.trim("col3") != V.TOTAL), "residents_lodging")


def parse_foreign_motives(stg: DataFrame):
    parsed = stg.select(*_region("col2"), F.trim("col3").alias("motivo"),
                        parse_period("col8", "month")["fecha"].alias("fecha"),
                        parse_number_es("col9", "bigint").alias("turistas"), *_raw("foreign_motives"), *_mark(stg))
    return _finish(parsed, "foreign_motives", _raw("foreign_motives"), "col9")


def parse_foreign_spend(stg: DataFrame):
    parsed = stg.select(*_region("col1"), F.trim("col2").alias("metrica"),
                        parse_period("col4", "year")["anio"].alias("anio"),
                        parse_number_es("col5", "decimal(14,2)").alias("valor"), *_raw("foreign_spend"), *_mark(stg))
    return _finish(parsed, "foreign_spend", _raw("foreign_spend"), "col5", period="anio")


def _source_filter(stg, region_col, period_col, min_year):
    r = F.col(region_col)
    return (r.isNotNull() & (F.trim(r) != "")
            & (F.left(F.trim(period_col), F.lit(4)).try_cast("int") >= min_year))


def parse_capacity(stg: DataFrame, min_year: int, metric: str = V.CAPACITY_METRIC):
    s = _wanted(stg, (F.trim("col4") == metric) & _source_filter(stg, "col3", "col5", min_year))
    parsed = s.select(*_region("col3"),
                      map_patterns("col1", V.SURVEY_TYPE_PATTERNS).alias("tipo_alojamiento"),
                      parse_period("col5", "month")["fecha"].alias("fecha"),
                      parse_number_es("col6", "bigint").alias("plazas"), *_raw("capacity"), *_mark(stg))
    return _finish(parsed, "capacity", _raw("capacity"), "col6")


def parse_demand(stg: DataFrame, min_year: int):
    s = _wanted(stg, _source_filter(stg, "col3", "col7", min_year))
    concept = F.trim("col6")
    parsed = s.select(*_region("col3"),
                      map_patterns("col1", V.SURVEY_TYPE_PATTERNS).alias("tipo_alojamiento"),
                      map_patterns("col5", V.RESIDENCE_PATTERNS, trim=True).alias("residencia"),
                      F.when(concept == "Viajero", F.lit(V.TRAVELLERS)).otherwise(concept).alias("metrica"),
                      parse_period("col7", "month")["fecha"].alias("fecha"),
                      parse_number_es("col8", "bigint").alias("valor"), *_raw("demand"), *_mark(stg))
    return _finish(parsed, "demand", _raw("demand"), "col8")


def load(parsed: Parsed, fact: str) -> DataFrame:
    """Clean fact in its declared schema: good rows minus missing values (what gets written)."""
    return conform(drop_missing_rows(parsed.clean, FACT_VALUE[fact]), FACT_SCHEMAS[fact])


def load_file(spark, staging_path: str, name: str, fact: str, parse, fact_path: str) -> DataFrame:
    """File -> staging scan -> parse -> append to the year-partitioned fact, then read it back.

    Malformed lines are rejects. A second call appends the rows again; :func:`tidewise.plans.loads.load_lot`
    is the load that may be repeated.
    """
    staged = scan_staging(spark, staging_path, STAGING_WIDTH[name], STAGING_ENCODING[name])
    append_clean(load(parse(staged), fact), fact_path)
    return read_clean(spark, fact_path, FACT_SCHEMAS[fact])


def fuse_residents(motives: DataFrame, lodging: DataFrame) -> DataFrame:
    """The two residents extracts form one table; lodging grand totals are overlap."""
    return fuse_marginals(motives, lodging, F.col("alojamiento_nivel1") == V.TOTAL)
