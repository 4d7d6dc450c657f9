"""Staging extracts: publish (Spanish-format text) and scan (explicit all-text schema).

``extracts(spark, sf_dir)`` renders the bound facts as the statistics office's
``;``-separated text extracts, with the dirt real extracts carry: missing markers
('.', '..', '', NULL), padded labels, a label without a name, a non-numeric code,
a decimal comma in an integer column, survey names outside the mapping, rows
without a region and rows of other metrics. Which rows get dirt is decided by a
deterministic integer row key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewise import vocab as V
from tidewise.functions.parse import format_number_es
from tidewise.schemas import STAGING_ENCODING, STAGING_WIDTH, staging_schema
from tidewise.sources import bindings as B

MIN_YEAR = 1996             # source filter of the capacity/demand extracts on bound data
OTHER_METRIC = "Número de establecimientos abiertos estimados"
SURVEY_OF_TYPE = (("Hotelero", "Encuesta de Ocupación Hotelera"),
                  ("Apartamento turístico", "Encuesta de Ocupación en Apartamentos Turísticos"),
                  ("Camping", "Encuesta de Ocupación en Campings"),
                  ("Turismo rural", "Encuesta de Ocupación en Alojamientos de Turismo Rural"),
                  ("Albergue", "Encuesta de Ocupación en Albergues"))
UNMAPPED_SURVEY = "Encuesta de Ocupación en Otros Alojamientos"
RESIDENCE_TEXT = (("Nacional", "Residentes en España"), ("Extranjero", "Residentes en el Extranjero"))


def _len(c):
    return F.length(F.coalesce(F.col(c), F.lit("")))


def label(k, id_col="id_ccaa", name_col="destino"):
    code = F.lpad(F.col(id_col).cast("string"), 2, "0")
    full = F.concat(code, F.lit(" "), F.col(name_col))
    padded = F.when(k % 3 == 0, F.concat(F.lit("  "), full, F.lit("  "))).otherwise(full)
    return (F.when(k % 89 == 7, F.lit("Total Nacional"))
            .when(k % 89 == 8, code).otherwise(padded))


def value_text(k, c, decimals: int):
    txt = format_number_es(F.col(c), decimals)
    bad = F.concat(txt, F.lit(",5")) if decimals == 0 else F.lit("n.d.")
    m = k % 50
    return (F.when(m == 0, F.lit(".")).when(m == 1, F.lit("..")).when(m == 2, F.lit(""))
            .when(m == 3, F.lit(None).cast("string")).when(k % 97 == 5, bad).otherwise(txt))


def _month_text(fecha="fecha"):
    return F.concat(F.year(fecha).cast("string"), F.lit("M"), F.lpad(F.month(fecha).cast("string"), 2, "0"))


def _cols(*cols):
    return [c.alias(f"col{i}") for i, c in enumerate(cols, 1)]


def _map(c, pairs, default=None):
    out = None
    for a, b in pairs:
        out = F.when(c == a, F.lit(b)) if out is None else out.when(c == a, F.lit(b))
    return out.otherwise(F.lit(default)) if default is not None else out


def quarterly_spend(spark, d) -> DataFrame:
    f = B.fx_trips_q(spark, d)
    k = F.col("id_ccaa") * 7 + F.col("anio") * 13 + F.col("trimestre") * 3 + _len("metrica")
    v = F.when(F.col("metrica") == V.TRIPS, value_text(k, "valor", 0)).otherwise(value_text(k, "valor", 2))
    return f.select(_cols(label(k), F.col("metrica"), F.lit("Valor absoluto"),
                          F.concat(F.col("anio").cast("string"), F.lit("T"), F.col("trimestre").cast("string")), v))


def _residents_text(df, k):
    return df.select(_cols(label(k), F.lit(V.TRIPS), F.col("alojamiento_nivel1"),
                           F.coalesce(F.col("alojamiento_nivel2"), F.lit("")), F.col("motivo"),
                           F.lit(V.TOTAL), F.lit(V.TOTAL), F.lit(V.TOTAL), F.lit(V.TOTAL),
                           F.col("anio").cast("string"), value_text(k, "viajes", 0)))


def _res_key():
    return (F.col("id_ccaa") * 7 + F.col("anio") * 13 + _len("motivo") + _len("alojamiento_nivel1")
            + _len("alojamiento_nivel2") * 2)


def residents_motives(spark, d) -> DataFrame:
    f = B.fx_residents_y(spark, d).where(F.col("alojamiento_nivel1") == V.TOTAL)
    return _residents_text(f, _res_key())


def residents_lodging(spark, d) -> DataFrame:
    f = B._lodging_lines(spark, d, with_total=True).join(B.region_dim(spark, d), "id_ccaa")
    return _residents_text(f, _res_key())


def foreign_motives(spark, d) -> DataFrame:
    f = B.fx_foreign_m(spark, d)
    k = F.col("id_ccaa") * 7 + F.year("fecha") * 13 + F.month("fecha") * 3 + _len("motivo")
    return f.select(_cols(F.lit("Total de vías de acceso"), label(k), F.col("motivo"),
                          F.lit("Total de tipos de alojamiento"),
                          F.lit("Total de formas de organización del viaje"), F.lit("Total noches"),
                          F.lit("Total país de residencia"), _month_text(), value_text(k, "turistas", 0)))


def foreign_spend(spark, d) -> DataFrame:
    f = B.fx_spend_y(spark, d)
    k = F.col("id_ccaa") * 7 + F.col("anio") * 13 + _len("metrica")
    return f.select(_cols(label(k), F.col("metrica"), F.lit("Dato base"), F.col("anio").cast("string"),
                          value_text(k, "valor", 2)))


def _region_or_empty(k):
    return F.when(k % 41 == 0, F.lit("")).otherwise(label(k))


def capacity(spark, d) -> DataFrame:
    f = B.fx_capacity_m(spark, d)
    k = F.col("id_ccaa") * 7 + F.year("fecha") * 13 + F.month("fecha") * 3 + _len("tipo_alojamiento")
    metric = F.when(k % 5 == 0, F.lit(OTHER_METRIC)).otherwise(F.lit(V.CAPACITY_METRIC))
    return f.select(_cols(_map(F.col("tipo_alojamiento"), SURVEY_OF_TYPE, UNMAPPED_SURVEY),
                          F.lit("Total Nacional"), _region_or_empty(k), metric, _month_text(),
                          value_text(k, "plazas", 0)))


def demand(spark, d) -> DataFrame:
    f = B.fx_demand_m(spark, d)
    k = (F.col("id_ccaa") * 7 + F.year("fecha") * 13 + F.month("fecha") * 3 + _len("tipo_alojamiento")
         + _len("residencia") * 5 + _len("metrica"))
    concept = F.when(F.col("metrica") == V.TRAVELLERS, F.lit("Viajero")).otherwise(F.col("metrica"))
    return f.select(_cols(_map(F.col("tipo_alojamiento"), SURVEY_OF_TYPE, UNMAPPED_SURVEY),
                          F.lit("Total Nacional"), _region_or_empty(k), F.lit("Total"),
                          F.coalesce(_map(F.col("residencia"), RESIDENCE_TEXT), F.lit("")),
                          concept, _month_text(), value_text(k, "valor", 0)))


EXTRACTS = {"quarterly_spend": quarterly_spend, "residents_motives": residents_motives,
            "residents_lodging": residents_lodging, "foreign_motives": foreign_motives,
            "foreign_spend": foreign_spend, "capacity": capacity, "demand": demand}


#: Byte order mark, with which the office's UTF-8 extracts begin.
BOM = "\ufeff"


def write_staging(df: DataFrame, path: str, encoding: str = "UTF-8", mode: str = "overwrite") -> None:
    """Write an extract as ';'-separated text with header; padding and '' survive.

    UTF-8 files begin with a byte order mark, as the published ones do.
    """
    if encoding == "UTF-8":
        df = df.withColumnRenamed("col1", f"{BOM}col1")
    (df.write.mode(mode).option("sep", ";").option("header", True)
     .option("encoding", encoding).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))


def read_staging(spark: SparkSession, path: str, n_cols: int, encoding: str = "UTF-8",
                 sep: str = ";") -> DataFrame:
    """Scan an extract with an explicit all-text positional schema (never inferred).

    Columns are taken by position, so a byte order mark before the header does no harm.
    """
    return (spark.read.schema(staging_schema(n_cols)).option("sep", sep).option("header", True)
            .option("encoding", encoding).option("mode", "PERMISSIVE").csv(path))


#: A line is short, wide or revised by its length modulo these (see write_faulty_staging).
SHORT_LINE, WIDE_LINE, REVISED_LINE = (23, 3), (23, 7), (29, 4)


def write_faulty_staging(df: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    """An extract with the faults of real deliveries: short lines (the last field is gone), wide
    lines (one more field), and lines that stand in it once more with a revised value.

    Which lines, is decided by the number of characters of a line.
    """
    size = sum((_len(c) for c in df.columns), F.lit(0))

    def lines(rule):
        return size % rule[0] == rule[1]

    broken = lines(SHORT_LINE) | lines(WIDE_LINE)
    revised = df.where(~broken & lines(REVISED_LINE)).withColumn(df.columns[-1], F.lit("7"))
    parts = [df.where(~broken).unionByName(revised), df.where(lines(SHORT_LINE)).drop(df.columns[-1]),
             df.where(lines(WIDE_LINE)).withColumn("extra", F.lit("x"))]
    for i, part in enumerate(parts):
        write_staging(part, path, encoding, "append" if i else "overwrite")


#: Column that holds the text of a line with too few or too many fields (NULL for a sound line).
MALFORMED = "_linea_mala"


def scan_staging(spark: SparkSession, path: str, n_cols: int, encoding: str = "UTF-8", sep: str = ";") -> DataFrame:
    """:func:`read_staging` with one more column, :data:`MALFORMED`.

    A short line has its missing fields padded with NULL and a wide one its last fields cut; the column
    tells them from lines whose fields are really empty. Every line is split whole, also where a
    query needs few columns. (Spark wants a query on it to name another column too.)
    """
    schema = staging_schema(n_cols).add(MALFORMED, "string")
    return (spark.read.schema(schema).option("sep", sep).option("header", True).option("encoding", encoding)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", MALFORMED)
            .option("columnPruning", False).csv(path))


def malformed_reason(n_cols: int, sep: str = ";"):
    """Reason of a line in :data:`MALFORMED`: too few fields, too many, or unreadable quotes."""
    fields = F.length(MALFORMED) - F.length(F.replace(F.col(MALFORMED), F.lit(sep), F.lit(""))) + 1
    return (F.when(F.col(MALFORMED).isNull(), F.lit(None)).when(fields < n_cols, "faltan_campos")
            .when(fields > n_cols, "sobran_campos").otherwise("linea_ilegible"))


def roundtrip(spark: SparkSession, name: str, df: DataFrame, path: str) -> DataFrame:
    enc = STAGING_ENCODING[name]
    write_staging(df, path, enc)
    return read_staging(spark, path, STAGING_WIDTH[name], enc)
