"""Declared schemas: staging (all text, positional) and typed clean facts."""

from __future__ import annotations

from pyspark.sql import types as T

# Staging extracts: every column is text, named by position (col1..colN).
STAGING_WIDTH = {
    "quarterly_spend": 5,
    "residents_motives": 11,
    "residents_lodging": 11,
    "foreign_motives": 9,
    "foreign_spend": 5,
    "capacity": 6,
    "demand": 8,
}

# Encoding of each raw extract (the statistics office ships two different ones).
STAGING_ENCODING = {
    "quarterly_spend": "ISO-8859-1",
    "residents_motives": "ISO-8859-1",
    "residents_lodging": "ISO-8859-1",
    "foreign_motives": "ISO-8859-1",
    "foreign_spend": "ISO-8859-1",
    "capacity": "UTF-8",
    "demand": "UTF-8",
}


def staging_schema(n_cols: int) -> T.StructType:
    return T.StructType([T.StructField(f"col{i}", T.StringType(), True) for i in range(1, n_cols + 1)])


def _s(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


MONEY = T.DecimalType(14, 2)

FACT_SCHEMAS = {
    "quarterly_spend": _s(("id_ccaa", T.IntegerType()), ("destino", T.StringType()),
                          ("metrica", T.StringType()), ("anio", T.IntegerType()),
                          ("trimestre", T.IntegerType()), ("fecha", T.DateType()),
                          ("valor", MONEY)),
    "residents": _s(("id_ccaa", T.IntegerType()), ("destino", T.StringType()),
                    ("motivo", T.StringType()), ("alojamiento_nivel1", T.StringType()),
                    ("alojamiento_nivel2", T.StringType()), ("anio", T.IntegerType()),
                    ("viajes", T.LongType())),
    "foreign_motives": _s(("id_ccaa", T.IntegerType()), ("destino", T.StringType()),
                          ("motivo", T.StringType()), ("fecha", T.DateType()),
                          ("turistas", T.LongType())),
    "foreign_spend": _s(("id_ccaa", T.IntegerType()), ("destino", T.StringType()),
                        ("metrica", T.StringType()), ("anio", T.IntegerType()),
                        ("valor", MONEY)),
    "capacity": _s(("id_ccaa", T.IntegerType()), ("destino", T.StringType()),
                   ("tipo_alojamiento", T.StringType()), ("fecha", T.DateType()),
                   ("plazas", T.LongType())),
    "demand": _s(("id_ccaa", T.IntegerType()), ("destino", T.StringType()),
                 ("tipo_alojamiento", T.StringType()), ("residencia", T.StringType()),
                 ("metrica", T.StringType()), ("fecha", T.DateType()),
                 ("valor", T.LongType())),
}

# Value column of each fact (rows whose value is missing are not loaded).
FACT_VALUE = {"quarterly_spend": "valor", "residents": "viajes", "foreign_motives": "turistas",
              "foreign_spend": "valor", "capacity": "plazas", "demand": "valor"}

# Natural key of each fact: at most one row for each combination (a NULL is a value of its own).
FACT_KEYS = {
    "quarterly_spend": ("id_ccaa", "metrica", "anio", "trimestre"),
    "residents": ("id_ccaa", "motivo", "alojamiento_nivel1", "alojamiento_nivel2", "anio"),
    "foreign_motives": ("id_ccaa", "motivo", "fecha"),
    "foreign_spend": ("id_ccaa", "metrica", "anio"),
    "capacity": ("id_ccaa", "tipo_alojamiento", "fecha"),
    "demand": ("id_ccaa", "tipo_alojamiento", "residencia", "metrica", "fecha"),
}

DIM_REGION = _s(("id_ccaa", T.IntegerType()), ("destino", T.StringType()))
