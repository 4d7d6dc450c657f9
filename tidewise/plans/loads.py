"""Loads that may be repeated: one lot of an extract, its audit, its losers and its rejects.

A lot is written to its own folder ``carga=<lot>`` of the fact, split by year, and replaces what that folder held: loading a
file twice leaves the fact as after once. The lot's natural keys are held against the other lots of
the fact, so a cell that stands in two extracts is loaded once. The audit is observed
during the write itself.
"""

from __future__ import annotations

import os
import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewise.operators import loading as L
from tidewise.schemas import FACT_KEYS, FACT_SCHEMAS, FACT_VALUE, STAGING_ENCODING, STAGING_WIDTH
from tidewise.sources.sinks import conform, write_clean
from tidewise.sources.staging import scan_staging

LOT = "carga"


class Lot(NamedTuple):
    """What became of a lot: rows by fate, and lazily the rows that gave way and the rejects."""

    audit: dict[str, int]
    losers: DataFrame
    rejects: DataFrame


def read_lots(spark: SparkSession, fact_path: str, fact: str, other_than: str | None = None) -> DataFrame | None:
    """The fact, or its lots but one; None if there is no lot yet."""
    schema = FACT_SCHEMAS[fact]
    stored = T.StructType(schema.fields + [f for f in (T.StructField("anio", T.IntegerType()), T.StructField(LOT, T.StringType()))
                                           if f.name not in schema.names])
    try:
        df = spark.read.schema(stored).parquet(fact_path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    df = df.where(F.col(LOT) != other_than) if other_than is not None else df
    return conform(df, schema)


def write_lot(spark: SparkSession, parsed, fact: str, fact_path: str, lot: str) -> Lot:
    """Load the rows of :class:`tidewise.plans.etl.Parsed` as a lot.

    The counts are taken behind the last shuffle, in the tasks that write: a task that is run again counts once.
    A run that fails while it writes leaves the lot out; running it again brings it in.
    """
    if not lot or not lot.replace("-", "").replace("_", "").isalnum():
        raise ValueError("a lot is named by letters, digits, - and _")
    rows = L.tag_fates(parsed.tagged, FACT_KEYS[fact], FACT_VALUE[fact], read_lots(spark, fact_path, fact, other_than=lot))
    seen = Observation(f"{fact}-{lot}-{uuid.uuid4().hex[:8]}")
    good = rows.observe(seen, *L.fate_counts()).where(F.col("_suerte") == L.LOADED)
    write_clean(conform(good, FACT_SCHEMAS[fact]), os.path.join(fact_path, f"{LOT}={lot}"))
    facts = [*FACT_SCHEMAS[fact].names, "_texto"]
    losers = rows.where(F.col("_suerte").isin(L.KNOWN, L.REPEATED)).select("_suerte", *facts)
    return Lot({k: int(v) for k, v in seen.get.items()}, losers.withColumnsRenamed({"_suerte": "suerte", "_texto": "texto"}), parsed.rejects)


def load_lot(spark: SparkSession, staging_path: str, name: str, fact: str, parse, fact_path: str, lot: str) -> Lot:
    """File -> staging scan with malformed lines -> parse -> :func:`write_lot`."""
    staged = scan_staging(spark, staging_path, STAGING_WIDTH[name], STAGING_ENCODING[name])
    return write_lot(spark, parse(staged), fact, fact_path, lot)
