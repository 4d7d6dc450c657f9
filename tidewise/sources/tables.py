"""Parquet table access and the region dimension."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewise.schemas import DIM_REGION


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def in_years(df: DataFrame, column: str, years) -> DataFrame:
    """Rows whose ``column`` falls in one of the (first, last) calendar year ranges; None: all rows.

    The raw column is compared with literals of its own type, so the bounds reach the scan.
    """
    if years is None:
        return df
    kind = dt.date if df.schema[column].dataType.typeName() == "date" else dt.datetime
    ranges = [(F.col(column) >= F.lit(kind(a, 1, 1))) & (F.col(column) < F.lit(kind(b + 1, 1, 1))) for a, b in years]
    return df.where(reduce(lambda x, y: x | y, ranges))


def region_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region dimension (id_ccaa, destino); the planner's size check decides on a broadcast."""
    n = table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    return n.select(F.col("n_nationkey").cast("int").alias("id_ccaa"), F.col("n_name").alias("destino"))


def read_region_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quoted, comma separated region file with header (values may contain commas)."""
    return (spark.read.schema(DIM_REGION).option("header", True).option("quote", '"')
            .option("encoding", "UTF-8").csv(path))
