"""Clean-table sinks: schema conformance and year-partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewise.operators.common import as_list


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project exactly the declared columns, cast to the declared types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def _by_year(df: DataFrame) -> DataFrame:
    return df if "anio" in df.columns else df.withColumn("anio", F.year("fecha"))


def write_clean(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Publish a clean fact partitioned by year, so year filters prune files."""
    _by_year(df).write.mode(mode).partitionBy("anio").parquet(path)


def write_clustered(df: DataFrame, path: str, cluster, rows_per_file: int = 5_000_000, parts: int | None = None, mode: str = "overwrite") -> None:
    """Publish a fact by year with the rows of a year in ranges of ``cluster``: a region lies in few files and row groups.

    The ranges are sampled, so a year or region with many rows gets several tasks; files have at most ``rows_per_file``
    rows. A filter on the cluster columns then skips files and row groups by their statistics.
    """
    rows = _by_year(df)
    order = ["anio", *as_list(cluster)]
    spread = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    (spread.sortWithinPartitions(*order).write.mode(mode).option("maxRecordsPerFile", rows_per_file)
     .partitionBy("anio").parquet(path))


def append_clean(df: DataFrame, path: str) -> None:
    """Append a load to a published fact."""
    write_clean(df, path, "append")


def read_clean(spark: SparkSession, path: str, schema: T.StructType | None = None, years=None) -> DataFrame:
    """A published fact, optionally only the partitions of the years from..to, in its schema."""
    df = spark.read.parquet(path)
    if years is not None:
        df = df.where(F.col("anio").between(*years))
    return conform(df, schema) if schema is not None else df


def write_csv(df: DataFrame, path: str, sep: str = ";", encoding: str = "UTF-8") -> None:
    """Text export for BI tools."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).option("encoding", encoding).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ";", encoding: str = "UTF-8") -> DataFrame:
    """An export read back with its declared schema."""
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("encoding", encoding).csv(path)
