"""Mergeable partial states: a new load updates a statistic without rereading the old rows.

A state is a small table that is stored per load and merged by aggregation: months present as a bit mask
(merged by OR) and period totals with their number of rows (merged by sums). The statistic is computed from the
merged state and equals that over all rows, whatever rows the loads share out, also within one period.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewise.operators.common import as_list, col
from tidewise.operators.seasonality import cv_sample

LOT = "carga"


def month_state(df: DataFrame, entity, date_col) -> DataFrame:
    """(entity, anio, meses): bit m - 1 of ``meses`` is set if month m has a row."""
    d = col(date_col)
    bit = F.call_function("shiftleft", F.lit(1), F.month(d) - 1)
    return df.where(d.isNotNull()).groupBy(*as_list(entity), F.year(d).alias("anio")).agg(F.bit_or(bit).alias("meses"))


def merge_months(states: DataFrame, entity) -> DataFrame:
    return states.groupBy(*as_list(entity), "anio").agg(F.bit_or("meses").alias("meses"))


def coverage(states: DataFrame, entity, by_year: bool = True, reliable_months: int = 12) -> DataFrame:
    """Distinct months with data from merged masks, of each year or of all years together, and whether they are enough."""
    keys = [*as_list(entity), *(["anio"] if by_year else [])]
    return (states.groupBy(*keys).agg(F.bit_count(F.bit_or("meses")).cast("long").alias("meses_con_datos"))
            .withColumn("fiable", F.col("meses_con_datos") >= reliable_months))


def absent_months(states: DataFrame, entity, whole_year: int = 0xFFF) -> DataFrame:
    """A row for each month of a year that an entity with data in that year lacks."""
    gaps = F.filter(F.sequence(F.lit(1), F.lit(12)), lambda m: F.call_function(
        "shiftright", F.bitwise_not(F.col("meses")).bitwiseAND(whole_year), m - 1).bitwiseAND(1) == 1)
    return merge_months(states, entity).select(*as_list(entity), "anio", F.explode(gaps).alias("mes"))


def total_state(df: DataFrame, entity, periods, value) -> DataFrame:
    """(entity, periods, n, total): rows with a value and their sum, exact."""
    v = col(value).cast("decimal(18,2)")
    return df.groupBy(*as_list(entity), *as_list(periods)).agg(F.count(v).alias("n"), F.sum(v).alias("total"))


def merge_totals(states: DataFrame, entity, periods) -> DataFrame:
    return states.groupBy(*as_list(entity), *as_list(periods)).agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(18,2)").alias("total"))


def cv_from_totals(states: DataFrame, entity, periods, name: str = "cv", decimals: int = 1) -> DataFrame:
    """The pooled CV of :func:`tidewise.operators.seasonality.cv_pooled` from states of any number of loads."""
    return merge_totals(states, entity, periods).groupBy(*as_list(entity)).agg(cv_sample("total", decimals).alias(name))


def write_state(state: DataFrame, path: str, lot: str) -> None:
    """Store the state of one load; storing it again replaces it."""
    state.write.mode("overwrite").parquet(os.path.join(path, f"{LOT}={lot}"))


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """The states of all loads, not merged."""
    return spark.read.parquet(path).drop(LOT)
