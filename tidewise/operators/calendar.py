"""Dense month calendars: every entity has a row for each month, so that a lag is a span of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewise.functions.ratios import growth_pct
from tidewise.operators.common import as_list, col


def scaffold(df: DataFrame, entity, date_col, span=None) -> DataFrame:
    """(entity, fecha) with a row for every month from the first to the last: of ``span``, or of the entity itself."""
    d = F.trunc(col(date_col), "month")
    if span:
        lo, hi = (F.lit(x).cast("date") for x in span)
        ends = df.select(*as_list(entity)).distinct().select("*", lo.alias("_lo"), hi.alias("_hi"))
    else:
        ends = df.where(d.isNotNull()).groupBy(*as_list(entity)).agg(F.min(d).alias("_lo"), F.max(d).alias("_hi"))
    months = F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 month")))
    return ends.select(*as_list(entity), months.alias("fecha"))


def dense_months(df: DataFrame, entity, date_col, value, name: str = "total", span=None, fill=None) -> DataFrame:
    """(entity, fecha, name, ausente): monthly totals on the scaffold.

    A month without rows is ``ausente`` and has ``fill`` (NULL: unknown, or 0: nothing happened); one with rows but no value
    is not absent and has NULL.
    """
    keys = as_list(entity)
    have = df.groupBy(*keys, F.trunc(col(date_col), "month").alias("fecha")).agg(
        F.sum(col(value)).alias(name), F.lit(True).alias("_have"))
    out = scaffold(df, entity, date_col, span).join(have, [*keys, "fecha"], "left")
    absent = F.col("_have").isNull()
    total = F.when(absent, F.lit(fill)).otherwise(F.col(name)) if fill is not None else F.col(name)
    return out.select(*keys, "fecha", total.alias(name), absent.alias("ausente"))


def growth_by_calendar(dense: DataFrame, entity, value, months: int = 12, prev_name: str = "anterior",
                       growth_name: str = "crecimiento_pct", decimals: int = 1) -> DataFrame:
    """Growth against the row ``months`` earlier. On a dense calendar that is the same month of another year;
    an absent month gives NULL instead of another month's value."""
    w = Window.partitionBy(*as_list(entity)).orderBy("fecha")
    out = dense.withColumn(prev_name, F.lag(col(value), months).over(w))
    return out.withColumn(growth_name, growth_pct(value, prev_name, decimals))
