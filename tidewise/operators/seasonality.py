"""Seasonality statistics: pooled CV, fixed-bucket CV, monthly profile, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewise.functions.ratios import pct, safe_divide
from tidewise.operators.common import as_list, col


def cv_sample(value, decimals: int = 1):
    """Aggregate: sample CV (%) of the non-null values.

    Count, sum and sum of squares are exact decimals, so the result does not depend on the
    order in which rows meet. NULL for one value or a zero mean.
    """
    v = col(value).cast("decimal(18,2)")
    n, total, squares = F.count(v), F.sum(v), F.sum(v * v)
    spread = (n * squares - total * total).cast("double")
    deviation = F.sqrt(spread / F.nullif(n * (n - 1), F.lit(0)).cast("double"))
    mean = total.cast("double") / F.nullif(n, F.lit(0)).cast("double")
    return F.round(deviation / F.nullif(mean, F.lit(0.0)) * 100, decimals)


def cv_pooled(df: DataFrame, entity, periods, value, name: str = "cv",
              decimals: int = 1) -> DataFrame:
    """Sample CV (%) of per-period totals, pooled over every period present.

    Two aggregations: SUM per (entity, period), then the CV per entity.
    Absent periods are skipped (not zero); one period gives NULL.
    """
    ent = as_list(entity)
    per = df.groupBy(*ent, *as_list(periods)).agg(F.sum(col(value)).alias("_v"))
    return per.groupBy(*ent).agg(cv_sample("_v", decimals).alias(name))


def cv_fixed_buckets(df: DataFrame, entity, bucket, value, n: int = 4,
                     name: str = "indice_estacionalidad", decimals: int = 6, also=()) -> DataFrame:
    """Population CV of ``n`` bucket totals (buckets 1..n), a missing bucket counts 0.

    Conditional sums give the n totals in one aggregation, with the aggregates of
    ``also``; the closed formula then runs per row.
    """
    ent = as_list(entity)
    b = col(bucket)
    agg = df.groupBy(*ent).agg(*[F.sum(F.when(b == i, col(value))).cast("double").alias(f"_t{i}")
                                 for i in range(1, n + 1)], *also)
    ts = [F.coalesce(F.col(f"_t{i}"), F.lit(0.0)) for i in range(1, n + 1)]
    mean = safe_divide(sum(ts[1:], ts[0]), F.lit(float(n)))
    var = safe_divide(sum([(t - mean) * (t - mean) for t in ts[1:]], (ts[0] - mean) * (ts[0] - mean)),
                      F.lit(float(n)))
    return agg.withColumn(name, F.round(safe_divide(F.sqrt(var), mean), decimals)).drop(
        *[f"_t{i}" for i in range(1, n + 1)])


def monthly_share(df: DataFrame, entity, date_col, value, name: str = "pct_del_anual",
                  decimals: int = 1) -> DataFrame:
    """Each calendar month's share of the entity's pooled total (months pooled over years)."""
    ent = as_list(entity)
    m = df.groupBy(*ent, F.month(col(date_col)).alias("mes")).agg(
        F.sum(col(value)).alias("turistas_mes"))
    total = F.sum("turistas_mes").over(Window.partitionBy(*ent))
    return m.select(*ent, "mes", "turistas_mes", pct("turistas_mes", total, decimals).alias(name))


def low_season_windows(shares: DataFrame, share_col: str = "pct_del_anual",
                       threshold: float = 5.0) -> DataFrame:
    """Months whose share of the year is below ``threshold`` percent."""
    return shares.where(F.col(share_col) < threshold)


def period_coverage(df: DataFrame, entity, period, name: str = "n_periodos") -> DataFrame:
    """Number of distinct periods with data per entity (exact)."""
    return df.groupBy(*as_list(entity)).agg(F.count_distinct(col(period)).alias(name))


def coverage_flag(df: DataFrame, entity, date_col, reliable_months: int = 12) -> DataFrame:
    """Months present per entity and whether the monthly series is complete enough."""
    cov = period_coverage(df, entity, F.month(col(date_col)), "meses_con_datos")
    return cov.withColumn("fiable", F.col("meses_con_datos") >= reliable_months)
