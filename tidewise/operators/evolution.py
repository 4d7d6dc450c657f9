"""Year-on-year growth, multi-point growth, regimes and base-year indices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewise.functions.labels import classify_expr
from tidewise.functions.ratios import growth_pct, round_div
from tidewise.operators.common import as_list, col


def yoy(df: DataFrame, entity, year, value, prev_name: str, growth_name: str,
        strict_year: bool = False, decimals: int = 1) -> DataFrame:
    """Previous row's value (LAG 1 by year within entity) and growth % against it.

    The lag is computed once and reused. ``strict_year`` blanks the lag when the
    previous row is not the previous calendar year.
    """
    w = Window.partitionBy(*as_list(entity)).orderBy(col(year))
    out = df.withColumn(prev_name, F.lag(col(value)).over(w))
    if strict_year:
        out = out.withColumn(prev_name, F.when(F.lag(col(year)).over(w) == col(year) - 1,
                                               F.col(prev_name)))
    return out.withColumn(growth_name, growth_pct(value, prev_name, decimals))


def growth_between(df: DataFrame, keys, year, value, points, prefix: str,
                   leg_prefix: str | None = None, agg: str = "sum",
                   decimals: int = 1) -> DataFrame:
    """One column per point (``prefix{y}``) and one growth % per consecutive leg."""
    y = col(year)
    f = {"sum": F.sum, "max": F.max}[agg]
    cols = [f(F.when(y == p, col(value))).alias(f"{prefix}{p}") for p in points]
    out = df.where(y.isin(*points)).groupBy(*as_list(keys)).agg(*cols)
    if leg_prefix:
        for a, b in zip(points, points[1:]):
            out = out.withColumn(f"{leg_prefix}{a % 100:02d}_{b % 100:02d}",
                                 growth_pct(f"{prefix}{b}", f"{prefix}{a}", decimals))
    return out


def growth_regime(first_leg, second_leg):
    """structural: both legs > 0; rebound: first <= 0 and second > 0; decline: second < 0;
    flat second leg: stable; a missing leg gives NULL."""
    a, b = col(first_leg), col(second_leg)
    return classify_expr([((a > 0) & (b > 0), "estructural"),
                          ((a <= 0) & (b > 0), "rebote"),
                          (b < 0, "retroceso"),
                          (b == 0, "estable")])


def index_to_base(df: DataFrame, entity, year, value, base: int, name: str = "indice",
                  decimals: int = 6) -> DataFrame:
    """value / value in the base year * 100 within each entity, exact (NULL without a base row)."""
    w = Window.partitionBy(*as_list(entity))
    base_v = F.sum(F.when(col(year) == base, col(value))).over(w)
    return df.withColumn(name, round_div(value, base_v, decimals, 100))
