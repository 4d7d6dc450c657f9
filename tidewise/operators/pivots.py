"""Conditional-aggregate pivots (one shuffle; categories are known up front)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewise.operators.common import as_list, col

_AGG = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min, "count": F.count}


def _match(cat: Column, spec) -> Column:
    if isinstance(spec, Column):
        return spec
    if isinstance(spec, str):
        return cat.like(spec) if "%" in spec else cat == spec
    return cat.isin(*spec)


def pivot_columns(cat, value, spec: dict, agg: str = "sum") -> list[Column]:
    """One aggregate column per alias: ``agg(CASE WHEN cat matches THEN value END)``.

    ``spec`` maps alias -> category, LIKE pattern (contains '%'), list of categories
    or a predicate Column. No matching row gives NULL (not 0), as in SQL.
    """
    cat, value = col(cat), col(value)
    return [_AGG[agg](F.when(_match(cat, s), value)).alias(a) for a, s in spec.items()]


def pivot_agg(df: DataFrame, keys, cat, value, spec: dict, agg: str = "sum") -> DataFrame:
    return df.groupBy(*as_list(keys)).agg(*pivot_columns(cat, value, spec, agg))


def pivot_by_year(df: DataFrame, keys, year, value, years, prefix: str,
                  agg: str = "sum") -> DataFrame:
    """Columns ``{prefix}{y}`` holding the aggregate of ``value`` in each year."""
    y = col(year)
    spec = {f"{prefix}{yy}": (y == yy) for yy in years}
    return pivot_agg(df.where(y.isin(*years)), keys, y, value, spec, agg)


def eav_pick(df: DataFrame, keys, metric, value, spec: dict, on_double: str = "error") -> DataFrame:
    """Pick one value per metric from a long (entity-attribute-value) table: MAX(CASE).

    A cell should have one row. Two would hide one another, so they end the query, unless ``on_double`` is "max".
    """
    if on_double == "max":
        return pivot_agg(df, keys, metric, value, spec, "max")
    picked = pivot_columns(metric, value, spec, "max")
    counted = pivot_columns(metric, value, spec, "count")
    checked = [F.when(n > 1, F.raise_error(F.lit(f"several rows in one cell of {a}"))).otherwise(v).alias(a)
               for a, v, n in zip(spec, picked, counted, strict=True)]
    return df.groupBy(*as_list(keys)).agg(*checked)
