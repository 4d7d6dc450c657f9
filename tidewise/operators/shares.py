"""Shares: within a category group, of a partition total, hierarchical, top-N."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewise.functions.ratios import pct, round_div
from tidewise.operators.common import as_list, col
from tidewise.operators.pivots import pivot_columns


def share_within_group(df: DataFrame, keys, cat, value, members, numerators: dict,
                       total_name: str = "total", decimals: int = 1) -> DataFrame:
    """Percent of each numerator category over the sum of ``members`` only."""
    spec = {total_name: list(members)}
    spec.update({f"_n_{a}": c for a, c in numerators.items()})
    agg = df.groupBy(*as_list(keys)).agg(*pivot_columns(cat, value, spec))
    return agg.select(*as_list(keys), total_name,
                      *[pct(f"_n_{a}", total_name, decimals).alias(a) for a in numerators])


def hierarchical_share(df: DataFrame, keys, level1, level2, value, types: dict,
                       subtotals: dict | None = None, exclude_level1=("Total",),
                       decimals: int = 1) -> DataFrame:
    """Level-2 shares over the sum of level-1 subtotals (rows with level 2 NULL).

    ``exclude_level1`` removes grand-total rows stored at the same grain; pass ()
    to reproduce a denominator that also counts them.
    """
    l1, l2 = col(level1), col(level2)
    sub = l2.isNull()
    if exclude_level1:
        sub = sub & ~l1.isin(*exclude_level1)
    spec = {"_total": sub}
    for a, name in (subtotals or {}).items():
        spec[a] = l2.isNull() & (l1 == name)
    spec.update({f"_t_{a}": (l2 == t) for a, t in types.items()})
    agg = df.groupBy(*as_list(keys)).agg(*pivot_columns(l1, value, spec))
    return agg.select(*as_list(keys), *list(subtotals or {}),
                      *[pct(f"_t_{a}", "_total", decimals).alias(a) for a in types])


def top_n_share(df: DataFrame, entity, value, n: int = 5, by=(), name: str = "share_top",
                decimals: int = 6) -> DataFrame:
    """Share of the top ``n`` entities (ties kept, like TOPN) in the total, per ``by``.

    ``df`` holds one row per (by, entity); the rank window is partitioned by ``by``
    (region-sized input after aggregation).
    """
    by = as_list(by)
    w = Window.partitionBy(*by).orderBy(col(value).desc())
    ranked = df.withColumn("_rk", F.rank().over(w))
    agg = ranked.groupBy(*by).agg(F.sum(F.when(F.col("_rk") <= n, col(value))).alias("_top"),
                                  F.sum(col(value)).alias("_all"))
    return agg.select(*by, round_div("_top", "_all", decimals).alias(name))
