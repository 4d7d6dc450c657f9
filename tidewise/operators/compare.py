"""Outer comparison of two populations keyed by region."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outer_compare(left: DataFrame, right: DataFrame, key: str, label: str | None = None,
                  fallback_prefix: str = "CC.AA. ") -> DataFrame:
    """FULL OUTER join on ``key``; ``label`` comes from the left side, else
    ``fallback_prefix || key``. Both inputs are aggregated (one row per key)."""
    j = left.join(right, key, "full")
    if label is not None:
        j = j.withColumn(label, F.coalesce(F.col(label), F.concat(F.lit(fallback_prefix),
                                                                   F.col(key).cast("string"))))
    return j
