"""Fate of each row of a load: one pass that knows the natural key of the table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewise.operators.common import as_list

LOADED, SUPPRESSED, REJECTED, KNOWN, REPEATED = "cargada", "suprimida", "rechazada", "ya_cargada", "repetida"
FATES = (LOADED, SUPPRESSED, REJECTED, KNOWN, REPEATED)


def same_key(a: DataFrame, b: DataFrame, keys) -> Column:
    """NULL-safe equality of a natural key: two NULLs are the same value."""
    return reduce(Column.__and__, [a[k].eqNullSafe(b[k]) for k in as_list(keys)])


def not_in(df: DataFrame, other: DataFrame, keys) -> DataFrame:
    """Rows of ``df`` whose natural key does not occur in ``other``: a NULL-safe anti-join."""
    return df.join(other, same_key(df, other, keys), "left_anti")


def fuse_on_key(left: DataFrame, right: DataFrame, keys) -> tuple[DataFrame, DataFrame]:
    """Both tables with each cell of the natural key taken from the left where it has it, and the rows that gave way."""
    losers = right.join(left, same_key(right, left, keys), "left_semi")
    return left.unionByName(not_in(right, left, keys)), losers


def tag_fates(tagged: DataFrame, keys, value: str, known: DataFrame | None = None, text: str = "_texto") -> DataFrame:
    """Adds ``_suerte`` to rows that :func:`tidewise.operators.quality.tag_rejects` has tagged.

    rechazada: failed a check; suprimida: a good row without a value; ya_cargada: its natural key is in ``known`` (rows of
    other loads); repetida: an earlier row of this load has the key, by the order of ``text``; cargada: the rest.
    One shuffle by the natural key. Rows that cannot be loaded have no key: they spread by their
    text, so that a table of rejects is no hot key.
    """
    keys = as_list(keys)
    good = F.col("_reject").isNull() & F.col(value).isNotNull()
    is_known = F.lit(False)
    if known is not None:
        cells = known.select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct().withColumn("_known", F.lit(True))
        tagged = tagged.join(cells, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]), "left")
        is_known = F.coalesce(F.col("_known"), F.lit(False))
    cell = Window.partitionBy(*[F.when(good, F.col(k)) for k in keys], F.when(~good, F.xxhash64(text))).orderBy(F.col(text))
    fate = (F.when(F.col("_reject").isNotNull(), REJECTED).when(F.col(value).isNull(), SUPPRESSED).when(is_known, KNOWN)
            .when(F.row_number().over(cell) > 1, REPEATED).otherwise(LOADED))
    out = tagged.withColumn("_suerte", fate)
    return out.drop("_known", *[f"_k_{k}" for k in keys]) if known is not None else out


def fate_counts() -> list[Column]:
    """Aggregates for ``DataFrame.observe``: rows read, and rows of each fate."""
    return [F.count(F.lit(1)).alias("leidas")] + [F.count_if(F.col("_suerte") == f).alias(f) for f in FATES]
