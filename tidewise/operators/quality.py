"""Load-time data quality: rejects, missing rows, fusing marginals, audits, previews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewise.operators.common import as_list


def tag_rejects(df: DataFrame, checks: dict) -> DataFrame:
    """Adds ``_reject``: the first failed check's name, NULL for a good row.

    ``checks`` maps reason -> Column that is True when the row is bad.
    """
    reason = None
    for r, bad in checks.items():
        reason = F.when(bad, F.lit(r)) if reason is None else reason.when(bad, F.lit(r))
    return df.withColumn("_reject", reason)


def raw_text(raw_cols, line=None):
    """The fields of a row as one text; ``line`` names a column that holds the whole line where it is known."""
    fields = F.concat_ws(";", *[F.coalesce(F.col(c), F.lit("")) for c in raw_cols])
    return F.coalesce(F.col(line), fields) if line else fields


def split_rejects(df: DataFrame, checks: dict, raw_cols, line=None) -> tuple[DataFrame, DataFrame]:
    """Route rows failing any check to a rejects frame (reason + raw text).

    Both outputs are lazy; a row goes to exactly one of them.
    """
    tagged = tag_rejects(df, checks)
    clean = tagged.where(F.col("_reject").isNull()).drop("_reject")
    raw = raw_text(raw_cols, line)
    rejects = tagged.where(F.col("_reject").isNotNull()).select(
        F.col("_reject").alias("motivo_rechazo"), raw.alias("texto"))
    return clean, rejects


def drop_missing_rows(df: DataFrame, value_col: str) -> DataFrame:
    """Suppressed cells become absent rows (filter before the only write)."""
    return df.where(F.col(value_col).isNotNull())


def fuse_marginals(left: DataFrame, right: DataFrame, overlap) -> DataFrame:
    """Union two marginal tables, dropping right-side rows already in the left.

    A row whose ``overlap`` is NULL is not known to be in the left, so it stays.
    """
    return left.unionByName(right.where(~F.coalesce(overlap, F.lit(False))))


def table_row_counts(tables: dict) -> DataFrame:
    """One (tabla, filas) row per table."""
    parts = [df.agg(F.count("*").alias("filas")).select(F.lit(n).alias("tabla"), "filas")
             for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def load_audit(stages: dict) -> DataFrame:
    """Row fate per table: ``stages[name] = (tagged, value_col)``, see :func:`tag_rejects`.

    read = all rows, rejected = tagged rows, dropped = good rows with a missing value,
    kept = the rest. One pass over each table.
    """
    parts = []
    for n, (tagged, value_col) in stages.items():
        good = F.col("_reject").isNull()
        a = tagged.agg(F.count("*").alias("read"), F.count_if(good & F.col(value_col).isNotNull()).alias("kept"),
                       F.count_if(good & F.col(value_col).isNull()).alias("dropped"),
                       F.count_if(~good).alias("rejected"))
        parts.append(a.select(F.lit(n).alias("tabla"), "read", "kept", "dropped", "rejected"))
    return reduce(DataFrame.unionByName, parts)


def constant_column_check(df: DataFrame, cols) -> DataFrame:
    """Distinct count per column; constant columns can be dropped on load."""
    cols = as_list(cols)
    agg = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in cols])
    stacked = agg.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("columna"), F.col(c).alias("n_distintos")) for c in cols])))
    return stacked.withColumn("constante", F.col("n_distintos") <= 1)


def table_preview(df: DataFrame, keys, n: int = 5) -> DataFrame:
    """Deterministic preview: first ``n`` rows by ``keys`` (top-k, not a full sort)."""
    return df.orderBy(*as_list(keys)).limit(n)


RULES = ("clave_unica", "celda_ambigua", "region_nombre", "region_huerfana", "region_sin_codigo")


def constraint_violations(df: DataFrame, key, value: str, dim: DataFrame, region: str = "id_ccaa", name: str = "destino") -> DataFrame:
    """(regla, violaciones, filas) of a table, one row for each of :data:`RULES`.

    clave_unica: values of the natural key (it holds the region) that several rows have, and the rows beyond the first;
    celda_ambigua: those of them whose rows differ in ``value``, so that picking one by MAX would hide another;
    region_nombre: regions with several names, and their rows; region_huerfana: regions that ``dim`` does not have;
    region_sin_codigo: rows without a region. A NULL in the key is a value. The table is shuffled once, by its
    key, after partial aggregation; the rest is as small as the number of regions.
    """
    cells = df.groupBy(*as_list(key)).agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("lo"), F.max(name).alias("hi"),
                                          (F.min(value) != F.max(value)).alias("differ"))
    differ = F.coalesce(F.col("differ"), F.lit(False))
    regions = cells.groupBy(region).agg(
        F.sum("n").alias("n"), F.count_if(F.col("n") > 1).alias("keys"), F.sum(F.col("n") - 1).alias("beyond"),
        F.count_if(differ).alias("unsure"), F.sum(F.when(differ, F.col("n")).otherwise(0)).alias("unsure_rows"),
        (F.min("lo") != F.max("hi")).alias("named"))
    known = dim.select(F.col(region).alias("_dim")).distinct()
    judged = regions.join(known, F.col(region) == F.col("_dim"), "left")
    named = F.coalesce(F.col("named"), F.lit(False))
    orphan, lost = F.col(region).isNotNull() & F.col("_dim").isNull(), F.col(region).isNull()

    def rule(label, found, rows):
        return F.struct(F.lit(label).alias("regla"), F.coalesce(F.sum(found.cast("long")), F.lit(0)).alias("violaciones"),
                        F.coalesce(F.sum(rows), F.lit(0)).alias("filas"))

    rows = F.col("n")
    one = judged.agg(F.array(
        rule(RULES[0], F.col("keys"), F.col("beyond")), rule(RULES[1], F.col("unsure"), F.col("unsure_rows")),
        rule(RULES[2], named, F.when(named, rows)), rule(RULES[3], orphan, F.when(orphan, rows)),
        rule(RULES[4], F.when(lost, rows).otherwise(0), F.when(lost, rows))).alias("rules"))
    return one.select(F.inline("rules"))
