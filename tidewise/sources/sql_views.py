"""The facts for queries written in SQL: temporary views, and the library's ratio and parsing rules as SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rounded quotient of exact numbers, half away from zero, NULL on a zero denominator (as ``functions.ratios``).
_QUOTIENT = ("CASE WHEN den != 0 THEN sign(num) * sign(den) * (((abs(CAST(num * 100 AS DECIMAL(38,0))) * {k} * 2 + abs(CAST(den * 100 AS DECIMAL(38,0)))) "
             "DIV (abs(CAST(den * 100 AS DECIMAL(38,0))) * 2))) END")
FUNCTIONS = {
    "pct_exact(num DECIMAL(20,2), den DECIMAL(20,2)) RETURNS DOUBLE": f"CAST({_QUOTIENT.format(k=1000)} AS DOUBLE) / 10",
    "cociente(num DECIMAL(20,2), den DECIMAL(20,2), factor INT) RETURNS DECIMAL(20,2)":
        f"CAST(CAST({_QUOTIENT.format(k='factor * 100')} AS DECIMAL(20,0)) / 100 AS DECIMAL(20,2))",
    "numero_es(texto STRING) RETURNS DECIMAL(14,2)":
        "CASE WHEN trim(texto) IN ('', '.', '..') THEN NULL ELSE try_cast(translate(trim(texto), ',.', '.') AS DECIMAL(14,2)) END",
    "codigo_region(etiqueta STRING) RETURNS INT": "try_cast(left(trim(etiqueta), 2) AS INT)",
}


def register_functions(spark: SparkSession) -> None:
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


def register_views(facts: dict[str, DataFrame]) -> None:
    """Each fact as a temporary view of its name. A view is a plan: filters of a query reach its scans."""
    for name, df in facts.items():
        df.createOrReplaceTempView(name)


def run_sql(spark: SparkSession, text: str, facts: dict[str, DataFrame], **parameters) -> DataFrame:
    """Run SQL over the named facts; ``:name`` in the text takes a parameter's value."""
    register_functions(spark)
    register_views(facts)
    return spark.sql(text, args=parameters)
