"""Parsers for locale-formatted statistical extracts (all built-in expressions).

Spanish numbers use '.' for thousands and ',' for decimals: ``3.576.058,81``.
Missing values are published as '', '.' or '..'. Region labels carry a two-digit
national code prefix (``"01 Andalucía"``). Periods are ``2025T3``, ``2026M01``
or ``2024``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewise.vocab import MISSING_MARKERS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_missing(c) -> Column:
    """True for NULL or an exact missing marker (after trimming)."""
    c = _col(c)
    return c.isNull() | F.trim(c).isin(*MISSING_MARKERS)


def empty_to_null(c) -> Column:
    """NULLIF(TRIM(c), '')."""
    return F.nullif(F.trim(_col(c)), F.lit(""))


def parse_number_es(c, kind: str = "decimal(14,2)") -> Column:
    """Spanish-format number -> typed value; NULL for missing markers or bad text.

    ``kind='bigint'`` only strips thousands dots, so a decimal comma does not parse
    (the row is then reported as a reject by :func:`tidewise.operators.quality.split_rejects`).
    """
    t = F.trim(_col(c))
    if kind in ("bigint", "long", "int", "integer"):
        text = F.replace(t, F.lit("."), F.lit(""))
    else:
        text = F.translate(t, ",.", ".")       # ',' -> '.', '.' -> removed
    return F.when(is_missing(c), F.lit(None)).otherwise(text.try_cast(kind))


def format_number_es(c, decimals: int = 0) -> Column:
    """Inverse of :func:`parse_number_es` (used to publish extracts)."""
    us = F.format_number(_col(c).cast("decimal(38,2)") if decimals else _col(c), decimals)
    return F.translate(us, ",.", ".,")


def split_code_label(c, code_len: int = 2) -> tuple[Column, Column]:
    """``"01 Andalucía"`` -> (1, "Andalucía"). No space keeps the whole text as label."""
    t = F.trim(_col(c))
    code = F.left(t, F.lit(code_len)).try_cast("int")
    label = F.trim(F.substr(t, F.locate(" ", t) + 1))
    return code, label


def parse_period(c, kind: str) -> dict[str, Column]:
    """Period text -> calendar columns; ``fecha`` is the first day of the period."""
    t = F.trim(_col(c))
    anio = F.left(t, F.lit(4)).try_cast("int")
    if kind == "year":
        return {"anio": t.try_cast("int")}
    if kind == "quarter":
        q = F.right(t, F.lit(1)).try_cast("int")
        fecha = F.when(q.between(1, 4), F.make_date(anio, (q - 1) * 3 + 1, F.lit(1)))
        return {"anio": anio, "trimestre": q, "fecha": fecha}
    if kind == "month":
        m = F.right(t, F.lit(2)).try_cast("int")
        fecha = F.when(m.between(1, 12), F.make_date(anio, m, F.lit(1)))
        return {"anio": anio, "mes": m, "fecha": fecha}
    raise ValueError(f"unknown period kind {kind!r}")


def map_patterns(c, pairs, default=None, trim: bool = False) -> Column:
    """First LIKE pattern that matches gives the label; no match gives ``default``."""
    c = F.trim(_col(c)) if trim else _col(c)
    out = None
    for pattern, label in pairs:
        out = (F.when(c.like(pattern), F.lit(label)) if out is None
               else out.when(c.like(pattern), F.lit(label)))
    return out.otherwise(F.lit(default)) if default is not None else out


#: Rules of one mapping table; they become one expression.
MAX_RULES = 500


def read_rules(rules: DataFrame) -> list[tuple[str, str]]:
    """(pattern, label) pairs of a rule table (precedencia, patron, etiqueta) in their order; equal precedence: by pattern.

    A table of more than MAX_RULES rows, a rule without a pattern or label, and a pattern that stands twice are errors.
    """
    rows = rules.select("precedencia", "patron", "etiqueta").orderBy("precedencia", "patron").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"a mapping table has at most {MAX_RULES} rules")
    pairs = [(r["patron"], r["etiqueta"]) for r in rows]
    if any(p is None or e is None for p, e in pairs) or len({p for p, _ in pairs}) < len(pairs):
        raise ValueError("a rule needs a pattern of its own and a label")
    return pairs


def map_by_rules(c, rules: DataFrame, default=None, trim: bool = False) -> Column:
    """:func:`map_patterns` with the patterns as data: a new category is a new row of the table."""
    pairs = read_rules(rules)
    return map_patterns(c, pairs, default, trim) if pairs else F.lit(default).cast("string")


def unmapped(df: DataFrame, column: str, rules: DataFrame, trim: bool = False) -> DataFrame:
    """(nombre, filas): the names that no rule maps, NULL aside."""
    label = map_by_rules(column, rules, trim=trim)
    return (df.where(F.col(column).isNotNull() & label.isNull()).groupBy(F.col(column).alias("nombre"))
            .agg(F.count(F.lit(1)).alias("filas")))
