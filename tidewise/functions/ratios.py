"""Exact, NULL-safe ratios.

``ROUND(a::NUMERIC / NULLIF(b, 0) * 100, 1)`` in the statistics SQL is exact
decimal arithmetic rounded half away from zero. Dividing doubles instead gives a
different answer whenever the exact quotient sits on a rounding tie (e.g. 33.35),
and different engines disagree there. For exact inputs (integers, or decimals
with at most two fraction digits) we therefore round the rational number itself
with integer arithmetic, which is cheap, JVM-side and order independent.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_EXACT = "decimal(38,0)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _rounded_int(num, den, k: int) -> Column:
    """round_half_away_from_zero(num * k / den) as a bigint; NULL if den is 0/NULL.

    num and den may carry up to two decimals; both are scaled by 100 (exact),
    which leaves the ratio unchanged.
    """
    n = (_col(num).cast("decimal(36,2)") * 100).cast(_EXACT)
    d = (_col(den).cast("decimal(36,2)") * 100).cast(_EXACT)
    an, ad = F.abs(n), F.abs(d)
    q = F.call_function("div", an * (2 * k) + ad, ad * 2)
    return F.when(d != 0, F.when((n < 0) != (d < 0), -q).otherwise(q))


def round_div(num, den, scale: int = 0, factor: int = 1) -> Column:
    """num * factor / den rounded half away from zero to ``scale`` decimals (double)."""
    return _rounded_int(num, den, factor * 10 ** scale) / (10 ** scale)


def round_div_decimal(num, den, scale: int = 2, factor: int = 1,
                      precision: int = 14) -> Column:
    """Like :func:`round_div` but returns ``decimal(precision, scale)``."""
    q = _rounded_int(num, den, factor * 10 ** scale).cast("decimal(20,0)")
    return (q * F.lit(Decimal(1).scaleb(-scale))).cast(f"decimal({precision},{scale})")


def pct(num, den, scale: int = 1) -> Column:
    """Share in percent: num / den * 100, NULL when den is 0 or NULL."""
    return round_div(num, den, scale, 100)


def growth_pct(new, old, scale: int = 1) -> Column:
    """Growth in percent: (new - old) / old * 100, NULL when old is 0 or NULL."""
    return round_div(_col(new) - _col(old), old, scale, 100)


def safe_divide(num, den) -> Column:
    """Dashboard-style DIVIDE: blank (NULL) on a zero or blank denominator."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))
