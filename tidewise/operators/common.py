"""Small shared helpers for operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def year_between(date_col, y0: int, y1: int) -> Column:
    """Half-open date range for calendar years y0..y1 (pushes both bounds to a scan,
    unlike ``year(d) BETWEEN``)."""
    d = col(date_col)
    return (d >= F.make_date(F.lit(y0), F.lit(1), F.lit(1))) & (d < F.make_date(F.lit(y1 + 1), F.lit(1), F.lit(1)))


def year_is(date_col, y: int) -> Column:
    return year_between(date_col, y, y)


def year_in(date_col, years) -> Column:
    out = None
    for y in years:
        p = year_is(date_col, y)
        out = p if out is None else (out | p)
    return out


def as_list(x):
    if x is None:
        return []
    return [x] if isinstance(x, (str, Column)) else list(x)
