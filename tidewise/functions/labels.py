"""Ordered rule labelling (searched CASE with fall-through)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def classify_expr(rules, default=None) -> Column:
    """``rules``: ordered (predicate Column, label). A NULL predicate falls through."""
    out = None
    for pred, label in rules:
        out = F.when(pred, F.lit(label)) if out is None else out.when(pred, F.lit(label))
    return out.otherwise(F.lit(default)) if default is not None else out


def band_expr(c, cuts, labels) -> Column:
    """Label a value by sorted cut points: labels[i] for cuts[i-1] <= c < cuts[i].

    ``labels`` has one more entry than ``cuts``; NULL stays NULL.
    """
    assert len(labels) == len(cuts) + 1 and list(cuts) == sorted(cuts)
    c = F.col(c) if isinstance(c, str) else c
    out = F.when(c.isNull(), F.lit(None))
    for cut, label in zip(cuts, labels):
        out = out.when(c < cut, F.lit(label))
    return out.otherwise(F.lit(labels[-1]))
