"""Registered queries: key -> (spark, sf_dir) -> DataFrame, over the bound facts."""

from __future__ import annotations

from tidewise import vocab as V
from tidewise.plans import queries as Q
from tidewise.sources import bindings as B

P = B.PARAMS
LEVEL = {"low": (20, 20), "medium": (24, 26)}
KLASS = {"massive_volume": 600, "massive_cv": (24, 20), "alt_cv": 23, "alt_volume": 420,
         "alt_leisure": 24}

QUERIES = {}


def register(key):
    def deco(fn):
        QUERIES[key] = fn
        return fn
    return deco


YEAR = [(P["last_year"], P["last_year"])]


def facts(spark, d, *names, years=None):
    """The named facts; ``years`` restricts them, in the scans, to (first, last) ranges."""
    return [B.FACTS[n](spark, d, years=years) for n in names]


def trips(spark, d, *metrics, years=None):
    """The quarterly fact with the named metrics only."""
    return B.fx_trips_q(spark, d, years=years, metrics=metrics)


def demand(spark, d, *metrics, years=None):
    """The demand fact with the named metrics only."""
    return B.fx_demand_m(spark, d, years=years, metrics=metrics)


@register("q01_monthly_share")
def _q01(spark, d):
    (f,) = facts(spark, d, "foreign_motives", years=[P["share_years"]])
    return Q.q01_monthly_share(f, P["share_years"], P["focus"])


@register("q02_scorecard")
def _q02(spark, d):
    span = [(min(P["cv_years"][0], P["last_year"]), max(P["cv_years"][1], P["last_year"]))]
    (f,) = facts(spark, d, "foreign_motives", years=span)
    s, r = facts(spark, d, "foreign_spend", "residents", years=YEAR)
    return Q.q02_scorecard(trips(spark, d, V.TRIPS, years=span), f, s, r, P["last_year"], P["cv_years"], LEVEL, KLASS)


@register("q03_motive_share")
def _q03(spark, d):
    (r,) = facts(spark, d, "residents", years=YEAR)
    return Q.q03_motive_share(r, P["last_year"])


@register("q04_leisure_breakdown")
def _q04(spark, d):
    (r,) = facts(spark, d, "residents", years=YEAR)
    return Q.q04_leisure_breakdown(r, P["last_year"])


@register("q05_foreign_motive_share")
def _q05(spark, d):
    (f,) = facts(spark, d, "foreign_motives", years=YEAR)
    return Q.q05_foreign_motive_share(f, P["last_year"])


@register("q06_lodging_mix")
def _q06(spark, d):
    (r,) = facts(spark, d, "residents", years=YEAR)
    return Q.q06_lodging_mix(r, P["last_year"])


@register("q07_spend_compare")
def _q07(spark, d):
    (s,) = facts(spark, d, "foreign_spend", years=YEAR)
    return Q.q07_spend_compare(trips(spark, d, V.TRIPS, V.SPEND_TOTAL, years=YEAR), s, P["last_year"])


@register("q08_stay_compare")
def _q08(spark, d):
    span = [P["share_years"]]
    (s,) = facts(spark, d, "foreign_spend", years=span)
    return Q.q08_stay_compare(trips(spark, d, B.DURATION, years=span), s, P["share_years"])


@register("q09_evolution")
def _q09(spark, d):
    span = [P["evo_years"]]
    f, r, s = facts(spark, d, "foreign_motives", "residents", "foreign_spend", years=span)
    return Q.q09_evolution(trips(spark, d, V.TRIPS, years=span), f, r, s, P["evo_years"], P["focus"])


@register("q10_emerging")
def _q10(spark, d):
    points = (P["first_year"], P["pre_year"], P["last_year"])
    ranges = [(y, y) for y in points]
    f, s, r = facts(spark, d, "foreign_motives", "foreign_spend", "residents", years=ranges)
    return Q.q10_emerging(trips(spark, d, V.TRIPS, years=ranges), f, s, r, points)


def _capacity_demand(mode):
    def run(spark, d):
        c, m = facts(spark, d, "capacity", "demand", years=YEAR)
        return Q.q11_capacity_demand(c, m, P["last_year"], mode)
    return run


register("q11_capacity_demand")(_capacity_demand("parts"))
register("q11_capacity_demand_total_row")(_capacity_demand("total_row"))

import tidewise.plans.registry_measures  # noqa: E402,F401  (registers measures)
import tidewise.plans.registry_etl  # noqa: E402,F401  (registers ingest keys)
import tidewise.plans.registry_blocks  # noqa: E402,F401  (registers building blocks)
