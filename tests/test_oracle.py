"""Every registered key against its DuckDB oracle on the smallest scale factor."""

import re

import pytest

import __spark_entry__ as E
from oracle_harness import compare, duck
from tidewise.plans.oracle_sql import ORACLE
from tidewise.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_key_has_an_oracle():
    assert set(QUERIES) == set(ORACLE) and set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "clasificacion" in df.columns


def check_plan(df, key):
    """No cartesian product, and no window over a whole table."""
    execution = df._jdf.queryExecution()
    plan = execution.executedPlan().toString() + execution.optimizedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    for m in re.finditer(r"Window \[.*?\], \[(.*?)\], \[", plan):
        assert m.group(1).strip(), f"window without partition keys in {key}"


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_matches_oracle(spark, con, key):
    df = QUERIES[key](spark, SF)
    check_plan(df, key)
    r = compare(spark, SF, df, ORACLE[key], con)
    assert r["cols_match"] and r["values_match"], r
