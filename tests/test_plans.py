"""Plan checks: what reaches the scans. The plan of every key is checked in test_oracle.py."""

import re

import pytest

from tidewise.plans.registry import QUERIES
from tidewise.sources import bindings as B

SF = "/root/testdata/sf0.001"


def _scans(df):
    """(columns read, pushed filters) of every parquet scan."""
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", 100_000)
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [(r, p) for p, r in re.findall(r"PushedFilters: \[(.*?)\], ReadSchema: struct<(.*?)>", plan)]


def test_only_needed_columns_are_read(spark):
    scans = _scans(QUERIES["q05_foreign_motive_share"](spark, SF))
    assert scans and all("l_quantity" not in r and "l_tax" not in r for r, _ in scans)


DATED = [k for k in sorted(QUERIES) if re.match(r"q(0[1-9]|1[01])_", k) and k != "q05_published"] + [
    "p5_kpis", "m_total_year", "p2_table", "m_growth"]


@pytest.mark.parametrize("key", DATED)
def test_year_bounds_reach_the_scans(spark, key):
    scans = _scans(QUERIES[key](spark, SF))
    dated = [(r, p) for r, p in scans if "l_shipdate" in r or "o_orderdate" in r]
    assert dated
    for _, pushed in dated:
        assert re.search(r"GreaterThanOrEqual\((l_shipdate|o_orderdate)", pushed), pushed
        assert re.search(r"LessThan\((l_shipdate|o_orderdate)", pushed), pushed


@pytest.mark.parametrize("key", ["m_domestic_total", "pivot_by_year"])
def test_trips_do_not_read_lines(spark, key):
    assert not any("l_orderkey" in r for r, _ in _scans(QUERIES[key](spark, SF)))


def test_one_scan_per_fact(spark):
    """Demand and capacity each read the lines once, also for two groups of types."""
    assert sum("l_shipdate" in r for r, _ in _scans(QUERIES["m_travellers"](spark, SF))) == 1
    beds_and_nights = [r for r, _ in _scans(QUERIES["p5_kpis"](spark, SF)) if "l_partkey" in r]
    assert len(beds_and_nights) == 2


#: Scans of lineitem, and of all tables, of the page datasets.
PAGES = {"p1_kpis": (1, 6), "p3_growth_scatter": (1, 6), "p3_growth_scatter_foreign": (1, 6), "p5_rural_occupancy": (3, 16), "p5_camping_occupancy": (3, 16),
         "p5_kpis": (3, 16), "p1_quarter_heatmap_totals": (1, 6)}


@pytest.mark.parametrize("key", sorted(PAGES))
def test_pages_share_their_passes(spark, key):
    scans = _scans(QUERIES[key](spark, SF))
    lines, tables = PAGES[key]
    assert sum(re.search(r"\bl_", r) is not None for r, _ in scans) <= lines and len(scans) <= tables, [r for r, _ in scans]


@pytest.mark.parametrize("key", ["load_audit", "table_row_counts", "constraint_violations"])
def test_jobs_over_all_facts_share_the_lines(spark, key):
    """Only capacity and demand read the lines for themselves; the other four facts read cells of two passes."""
    df = QUERIES[key](spark, SF)
    assert sum("l_suppkey" in r or "l_orderkey" in r for r, _ in _scans(df)) == 2 and B._CELLS == {}


def test_shared_cells_give_the_same_facts(spark):
    for name, fact in B.FACTS.items():
        alone = fact(spark, SF)
        with B.shared_cells(spark, SF):
            shared, cut = fact(spark, SF), fact(spark, SF, years=[(1998, 1998)])
        assert shared.exceptAll(alone).count() == alone.exceptAll(shared).count() == 0, name
        assert cut.count() < alone.count()


def test_lines_meet_orders_in_tasks_by_rows(spark, monkeypatch):
    """Many lines: the tasks that join them with orders and count distinct orders follow their number, in one shuffle of the lines."""
    plain = B.fx_demand_m(spark, SF)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    monkeypatch.setattr(B, "TASK_LINES", 100, raising=False)
    many = B.fx_demand_m(spark, SF)
    shuffles = re.findall(r"Exchange hashpartitioning\((l_\w+)#\d+L, (\d+)\)", many._jdf.queryExecution().executedPlan().toString())
    assert shuffles == [("l_orderkey", str(-(-lines // 100)))]
    assert many.exceptAll(plain).count() == plain.exceptAll(many).count() == 0


def test_lines_meet_parts_in_tasks_by_rows(spark, monkeypatch):
    """Many lines: the tasks that join them with parts and count distinct parts follow their number, in one shuffle of the lines."""
    plain = B.fx_capacity_m(spark, SF)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    monkeypatch.setattr(B, "TASK_LINES", 100)
    many = B.fx_capacity_m(spark, SF)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Exchange hashpartitioning\(([^\n]*l_partkey#\d+L), (\d+)\)", plan) == [
        (re.search(r"l_partkey#\d+L", plan)[0], str(-(-lines // 100)))]
    assert many.exceptAll(plain).count() == plain.exceptAll(many).count() == 0


def test_shared_cells_meet_orders_in_tasks_by_rows(spark, monkeypatch):
    """Many lines: the pass over the lines by order is dealt out by their number, in one shuffle, and its cells stay the same."""
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    cells = []
    for rows in (B.TASK_LINES, 100):
        monkeypatch.setattr(B, "TASK_LINES", rows)
        dealt = []
        by_key = B._by_key
        with monkeypatch.context() as m:
            m.setattr(B, "_by_key", lambda df, key, tasks: dealt.append((key, tasks)) or by_key(df, key, tasks))
            with B.shared_cells(spark, SF):
                cells.append(B._CELLS[SF]["order"])
        many = -(-lines // rows) if rows == 100 else 1
        assert dealt == [("l_orderkey", many), ("o_orderkey", many)]
    plain, many = cells
    assert many.exceptAll(plain).count() == plain.exceptAll(many).count() == 0


def test_stay_adds_lines_up_once(spark):
    """The lines of the years' orders are not grouped by order first."""
    plan = QUERIES["q08_stay_compare"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"HashAggregate\(keys=\[l_orderkey", plan)


def test_published_year_prunes_partitions(spark):
    plan = QUERIES["q05_published"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*anio", plan)
