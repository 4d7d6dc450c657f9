"""Binding of the driver's star-schema tables to the six clean facts.

The statistical extracts themselves are not available, so each fact is derived
from the order/lineitem tables with the same grain and vocabulary (see
FIXTURES.md section 3). Every binding is a lazy DataFrame over all rows of its tables;
``years``, a list of (first, last) ranges, compares the raw date column, so that the
bounds reach the scan.

Year mapping used by the registered queries: the extracts' 2016, 2019 and 2024
become 1995, 1997 and 2000 (see ``PARAMS``).
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewise import vocab as V
from tidewise.functions.ratios import round_div_decimal
from tidewise.schemas import MONEY
from tidewise.session import scratch_path
from tidewise.sources.tables import in_years, region_dim, table

# Parameters of the registered queries on the bound tables.
PARAMS = {
    "first_year": 1995, "pre_year": 1997, "last_year": 2000, "base_year": 1997,
    "cv_years": (1997, 2000), "share_years": (1998, 2000), "evo_years": (1995, 2000),
    "focus": ("NATION_2", "NATION_3", "NATION_5", "NATION_7", "NATION_11",
              "NATION_13", "NATION_17", "NATION_19", "NATION_23"),
}

PRIORITY_MOTIVE = (("1-URGENT", V.LEISURE), ("2-HIGH", V.BUSINESS), ("3-MEDIUM", V.FAMILY),
                   ("4-NOT SPECIFIED", "Motivo no especificado"), ("5-LOW", V.OTHER))
STATUS_LEISURE_SUB = (("F", "Turismo de sol y playa"), ("O", "Turismo cultural"),
                      ("P", "Turismo de naturaleza"))
FLAG_FOREIGN_MOTIVE = (("A", V.FOREIGN_MOTIVES[0]), ("N", V.FOREIGN_MOTIVES[1]),
                       ("R", V.FOREIGN_MOTIVES[2]))
PTYPE_LEVEL2 = (("ECONOMY", "Hotelero"), ("STANDARD", "Vivienda en alquiler"),
                ("PROMO", "Camping"), ("SMALL", "Vivienda en propiedad"),
                ("MEDIUM", "Vivienda de familiares o amigos"), ("LARGE", "Resto de no mercado"))
MARKET_PTYPES = ("ECONOMY", "STANDARD", "PROMO")
PTYPE_ACCOMMODATION = (("ECONOMY", "Hotelero"), ("STANDARD", "Apartamento turístico"),
                       ("PROMO", "Camping"), ("SMALL", "Turismo rural"), ("MEDIUM", "Albergue"))
DURATION = V.DOMESTIC_METRICS[2]


def _map(c, pairs):
    out = None
    for k, v in pairs:
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out


#: Lines that one task joins with their orders (or parts) and counts distinct ones of: the number of tasks follows the lines.
TASK_LINES = 500_000


def _line_tasks(spark, sf_dir) -> int:
    """Tasks for the lines of the folder when they meet their orders or parts; 1 if a task a core is enough, as Spark plans it.

    Shuffled partitions are filled by compressed bytes, and how many rows those hold depends on the data; a
    task's sort and its distinct counts need memory by rows. The number of lines is read from the files' footers.
    """
    n = -(-table(spark, sf_dir, "lineitem").count() // TASK_LINES)
    return n if n > spark.sparkContext.defaultParallelism else 1


def _by_key(df: DataFrame, key: str, tasks: int) -> DataFrame:
    return df.repartition(tasks, key) if tasks > 1 else df


#: Cells that the facts of one folder share while :func:`shared_cells` is active, by folder.
_CELLS: dict[str, dict[str, DataFrame]] = {}


@contextmanager
def shared_cells(spark: SparkSession, sf_dir: str):
    """Facts that are built inside share their passes over the lines, for jobs that read all of them.

    Lines by supplier (visitors and spend) and lines by order (stays and lodging) are each added up once, to cells by
    region, period and category, which are written to the shared folder. A cell table is as small as a fact.
    Many lines meet their orders in tasks of at most about ``TASK_LINES`` lines.
    """
    money = {c: F.sum(F.col(f"l_{c}").cast(MONEY)).alias(c) for c in ("quantity", "extendedprice")}
    by_supplier = _lines_by_supplier(spark, sf_dir, None, "l_returnflag", "l_quantity", "l_extendedprice").groupBy(
        F.col("s_nationkey").cast("int").alias("id_ccaa"), "l_returnflag", F.trunc(F.to_date("l_shipdate"), "month").alias("fecha")).agg(
        F.count("*").alias("n"), *money.values())
    p = table(spark, sf_dir, "part", "p_partkey", "p_type")
    tasks = _line_tasks(spark, sf_dir)
    li = _by_key(table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_quantity"), "l_orderkey", tasks)
    o = _by_key(_orders_by_region(spark, sf_dir, None, "o_orderkey").select("o_orderkey", "o_orderdate", "c_nationkey"), "o_orderkey", tasks)
    by_order = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey, "left").groupBy(
        F.col("c_nationkey").cast("int").alias("id_ccaa"), F.trunc(F.to_date("o_orderdate"), "quarter").alias("fecha"), "p_type",
        F.col("p_partkey").isNotNull().alias("has_part")).agg(F.count("*").alias("n"), money["quantity"])
    cells = {}
    for name, df in (("supplier", by_supplier), ("order", by_order)):
        path = scratch_path(spark, f"cells-{name}")
        df.write.parquet(path)
        cells[name] = spark.read.parquet(path)
    _CELLS[sf_dir] = cells
    try:
        yield
    finally:
        del _CELLS[sf_dir]


def _shared(sf_dir, name, years) -> DataFrame | None:
    return _CELLS[sf_dir][name] if sf_dir in _CELLS and years is None else None


def _with_region(spark, sf_dir, df):
    return df.join(region_dim(spark, sf_dir), "id_ccaa")


def _orders_by_region(spark, sf_dir, years, *cols):
    """Orders with their customer's region, restricted to ``years`` in the scan."""
    o = in_years(table(spark, sf_dir, "orders", "o_custkey", "o_orderdate",
                       *[c for c in cols if c != "o_orderdate"]), "o_orderdate", years)
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    return o.join(c, o.o_custkey == c.c_custkey)


def fx_trips_q(spark: SparkSession, sf_dir: str, years=None, metrics=V.DOMESTIC_METRICS) -> DataFrame:
    """Quarterly domestic fact (metric long format): trips, total spend, mean stay.

    One branch per source: trips and spend come from the orders alone, the stay also reads
    their lines. A branch without a wanted metric is not built, and a later filter
    on ``metrica`` prunes the branch of the stay.
    """
    d = F.to_date("o_orderdate")
    keys = [F.col("c_nationkey").cast("int").alias("id_ccaa"), F.year(d).alias("anio"), F.quarter(d).alias("trimestre")]
    branches = []
    of_orders = {V.TRIPS: F.count("*").cast(MONEY),
                 V.SPEND_TOTAL: round_div_decimal(F.sum(F.col("o_totalprice").cast(MONEY)), F.lit(1000), 2)}
    of_orders = {m: c for m, c in of_orders.items() if m in metrics}
    if of_orders:
        agg = (_orders_by_region(spark, sf_dir, years, "o_totalprice").groupBy(*keys)
               .agg(*[c.alias(f"_{i}") for i, c in enumerate(of_orders.values())]))
        rows = F.inline(F.array(*[F.struct(F.lit(m).alias("metrica"), F.col(f"_{i}").alias("valor"))
                                  for i, m in enumerate(of_orders)]))
        branches.append(agg.select("id_ccaa", "anio", "trimestre", rows))
    if DURATION in metrics:
        shared = _shared(sf_dir, "order", years)
        # sums and counts add up: the orders of the years meet their lines, and one aggregation by quarter follows
        li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity")
        o = _orders_by_region(spark, sf_dir, years, "o_orderkey")
        if shared is not None:
            stay = shared.groupBy("id_ccaa", F.year("fecha").alias("anio"), F.quarter("fecha").alias("trimestre")).agg(
                F.sum("quantity").alias("qty"), F.sum("n").alias("nl"))
        else:
            stay = li.join(o, li.l_orderkey == o.o_orderkey).groupBy(*keys).agg(
                F.sum(F.col("l_quantity").cast(MONEY)).alias("qty"), F.count("*").alias("nl"))
        branches.append(stay.select("id_ccaa", "anio", "trimestre", F.lit(DURATION).alias("metrica"),
                                    round_div_decimal("qty", "nl", 2).alias("valor")))
    long = reduce(DataFrame.unionByName, branches)
    return (_with_region(spark, sf_dir, long)
            .select("id_ccaa", "destino", "metrica", "anio", "trimestre",
                    F.make_date("anio", (F.col("trimestre") - 1) * 3 + 1, F.lit(1)).alias("fecha"),
                    "valor")
            .where(F.col("valor").isNotNull()))


def _lines_by_supplier(spark, sf_dir, years, *cols):
    li = in_years(table(spark, sf_dir, "lineitem", "l_suppkey", "l_shipdate", *cols), "l_shipdate", years)
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    return li.join(s, li.l_suppkey == s.s_suppkey)


def fx_foreign_m(spark: SparkSession, sf_dir: str, years=None) -> DataFrame:
    """Monthly foreign visitors by motive."""
    motive = _map(F.col("l_returnflag"), FLAG_FOREIGN_MOTIVE).alias("motivo")
    shared = _shared(sf_dir, "supplier", years)
    if shared is not None:
        agg = shared.groupBy("id_ccaa", motive, "fecha").agg(F.sum("n").alias("turistas"))
    else:
        j = _lines_by_supplier(spark, sf_dir, years, "l_returnflag")
        agg = (j.groupBy(F.col("s_nationkey").cast("int").alias("id_ccaa"), motive,
                         F.trunc(F.to_date("l_shipdate"), "month").alias("fecha"))
               .agg(F.count("*").alias("turistas")))
    return _with_region(spark, sf_dir, agg).select("id_ccaa", "destino", "motivo", "fecha", "turistas")


def fx_spend_y(spark: SparkSession, sf_dir: str, years=None) -> DataFrame:
    """Annual foreign spend per person and mean stay (metric long format)."""
    shared = _shared(sf_dir, "supplier", years)
    if shared is not None:
        agg = shared.groupBy("id_ccaa", F.year("fecha").alias("anio")).agg(
            F.sum("n").alias("n"), F.sum("extendedprice").alias("amount"), F.sum("quantity").alias("qty"))
    else:
        j = _lines_by_supplier(spark, sf_dir, years, "l_quantity", "l_extendedprice")
        agg = (j.groupBy(F.col("s_nationkey").cast("int").alias("id_ccaa"),
                         F.year(F.to_date("l_shipdate")).alias("anio"))
               .agg(F.count("*").alias("n"),
                    F.sum(F.col("l_extendedprice").cast(MONEY)).alias("amount"),
                    F.sum(F.col("l_quantity").cast(MONEY)).alias("qty")))
    rows = F.array(
        F.struct(F.lit(V.SPEND_PER_PERSON).alias("metrica"),
                 round_div_decimal("amount", "n", 2).alias("valor")),
        F.struct(F.lit(DURATION).alias("metrica"), round_div_decimal("qty", "n", 2).alias("valor")))
    long = agg.select("id_ccaa", "anio", F.inline(rows))
    return (_with_region(spark, sf_dir, long)
            .select("id_ccaa", "destino", "metrica", "anio", "valor")
            .where(F.col("valor").isNotNull()))


def fx_residents_y(spark: SparkSession, sf_dir: str, years=None) -> DataFrame:
    """Annual domestic trips: motive rows (level 1 'Total') fused with lodging rows."""
    oc = _orders_by_region(spark, sf_dir, years, "o_orderpriority", "o_orderstatus")
    idc = F.col("c_nationkey").cast("int").alias("id_ccaa")
    anio = F.year(F.to_date("o_orderdate")).alias("anio")
    sub = F.when(F.col("o_orderpriority") == "1-URGENT",
                 _map(F.col("o_orderstatus"), STATUS_LEISURE_SUB))
    motives = (oc.select(idc, anio, F.explode(F.array(
                   F.lit(V.TOTAL), _map(F.col("o_orderpriority"), PRIORITY_MOTIVE), sub)).alias("motivo"))
               .where(F.col("motivo").isNotNull())
               .groupBy("id_ccaa", "anio", "motivo").agg(F.count("*").alias("viajes"))
               .select("id_ccaa", "motivo", F.lit(V.TOTAL).alias("alojamiento_nivel1"),
                       F.lit(None).cast("string").alias("alojamiento_nivel2"), "anio", "viajes"))
    lodging = _lodging_lines(spark, sf_dir, years=years)
    fused = motives.unionByName(lodging.where(F.col("alojamiento_nivel1") != V.TOTAL))
    return _with_region(spark, sf_dir, fused).select(
        "id_ccaa", "destino", "motivo", "alojamiento_nivel1", "alojamiento_nivel2", "anio", "viajes")


def _lodging_lines(spark, sf_dir, with_total: bool = False, years=None) -> DataFrame:
    """Lodging marginal: level-2 rows, level-1 subtotals (level 2 NULL), optional grand total."""
    shared = _shared(sf_dir, "order", years)
    if shared is not None:
        j = shared.where("has_part").select("id_ccaa", F.year("fecha").alias("anio"), "p_type", "n")
    else:
        li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey")
        oc = _orders_by_region(spark, sf_dir, years, "o_orderkey")
        p = table(spark, sf_dir, "part", "p_partkey", "p_type")
        j = li.join(oc, li.l_orderkey == oc.o_orderkey).join(p, li.l_partkey == p.p_partkey).select(
            F.col("c_nationkey").cast("int").alias("id_ccaa"), F.year(F.to_date("o_orderdate")).alias("anio"), "p_type")
    l1 = F.when(F.col("p_type").isin(*MARKET_PTYPES), F.lit(V.MARKET)).otherwise(F.lit(V.NON_MARKET))
    l2 = _map(F.col("p_type"), PTYPE_LEVEL2)
    cells = [F.struct(l1.alias("l1"), l2.alias("l2")),
             F.struct(l1.alias("l1"), F.lit(None).cast("string").alias("l2"))]
    if with_total:
        cells.append(F.struct(F.lit(V.TOTAL).alias("l1"), F.lit(None).cast("string").alias("l2")))
    many = ["n"] if shared is not None else []
    return (j.select("id_ccaa", "anio", *many, F.inline(F.array(*cells)))
            .groupBy("id_ccaa", "anio", "l1", "l2").agg((F.sum("n") if many else F.count("*")).alias("viajes"))
            .select("id_ccaa", F.lit(V.TOTAL).alias("motivo"), F.col("l1").alias("alojamiento_nivel1"),
                    F.col("l2").alias("alojamiento_nivel2"), "anio", "viajes"))


def _lines_full(spark, sf_dir, years, *cols, tasks: int = 1):
    """Lines with their supplier and part; with several ``tasks`` they meet their parts in so many, by part."""
    li = in_years(table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_partkey", "l_shipdate", *cols),
                  "l_shipdate", years)
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    p = table(spark, sf_dir, "part", "p_partkey", "p_type")
    j = _by_key(li.join(s, li.l_suppkey == s.s_suppkey), "l_partkey", tasks)
    return j.join(p, j.l_partkey == p.p_partkey)


def fx_capacity_m(spark: SparkSession, sf_dir: str, years=None) -> DataFrame:
    """Monthly bed capacity by accommodation type (distinct parts shipped).

    Many lines meet their parts in tasks of at most about ``TASK_LINES`` lines, and a cell's distinct parts are
    counted in those same tasks.
    """
    j = _lines_full(spark, sf_dir, years, tasks=_line_tasks(spark, sf_dir))
    agg = (j.groupBy(F.col("s_nationkey").cast("int").alias("id_ccaa"),
                     _map(F.col("p_type"), PTYPE_ACCOMMODATION).alias("tipo_alojamiento"),
                     F.trunc(F.to_date("l_shipdate"), "month").alias("fecha"))
           .agg(F.count_distinct("l_partkey").alias("plazas")))
    return _with_region(spark, sf_dir, agg).select(
        "id_ccaa", "destino", "tipo_alojamiento", "fecha", "plazas")


def fx_demand_m(spark: SparkSession, sf_dir: str, years=None, metrics=(V.TRAVELLERS, V.NIGHTS)) -> DataFrame:
    """Monthly travellers and nights by type and residence, plus total rows (residence NULL).

    An order has one customer, so inside a region it has one residence: distinct orders of the
    two residences add up, and only the cells (not the lines) are doubled for the totals.
    Without ``Viajeros`` among the metrics no orders are counted.

    Orders meet their customers first, so lines are shuffled once for them, by order, into tasks of at most
    about ``TASK_LINES`` lines; a cell's distinct orders are counted in those same tasks.
    """
    tasks = _line_tasks(spark, sf_dir)
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    o = _by_key(o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_nationkey"), "o_orderkey", tasks)
    j = _by_key(_lines_full(spark, sf_dir, years, "l_quantity").select(
        "l_orderkey", "s_nationkey", "p_type", "l_shipdate", "l_quantity"), "l_orderkey", tasks)
    j = j.join(o, j.l_orderkey == o.o_orderkey)
    res = F.when(F.col("c_nationkey") == F.col("s_nationkey"), F.lit(V.NATIONAL)).otherwise(F.lit(V.FOREIGN))
    measures = {V.TRAVELLERS: F.count_distinct("l_orderkey"), V.NIGHTS: F.sum(F.col("l_quantity").cast(MONEY))}
    measures = {m: c for m, c in measures.items() if m in metrics}
    parts = (j.groupBy(F.col("s_nationkey").cast("int").alias("id_ccaa"),
                       _map(F.col("p_type"), PTYPE_ACCOMMODATION).alias("tipo_alojamiento"),
                       F.trunc(F.to_date("l_shipdate"), "month").alias("fecha"), res.alias("_res"))
             .agg(*[c.alias(m) for m, c in measures.items()]))
    cells = parts.withColumn("residencia", F.explode(F.array("_res", F.lit(None).cast("string"))))
    agg = (cells.groupBy("id_ccaa", "tipo_alojamiento", "residencia", "fecha")
           .agg(*[F.sum(m).cast("bigint").alias(m) for m in measures]))
    long = agg.select("id_ccaa", "tipo_alojamiento", "residencia", "fecha", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metrica"), F.col(m).alias("valor")) for m in measures])))
    return _with_region(spark, sf_dir, long).select(
        "id_ccaa", "destino", "tipo_alojamiento", "residencia", "metrica", "fecha", "valor")


FACTS = {
    "quarterly_spend": fx_trips_q,
    "foreign_motives": fx_foreign_m,
    "foreign_spend": fx_spend_y,
    "residents": fx_residents_y,
    "capacity": fx_capacity_m,
    "demand": fx_demand_m,
}
