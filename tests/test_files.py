"""Extract files, published facts and the shared folder."""

import glob
import os
import tempfile
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidewise.plans import etl as E
from tidewise.plans.registry_etl import FACT_OF, PARSERS
from tidewise.schemas import FACT_SCHEMAS, STAGING_ENCODING, STAGING_WIDTH
from tidewise.session import checkpoint_root
from tidewise.sources import sinks
from tidewise.sources import staging as S

SF = "/root/testdata/sf0.001"


def test_utf8_extract_with_byte_order_mark_keeps_accents(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="tidewise-bom-"), "capacity")
    S.write_staging(S.capacity(spark, SF), path, "UTF-8")
    first = [open(f, "rb").read(3) for f in glob.glob(f"{path}/part-*") if os.path.getsize(f)]
    assert first and set(first) == {b"\xef\xbb\xbf"}
    back = S.read_staging(spark, path, STAGING_WIDTH["capacity"], "UTF-8")
    names = {r.col1 for r in back.select("col1").distinct().collect()}
    assert "Encuesta de Ocupación en Apartamentos Turísticos" in names and not any("\ufeff" in n for n in names)
    assert back.count() == S.capacity(spark, SF).count()


def test_wrong_encoding_shows(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="tidewise-enc-"), "spend")
    S.write_staging(S.quarterly_spend(spark, SF), path, "ISO-8859-1")
    right = S.read_staging(spark, path, 5, "ISO-8859-1").where(F.col("col2").contains("Duración")).count()
    wrong = S.read_staging(spark, path, 5, "UTF-8").where(F.col("col2").contains("Duración")).count()
    assert right > 0 and wrong == 0


@pytest.mark.parametrize("name", ["demand", "quarterly_spend"])
def test_file_load_is_the_direct_parse(spark, name):
    root = tempfile.mkdtemp(prefix="tidewise-load-")
    staged = S.EXTRACTS[name](spark, SF)
    S.write_staging(staged, f"{root}/stg", STAGING_ENCODING[name])
    fact = FACT_OF[name]
    loaded = E.load_file(spark, f"{root}/stg", name, fact, PARSERS[name], f"{root}/fact")
    direct = E.load(PARSERS[name](staged), fact)
    assert [f.dataType for f in loaded.schema] == [f.dataType for f in FACT_SCHEMAS[fact]]
    assert loaded.exceptAll(direct).count() == 0 and direct.exceptAll(loaded).count() == 0
    twice = E.load_file(spark, f"{root}/stg", name, fact, PARSERS[name], f"{root}/fact")
    assert twice.count() == 2 * direct.count()  # a load appends


def test_published_years(spark):
    root = tempfile.mkdtemp(prefix="tidewise-fact-")
    df = spark.createDataFrame([(1, "a", "m", "2000-01-01", 3), (1, "a", "m", "1999-01-01", 4)],
                               "id_ccaa int, destino string, motivo string, fecha string, turistas long")
    sinks.write_clean(sinks.conform(df, FACT_SCHEMAS["foreign_motives"]), f"{root}/f")
    assert sinks.read_clean(spark, f"{root}/f", FACT_SCHEMAS["foreign_motives"], (2000, 2000)).collect()[0].turistas == 3


def test_cluster_without_shared_folder_is_an_error():
    unset = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)))
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=context)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(session)
