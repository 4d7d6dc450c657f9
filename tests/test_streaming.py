import os
import tempfile

import pytest

from tidewise.plans import etl as E
from tidewise.sources import staging as S
from tidewise.streaming.ingest import start_extract_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture
def landing(spark):
    root = tempfile.mkdtemp(prefix="tidewise-stream-")
    stg = S.foreign_spend(spark, SF)
    S.write_staging(stg, os.path.join(root, "landing"), "ISO-8859-1")
    return root, stg


def start(spark, root, parse=E.parse_foreign_spend):
    return start_extract_stream(spark, "foreign_spend", *(os.path.join(root, x) for x in ("landing", "fact", "rejects")),
                                parse, "foreign_spend")


def check(spark, root, stg):
    batch = E.load(E.parse_foreign_spend(stg), "foreign_spend")
    loaded = spark.read.parquet(os.path.join(root, "fact")).select(*batch.columns)
    assert loaded.count() == batch.count()
    assert loaded.exceptAll(batch).count() == 0
    assert spark.read.parquet(os.path.join(root, "rejects")).count() == E.parse_foreign_spend(stg).rejects.count()


def test_incremental_load_matches_batch(spark, landing):
    root, stg = landing
    start(spark, root).awaitTermination(120)
    check(spark, root, stg)


def test_replayed_batch_is_loaded_once(spark, landing):
    """The first attempt fails after the clean rows are written; the restart replays the batch."""
    root, stg = landing

    def broken(batch):
        parsed = E.parse_foreign_spend(batch)
        return parsed._replace(rejects=parsed.rejects.selectExpr("*", "raise_error('disk full') AS boom"))

    with pytest.raises(Exception, match="disk full"):
        start(spark, root, broken).awaitTermination(120)
    assert spark.read.parquet(os.path.join(root, "fact")).count() > 0
    start(spark, root).awaitTermination(120)
    check(spark, root, stg)
