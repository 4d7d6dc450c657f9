"""Incremental load of newly arriving extracts (the append INSERT of a batch load).

A file-source stream over a landing folder: each new extract file is parsed by the
same ETL transform, suppressed cells are dropped, rejects (malformed lines among them) are kept apart, and the
clean rows go to the fact table, partitioned by batch and year. Progress lives in a
checkpoint under the shared ``spark.checkpoint.dir``. A batch that failed after its write is
replayed over its own partitions, so no row is loaded twice.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewise.schemas import FACT_VALUE, STAGING_ENCODING, STAGING_WIDTH, staging_schema
from tidewise.session import checkpoint_root
from tidewise.sources.staging import MALFORMED


def _write_lot(df: DataFrame, batch_id: int, path: str, *partitions: str) -> None:
    """Write one batch to its own partitions; a replay of the batch replaces them."""
    (df.withColumn("lote", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("lote", *partitions).parquet(path))


def start_extract_stream(spark: SparkSession, name: str, landing: str, fact_path: str,
                         rejects_path: str, parse, fact: str, available_now: bool = True):
    """Start (and return) the streaming query loading extract ``name`` from ``landing``."""
    stream = (spark.readStream.schema(staging_schema(STAGING_WIDTH[name]).add(MALFORMED, "string")).option("sep", ";")
              .option("header", True).option("encoding", STAGING_ENCODING[name])
              .option("columnNameOfCorruptRecord", MALFORMED).option("columnPruning", False).csv(landing))

    def load_batch(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            parsed = parse(batch)
            out = parsed.clean.where(F.col(FACT_VALUE[fact]).isNotNull())
            if "anio" not in out.columns:
                out = out.withColumn("anio", F.year("fecha"))
            _write_lot(out, batch_id, fact_path, "anio")
            _write_lot(parsed.rejects, batch_id, rejects_path)
        finally:
            batch.unpersist()

    # one checkpoint per (extract, target table): a restart resumes exactly this load
    target = hashlib.sha1(f"{landing}->{fact_path}".encode()).hexdigest()[:12]
    w = (stream.writeStream.foreachBatch(load_batch)
         .option("checkpointLocation", os.path.join(checkpoint_root(spark), f"stream-{name}-{target}")))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
