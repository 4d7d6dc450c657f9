"""Corpus pipeline: quality rules, line dedup, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewise.llm.common import read, saved
from tidewise.llm.decontaminate import decontaminate
from tidewise.llm.line_dedup import line_dedup
from tidewise.llm.packing import pack, tokenizer_path
from tidewise.llm.quality_rules import quality_rules
from tidewise.llm.simhash import one_of_each_group

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs, carry=tuple(COLUMNS)).filter("kept").select(COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand on many sites; ``n_chars`` follows the text."""
    out = line_dedup(docs)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(COLUMNS)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: 3-word shingles, 3 bits."""
    return one_of_each_group(docs, shingle=3, max_bits=3).select(COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no contaminating share of benchmark windows."""
    out = decontaminate(docs, read(spark, sf_dir, "benchmark"), carry=tuple(COLUMNS))
    return out.filter(~F.col("contaminated")).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return pack(docs, tokenizer_path(), with_ids=False)


STAGES = [("quality_rules", quality_stage), ("line_dedup", line_stage), ("simhash_neardup", neardup_stage),
          ("decontamination", decontamination_stage), ("packing", packing_stage)]

#: The suffix-array, SimHash and tokenizer stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
