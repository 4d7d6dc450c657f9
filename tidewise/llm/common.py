"""Helpers shared by the training-data operators.

Conventions of every operator in this package:

* Only the named input columns are read. Other input columns never reach the
  computation, so an extra column whose name equals an output column cannot clash;
  with ``carry`` they are passed through, and an output column wins over a carried one.
* A null text has no words; an empty table gives an empty result.
* Work tables go to the shared folder that ``spark.checkpoint.dir`` names.
"""

from __future__ import annotations

import ctypes
import re
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewise.session import scratch_path

#: Text bytes that one vectorised step takes at once (one row may exceed it).
SLICE_BYTES = 4 << 20

#: A key with at least 1/HOT_SHARE of all rows is hot; so there are at most HOT_SHARE of them.
HOT_SHARE = 1000


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage durably."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000):
    """Arrow batches of at most ``rows`` rows for what is executed inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Return freed memory to the system, so that a worker's size is that of its live data."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)


def slices(text: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo, n = 0, len(text)
    while lo < n:
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield lo, hi
        lo = hi


def map_text(docs: DataFrame, text: str, carry: list[str], fields: list[T.StructField],
             fn: Callable[[pa.Array], list[pa.Array]], limit: int = SLICE_BYTES) -> DataFrame:
    """One output row per input row: ``carry`` columns and what ``fn`` makes of the texts.

    ``fn`` gets a slice of the text column (nulls included) and returns one array per
    field. Memory is bounded by the slice, or by one text that is longer than it.
    """
    new = {f.name for f in fields}
    carry = [c for c in carry if c not in new]
    df = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([docs.schema[c] for c in carry] + fields)
    k, names = len(carry), schema.names

    def run(batches):
        for b in batches:
            for lo, hi in slices(b.column(k), limit):
                part = b.slice(lo, hi - lo)
                out = fn(part.column(k))
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(k)] + list(out), names=names)

    return df.mapInArrow(run, schema)


def flat(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (null: empty) and the n + 1 offsets of the texts in them."""
    text = pc.fill_null(text, "")
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    wide = pa.types.is_large_string(text.type)
    off = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32)[text.offset:text.offset + len(text) + 1]
    off = off.astype(np.int64) if len(text) else np.zeros(1, np.int64)
    body = text.buffers()[2] if len(text) else None
    data = np.frombuffer(body, np.uint8)[off[0]:off[-1]] if body is not None and body.size else np.zeros(0, np.uint8)
    return data, off - off[0]


def whitespace_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space: document of each word, its code, the dictionary."""
    parts = pc.ascii_split_whitespace(pc.fill_null(text, ""))
    off = parts.offsets.to_numpy().astype(np.int64)
    enc = parts.values.slice(off[0], off[-1] - off[0]).dictionary_encode() if len(parts) else pa.array([], pa.string()).dictionary_encode()
    code = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(parts)), np.diff(off)) if len(parts) else np.zeros(0, np.int64)
    words = enc.dictionary
    full = (pc.binary_length(words).to_numpy(zero_copy_only=False) > 0)[code] if len(code) else np.zeros(0, bool)
    return doc[full], code[full], words


def per_doc(doc: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Counts, or sums of weights, by document."""
    return np.bincount(doc, weights=weights, minlength=n)[:n]


def lines_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Lines between newlines: document of each line, its code, the dictionary of lines."""
    parts = pc.split_pattern(pc.fill_null(text, ""), "\n")
    off = parts.offsets.to_numpy().astype(np.int64)
    enc = parts.values.slice(off[0], off[-1] - off[0]).dictionary_encode()
    return np.repeat(np.arange(len(parts)), np.diff(off)), enc.indices.to_numpy(zero_copy_only=False).astype(np.int64), enc.dictionary


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 3, is 1; a null id is held out, so never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def look_up(rows: DataFrame, key: str, small: DataFrame, weight: str, name: str) -> DataFrame:
    """Left join of ``rows`` with ``small`` (one row a key, ``weight`` rows of ``rows`` have it).

    Keys that hold at least 1/HOT_SHARE of all rows are at most HOT_SHARE in number: that is
    the proven size of the broadcast. All other keys go through a shuffle join, in
    which no key then holds more than that share.
    """
    total = small.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("__n")).first()["__n"]
    least = max(total // HOT_SHARE + 1, 2)
    # at most HOT_SHARE rows by the line above
    hot = small.filter(F.col(weight) >= least)
    is_hot = rows.join(F.broadcast(hot.select(F.col(key))), key, "left_semi").join(F.broadcast(hot), key)
    rest = (rows.join(F.broadcast(hot.select(F.col(key))), key, "left_anti")
            .join(small.filter(F.col(weight) < least), key, "left"))
    return is_hot.unionByName(rest)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the given folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_table(pattern: str) -> np.ndarray:
    """256 flags: single-byte characters that the class matches; bytes of 128 and over are off."""
    own = re.compile(pattern)
    return np.array([i < 128 and bool(own.match(chr(i))) for i in range(256)])
