"""Target-distribution importance resampling over hashed n-grams.

Overlapped regex scanning: separators collapse to single spaces, then ``finditer(overlapped=True)`` matches
up to three words from each word start on. Lookarounds tie both ends of a match to word boundaries, so its groups
are the spans of the n-grams that start there, and the CRC-32 of a span gives the bucket. Bucket totals of the
documents and of the target texts give a gain for each bucket; a document's weight is the sum of its gains, and
Gumbel noise on the weights draws without replacement.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain
from operator import methodcaller
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewise.llm.common import map_text, read, saved

BUCKETS = 10_000
SEED = 42
MIN_WORDS = 20
#: Share of the eligible documents that is drawn, as a fraction.
SHARE = (5, 100)

#: Bytes to word bytes (A-Z lowered; digits, a-z and all bytes of other scripts) or to a space.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Up to three words from each word start on; the groups are the spans of its 3-, 2- and 1-gram.
_GRAMS = regex.compile(rb"(?<![^ ])((([^ ]++)(?: [^ ]++)?)(?: [^ ]++)?)(?![^ ])")
_grams_at = methodcaller("group", 3, 2, 1)


def ngram_buckets(text: str | None, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words and the sorted buckets of all 1- to 3-grams of a text, repeats included."""
    words = (text or "").encode("utf-8").translate(_TO_WORDS).split()
    matches = _GRAMS.finditer(b" ".join(words), overlapped=True, concurrent=False)
    found = np.fromiter(map(crc32, chain.from_iterable(map(_grams_at, matches))), np.uint32).reshape(-1, 3)
    # at the last word all three spans are the word itself, at the one before it two are the 2-gram
    found = np.concatenate([found[:, 0], found[:-1, 1], found[:-2, 2]])
    return len(words), np.sort(found % np.uint32(buckets))


def _pack(sorted_buckets: np.ndarray) -> bytes:
    """Steps between sorted buckets as 16-bit numbers, low bytes before the (mostly zero) high bytes."""
    return np.diff(sorted_buckets, prepend=np.uint32(0)).astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(2, -1).astype(np.int64)
    return np.cumsum(planes[0] + (planes[1] << 8))


def _features(text: pa.Array, buckets: int) -> list[pa.Array]:
    n_words, blobs = [], []
    for s in text:
        n, found = ngram_buckets(s.as_py(), buckets)
        n_words.append(n)
        blobs.append(_pack(found))
    return [pa.array(n_words, pa.int64()), pa.array(blobs, pa.binary())]


def features(docs: DataFrame, text: str, carry: list[str], buckets: int) -> DataFrame:
    """``carry`` columns, ``n_words`` and the packed buckets of each text; one text is held whole in memory."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must be at most 65536")
    fields = [T.StructField("n_words", T.LongType()), T.StructField("grams", T.BinaryType())]
    return map_text(docs, text, carry, fields, lambda t: _features(t, buckets))


def bucket_totals(packed: DataFrame, buckets: int) -> np.ndarray:
    """Features of all texts by bucket: a task sums its own, so each sends at most ``buckets`` rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for blob in b.column(0):
                total += np.bincount(_unpack(blob.as_py()), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    rows = packed.select("grams").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)  # one row a bucket: bounded by the parameter
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln ratio) by bucket of the smoothed target and corpus shares."""
    k, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(((t + 1) * (s_all + k)) / ((s + 1) * (t_all + k))))
                     for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(doc_id: object, seed: int) -> int:
    """Noise of a document in thousandths; a null id counts as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _ranked(rows: DataFrame, last: int) -> DataFrame:
    """``rank`` 1, 2, ... by falling score (ties: smaller doc_id) up to ``last``, null beyond it.

    The rows are sorted by range; a row's rank is the number of rows in earlier ranges and its
    place in its own, so no task holds more than a range.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("weight"), F.asc("n_features")]
    ranged = saved(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = sorted((r["range"], r["n"]) for r in ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect())
    before, seen = [], 0  # one row a shuffle partition
    for i, n in sizes:
        before.append((i, seen))
        seen += n
    starts = F.broadcast(rows.sparkSession.createDataFrame(before, "range int, before long"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return ranged.join(starts, "range").withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= last, F.col("rank")))


def importance_resampling(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
                          share: tuple[int, int] = SHARE, min_words: int = MIN_WORDS, seed: int = SEED,
                          buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, n_words) for each row of ``docs``.

    Drawn are the ``share[0] * N // share[1]`` highest scores of the N rows with at least ``min_words``
    words; the others have a null rank. Null and empty texts have no features and weight 0. A row
    is drawn by itself, repeated rows too: they have equal scores and take neighbouring ranks. A null
    doc_id has the noise of an empty id and comes last among equal scores. An empty target has no features, an empty
    table gives an empty result. Other columns are not read, so their names cannot clash.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    packed = saved(features(rows, "text", ["doc_id"], buckets), "ngrams")
    wanted = bucket_totals(features(target.select(F.col(f"`{target_text}`").alias("text")), "text", [], buckets), buckets)
    gain = gains(bucket_totals(packed, buckets), wanted)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = [_unpack(g.as_py()) for g in b.column("grams")]
            weight = [int(gain[g].sum()) for g in grams]
            noisy = [w + gumbel(d, seed) for w, d in zip(weight, b.column("doc_id").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_words"), pa.array([len(g) for g in grams], pa.int64()),
                 pa.array(weight, pa.int64()), pa.array(noisy, pa.int64())], names=schema.names)

    schema = T.StructType([rows.schema["doc_id"]] + [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight", "score")])
    scored = saved(packed.mapInArrow(score, schema), "scores")
    enough = F.col("n_words") >= min_words
    drawn = share[0] * scored.filter(enough).count() // share[1]
    columns = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    rest = scored.filter(~enough).withColumn("rank", F.lit(None).cast("long"))
    return _ranked(scored.filter(enough), drawn).select(columns).unionByName(rest.select(columns))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
