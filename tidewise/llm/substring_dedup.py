"""Substring dedup by fixed-block anchors.

Every document is cut into non-overlapping blocks of 7 words: the reference blocks. Every rolling window of 7 words
of every document probes them. Any 13 consecutive words contain a whole block of the cut, so each repeat of 13 words
or more between two documents holds an anchor: a block of the one that is a rolling window of the other.

An anchor is then extended by up to six words to either side: on both documents, all windows of 13 words that hold
it. A window of the later document is confirmed if an earlier one has the same words there, and the
confirmed windows that overlap or touch unite to the maximal exact repeats.

Both rounds meet by hash in the same way. The entries of a slice of documents are packed into arrays, one binary
for each hash range. The task of a range gets the reference entries first and folds them to the smallest doc_id of each
hash; then the probes stream past that table, so a hash that stands in many documents is one entry there, no pair
of documents is formed, and no group is held.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewise.llm.common import look_up, map_text, read, saved, slices, whitespace_words

WINDOW = 13
#: Words of one hash range: about 100 MB of packed entries, of which a seventh are held as a table. A document has a row of
#: found entries for each range, so ranges are large.
RANGE_WORDS = 16 << 20
LEAST_RANGES = 24
#: Words of one part of the texts.
PART_WORDS = 4 << 20
#: Reference entries that are gathered before they are folded into the table.
FOLD = 1 << 20
REFERENCE, PROBE, ASK_REFERENCE = 0, 1, 2
_ODD = np.uint64(0x9E3779B97F4A7C15)
_NO_DOC = np.iinfo(np.int64).max


def block_words(window: int) -> int:
    """The longest block of which every window of that many words holds a whole one."""
    return (window + 1) // 2


class Words:
    """The words of a slice of texts as two independent 64-bit hashes each, with their documents and places."""

    def __init__(self, text: pa.Array) -> None:
        self.n = len(text)
        self.doc, self.code, self.words = whitespace_words(text)
        raw = b"".join(map(xxhash.xxh3_128_digest, self.words.cast(pa.binary()).to_pylist()))
        self._hashes = np.frombuffer(raw, "<u8").reshape(-1, 2)
        self.count = np.bincount(self.doc, minlength=self.n)[:self.n]
        self.start = np.r_[0, np.cumsum(self.count)]
        self.place = np.arange(len(self.doc)) - self.start[self.doc]

    def starts(self, k: int) -> np.ndarray:
        """Flags of the words at which k words of one document start."""
        return self.place + k <= self.count[self.doc]

    def rolling(self, k: int, which: int) -> np.ndarray:
        """Hash of the k words from each word on (of no meaning where fewer are left in the document)."""
        h = np.r_[self._hashes[self.code, which], np.zeros(k, np.uint64)]
        acc = np.zeros(len(self.doc), np.uint64)
        for j in range(k):
            acc = acc * _ODD + h[j:j + len(acc)]
        acc ^= acc >> np.uint64(32)
        acc *= np.uint64(0xD6E8FEB86659FD93)
        return acc ^ (acc >> np.uint64(32))


def _packed(part: np.ndarray, kind: int, doc: np.ndarray, ids: np.ndarray, rest: np.ndarray, out: list) -> None:
    """Add one (range, kind, binary) for each range: its documents, how many entries each has, and the entries."""
    order = np.argsort(part, kind="stable")
    part, doc, rest = part[order], doc[order], rest[order]
    edges = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)] if len(part) else np.zeros(1, np.int64)
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own = doc[lo:hi]
        first = np.r_[0, np.flatnonzero(np.diff(own)) + 1]
        counts = np.diff(np.r_[first, hi - lo]).astype(np.uint32)
        out.append((int(part[lo]), kind, len(first).to_bytes(4, "little") + ids[own[first]].tobytes() + counts.tobytes()
                    + rest[lo:hi].tobytes()))


def _unpacked(blob: bytes, rest: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Document and rest of the hash of each entry."""
    n = int.from_bytes(blob[:4], "little")
    ids, counts = np.frombuffer(blob, np.int64, n, 4), np.frombuffer(blob, np.uint32, n, 4 + 8 * n)
    return np.repeat(ids, counts), np.frombuffer(blob, rest, -1, 4 + 12 * n)


_ENTRIES = "part int, kind int, entries binary"


def _batch(rows: list) -> pa.RecordBatch:
    part, kind, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())],
                                      names=["part", "kind", "entries"])


def _split(h: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash range and the 32 bits of an anchor hash that tell entries of a range apart."""
    part = (h & np.uint64(0xFFFFFFFF)) % np.uint64(ranges)
    return part.astype(np.uint16 if ranges <= 1 << 16 else np.int32), (h >> np.uint64(32)).astype(np.uint32)


def _first_of_equal(ids: np.ndarray, text: pa.Array) -> np.ndarray:
    """Flags: the row has the smallest doc_id among the equal texts of the slice."""
    code = text.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    least = np.full(int(code.max()) + 1 if len(code) else 0, _NO_DOC)
    np.minimum.at(least, code, ids)
    return least[code] == ids


def _anchors(docs: DataFrame, window: int, ranges: int) -> DataFrame:
    """Packed entries of all blocks and rolling windows of ``docs`` (doc_id, text; no nulls)."""
    k = block_words(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(1)):
                ids, text = b.column(0).slice(lo, hi - lo).to_numpy(), b.column(1).slice(lo, hi - lo)
                w = Words(text)
                # equal texts of a slice: all windows of the others stand in the first
                live = w.starts(k) & (w.count >= window)[w.doc] & _first_of_equal(ids, text)[w.doc]
                part, rest = _split(w.rolling(k, 0), ranges)
                block = live & (w.place % k == 0)
                out: list = []
                for kind, at in ((REFERENCE, block), (PROBE, live & ~block), (ASK_REFERENCE, block)):
                    _packed(part[at], kind, w.doc[at], ids, rest[at], out)
                yield _batch(out)

    return docs.mapInArrow(run, _ENTRIES)


class _Least:
    """Smallest and largest doc_id of each reference hash of a range."""

    def __init__(self, rest: np.dtype) -> None:
        self.rest, self.doc, self.most = np.zeros(0, rest), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._new: list[tuple[np.ndarray, np.ndarray]] = []
        self._size = 0

    def add(self, doc: np.ndarray, rest: np.ndarray) -> None:
        self._new.append((doc, rest))
        self._size += len(rest)
        if self._size > max(FOLD, len(self.rest)):
            self.fold()

    def fold(self) -> None:
        if self._new:
            doc = np.concatenate([self.doc, self.most, *[d for d, _ in self._new]])
            rest = np.concatenate([self.rest, self.rest, *[r for _, r in self._new]])
            order = np.lexsort((doc, rest))
            doc, rest = doc[order], rest[order]
            first = np.flatnonzero(np.r_[True, rest[1:] != rest[:-1]])
            last = np.r_[first[1:], len(rest)] - 1
            self.doc, self.most, self.rest, self._new, self._size = doc[first], doc[last], rest[first], [], 0

    def places(self, rest: np.ndarray) -> np.ndarray:
        """Place of each hash in the table, -1 if it is not there."""
        if not len(self.rest):
            return np.full(len(rest), -1)
        at = np.minimum(np.searchsorted(self.rest, rest), len(self.rest) - 1)
        return np.where(self.rest[at] == rest, at, -1)


def _found(doc: np.ndarray, rest: np.ndarray, kind: int, part: int) -> pa.RecordBatch:
    """One row for each document: the entries that have a partner. Equal documents stand together."""
    first = np.r_[0, np.flatnonzero(np.diff(doc)) + 1]
    ends = np.r_[first, len(doc)].astype(np.int32) * rest.itemsize
    blobs = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rest.tobytes())])
    n = len(first)
    return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, part, np.int32)), blobs],
                                      names=["doc_id", "kind", "part", "entries"])


def _partners(entries: DataFrame, ranges: int, rest: str) -> DataFrame:
    """(doc_id, kind, part, entries): the probes that a smaller doc_id answers, and the references that answer a larger one.

    The entries of a range come by kind: references fill the table, probes use it, and references
    that ask learn whether their hash was found.
    """
    width = np.dtype(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True))
        for part, group in groupby(rows, key=lambda r: r[0]):
            table, used = _Least(width), None
            for _, kind, blob in group:
                doc, h = _unpacked(blob.as_py(), width)
                if kind == REFERENCE:
                    table.add(doc, h)
                    continue
                if used is None:
                    table.fold()
                    used = table.most > table.doc
                at = table.places(h)
                known = np.flatnonzero(at >= 0)
                hit = known[table.doc[at[known]] < doc[known]]
                if len(hit):
                    used[at[hit]] = True
                    yield _found(doc[hit], h[hit], PROBE, part)
                if kind == ASK_REFERENCE:
                    asked = known[used[at[known]]]
                    if len(asked):
                        yield _found(doc[asked], h[asked], REFERENCE, part)

    return (entries.repartition(ranges, "part").sortWithinPartitions("part", "kind")
            .mapInArrow(run, "doc_id long, kind int, part int, entries binary"))


def _marks(at: np.ndarray, back: int, ok: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Flags of the window starts (``ok``) that lie 0 to ``back`` words before the given words, in the same document."""
    out = np.zeros(len(ok), bool)
    for o in range(back + 1):
        start = at[at >= o] - o
        out[start[doc[start] == doc[start + o]]] = True
    return out & ok


def _extended(placed: DataFrame, window: int, ranges: int) -> DataFrame:
    """Packed windows around the anchors of (doc_id, text, found), both of probes and of references."""
    k = block_words(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(1)):
                ids, found = b.column(0).slice(lo, hi - lo).to_numpy(), b.column(2).slice(lo, hi - lo)
                w = Words(b.column(1).slice(lo, hi - lo))
                part, rest = _split(w.rolling(k, 0), ranges)
                anchor = (part.astype(np.uint64) << np.uint64(32)) | rest
                flags = {PROBE: np.zeros(len(anchor), bool), REFERENCE: np.zeros(len(anchor), bool)}
                for d, own in enumerate(found):
                    at = slice(w.start[d], w.start[d + 1])
                    keys: dict[int, list] = {PROBE: [], REFERENCE: []}
                    for e in own.as_py():
                        keys[e["kind"]].append(np.frombuffer(e["entries"], np.uint32).astype(np.uint64) | np.uint64(e["part"] << 32))
                    for kind, got in keys.items():
                        if got:
                            flags[kind][at] = np.isin(anchor[at], np.concatenate(got))
                whole, ok = w.starts(k), w.starts(window)
                here = {PROBE: _marks(np.flatnonzero(flags[PROBE] & whole), window - k, ok, w.doc),
                        REFERENCE: _marks(np.flatnonzero(flags[REFERENCE] & whole & (w.place % k == 0)), window - k, ok, w.doc)}
                part = (w.rolling(window, 1) % np.uint64(ranges)).astype(np.uint16 if ranges <= 1 << 16 else np.int32)
                full = w.rolling(window, 0)
                out: list = []
                for kind, at in here.items():
                    _packed(part[at], kind, w.doc[at], ids, full[at], out)
                yield _batch(out)

    return placed.mapInArrow(run, _ENTRIES)


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))
_CUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("digest", T.BinaryType()),
                     T.StructField("n_removed", T.LongType()), T.StructField("spans", _SPANS),
                     T.StructField("kept_text", T.StringType())])


def _cut(placed: DataFrame, window: int) -> DataFrame:
    """Spans and rest of the texts of (doc_id, text, entries); ``entries`` are confirmed windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(1)):
                confirmed = b.column(2).slice(lo, hi - lo)
                w = Words(b.column(1).slice(lo, hi - lo))
                full, ok, words = w.rolling(window, 0), w.starts(window), w.words.to_pylist()
                out: list[tuple] = []
                for d, own in enumerate(confirmed):
                    at = slice(w.start[d], w.start[d + 1])
                    hits = np.concatenate([np.frombuffer(e, np.uint64) for e in own.as_py()])
                    step = np.zeros(w.count[d] + 1, np.int64)
                    start = np.flatnonzero(np.isin(full[at], hits) & ok[at])
                    np.add.at(step, start, 1)
                    np.add.at(step, start + window, -1)
                    gone = np.cumsum(step)[:-1] > 0
                    edge = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                    text = [words[c] for c in w.code[at]]
                    out.append((hashlib.sha256(" ".join(text).encode()).digest(), int(gone.sum()),
                                [{"start": a, "length": z - a} for a, z in edge.reshape(-1, 2).tolist()],
                                " ".join(t for t, g in zip(text, gone.tolist(), strict=True) if not g)))
                spans = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), spans, pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *columns], names=_CUT.names)

    return placed.mapInArrow(run, _CUT)


def _digests(text: pa.Array) -> list[pa.Array]:
    words = [s.encode().split() if s else [] for s in text.to_pylist()]
    return [pa.array(list(map(len, words)), pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).digest() for w in words], pa.binary())]


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept_text, kept_sha256), one row per input row.

    A word goes if some ``window`` consecutive words around it also stand in a row with a smaller doc_id;
    ``spans`` are the runs of such words (start and length in words), ``kept_text`` the other words, joined by one space: null
    where nothing goes, as the text then stays as it is. ``kept_sha256`` is the hash of the words left in either case.

    Null and empty texts have no words. A row without an id is kept whole and removes nothing. Rows that share an id
    do not compare with each other, repeated rows get equal results. Of equal texts all but those of the smallest id go whole (if
    they have ``window`` words). An empty table gives an empty result; other columns are not read. Memory: a
    slice of texts of 4 MB, or one longer text, and the reference hashes of one range.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("digest", T.BinaryType())]
    base = saved(map_text(rows, "text", ["doc_id"], fields, _digests), "digests")
    total = base.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first()["n"]
    ranges, parts = (max(LEAST_RANGES, math.ceil(total / words)) for words in (RANGE_WORDS, PART_WORDS))

    able = base.filter((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    firsts = saved(able.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "first-copies")
    marked = saved(look_up(base, "digest", firsts, "n", "copies").drop("n")
                   .withColumn("copied", F.coalesce((F.col("n_words") >= window) & (F.col("first") < F.col("doc_id")), F.lit(False))), "copies")
    own = marked.filter(~F.col("copied") & (F.col("n_words") >= window) & F.col("doc_id").isNotNull()).select("doc_id").distinct()

    live = rows.filter("doc_id is not null and text is not null")
    anchors = saved(_partners(_anchors(live, window, ranges), ranges, "<u4"), "anchors")
    found = anchors.join(own, "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("kind", "part", "entries")).alias("found"))
    placed = live.repartition(parts, "doc_id")  # both joins below use this one shuffle of the texts
    windows = _extended(placed.join(found, "doc_id").select("doc_id", "text", "found"), window, ranges)
    confirmed = _partners(windows, ranges, "<u8").groupBy("doc_id").agg(F.collect_list("entries").alias("entries"))
    cut = _cut(placed.join(confirmed, "doc_id").select("doc_id", "text", "entries"), window)
    cut = saved(cut.filter("n_removed > 0").dropDuplicates(["doc_id", "digest"]), "cut")

    copied = F.col("copied")
    out = marked.join(cut, ["doc_id", "digest"], "left")
    kept = F.when(copied, "").otherwise(F.col("kept_text"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("length")))
    return out.select(
        "doc_id", "n_words", F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, whole).otherwise(F.coalesce("spans", F.array().cast(_SPANS))).alias("spans"), kept.alias("kept_text"),
        F.coalesce(F.sha2(kept.cast("binary"), 256), F.lower(F.hex("digest"))).alias("kept_sha256"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: A window of 13 words goes if a smaller doc_id has it too.
OP11_SQL = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS seq
    FROM words, unnest(range(1, len(w) - 11)) AS u(i)
), firsts AS (
    SELECT seq, min(doc_id) AS first_doc FROM windows GROUP BY seq
), gone AS (
    SELECT DISTINCT doc_id, i + k AS i
    FROM windows JOIN firsts USING (seq), range(0, 13) AS r(k)
    WHERE first_doc < doc_id
), kept AS (
    SELECT doc_id, count(*) FILTER (g.i IS NOT NULL) AS n_removed,
           coalesce(string_agg(word, ' ' ORDER BY p.i) FILTER (g.i IS NULL), '') AS kept_text
    FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words) p
    LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept_text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""
