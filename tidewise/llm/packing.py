"""Packing along a space-filling curve.

Each document's tokens make a hashed feature vector, which a fixed random projection
takes to a few dimensions. The Hilbert key of that point puts similar documents next
to each other; documents are range-sorted by it and laid end to end along the curve. The
one long run of tokens is cut every ``length`` tokens, so only its tail is shorter; the
tail is cut into powers of two and no padding remains.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewise.llm.common import give_back, map_text, read, saved, small_batches

LENGTH = 4096
END = 2
DIMENSIONS = 4
BITS = 10
#: Low bits of a key that part documents of one point, as copies are.
TIE_BITS = 23
#: Buckets of the hashed feature vector before the projection.
FEATURES = 4096
#: Distinct words whose ids a Python worker keeps.
KNOWN_WORDS = 200_000
#: Tokens of one bucket of the curve, which a task sorts and cuts.
BUCKET_TOKENS = 8 << 20
LEAST_BUCKETS = 8
#: Words of composed Latin letters: normalization only lower-cases them, letter by letter.
_PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00de\u00df-\u00f6\u00f8-\u00ff]+")


class WordEncoder:
    """Encodes texts word by word, each distinct word once.

    The tokenizer's pre-tokenizer never joins what white space separates, and no normal form
    reaches over it, so equal words have equal ids wherever they stand. Words keep their case: special tokens
    match exactly, and composition comes before lower-casing (J + caron stays two letters, j + caron does not).
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(file)
        self.bytes = {i: "".join(ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(i))[0][0])
                      for i in range(0xDF, 0x100)}
        vocab = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.points = _projection()[_hash_ids(vocab, FEATURES)]
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.first = [0]

    def _ids(self, word: str) -> list[int]:
        if _PLAIN.fullmatch(word):
            return [t.id for t in self.tokenizer.model.tokenize(word.lower().translate(self.bytes))]
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _learn(self, words: list[str]) -> None:
        """Append the ids of new words; their numbers follow those known."""
        ids: list[int] = []
        base = len(self.first) - 1
        model = self.tokenizer.model
        for w in words:
            if w.isascii() and w.isalpha():  # the normalizer lower-cases it, the pre-tokenizer leaves it whole
                ids += [t.id for t in model.tokenize(w.lower())]
            else:
                ids += self._ids(w)
            self.first.append(self.used + len(ids))
        self.known.update(zip(words, range(base, base + len(words)), strict=True))
        need = self.used + len(ids)
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids[:self.used], np.zeros(max(need, len(self.ids)), np.uint32)])
        self.ids[self.used:need] = ids
        self.used = need

    def _forget(self, words: list[str]) -> None:
        """Drop the words learnt last, once the table is full: frequent words came early."""
        if len(self.known) > KNOWN_WORDS:
            for w in words:
                del self.known[w]
            del self.first[len(self.first) - len(words):]
            self.used = self.first[-1]

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts end to end, and the n + 1 offsets of the texts."""
        # The pre-tokenizer parts a letter from a mark that follows it, unless that is an apostrophe. Only ASCII letters: others
        # may have a normal form that ends in a mark, which joins the next one. Not before "|", so special tokens stay whole.
        text = pc.replace_substring_regex(pc.fill_null(text, ""), r"([A-Za-z])([!-&(-/:-@\[-`{}~])", r"\1 \2")
        parts = pc.ascii_split_whitespace(text)
        off = parts.offsets.to_numpy().astype(np.int64)
        enc = parts.values.slice(off[0], off[-1] - off[0]).dictionary_encode()
        off = off - off[0]
        words = enc.dictionary.to_pylist()
        code = enc.indices.to_numpy(zero_copy_only=False)
        new = [w for w in words if w not in self.known]
        self._learn(new)
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        first = np.array(self.first, np.int64)
        start, size = first[at][code], (first[at + 1] - first[at])[code]
        ends = np.r_[0, np.cumsum(size)]
        place = np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)
        out = self.ids[place]
        self._forget(new)
        return out, ends[off]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_ids(n: int, buckets: int) -> np.ndarray:
    return (_mixed(np.arange(n, dtype=np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _projection() -> np.ndarray:
    """FEATURES x DIMENSIONS, fixed: sums of uniform numbers, near normal."""
    u = _mixed(np.arange(FEATURES * DIMENSIONS * 12, dtype=np.uint64) + np.uint64(1 << 32)) / 2.0**64
    return (u.reshape(FEATURES, DIMENSIONS, 12).sum(axis=2) - 6).astype(np.float32)


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points in [0, 2**bits)**d, for d * bits below 64.

    Walks from the highest bit down; each orthant's rotation and reflection are
    carried as exchanges with the first axis, and a Gray code gives the order.
    """
    x = points.astype(np.uint64).T.copy()
    d = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = np.uint64(q - 1)
        for i in range(d):
            flip = (x[i] & np.uint64(q)) != 0
            swap = np.where(flip, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    carry = np.zeros_like(x[0])
    q = top
    while q > 1:
        carry ^= np.where((x[d - 1] & np.uint64(q)) != 0, np.uint64(q - 1), np.uint64(0))
        q >>= 1
    x ^= carry
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return key.astype(np.int64)


def _keys(ids: np.ndarray, off: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Hilbert key of each document's mean projected feature."""
    n = np.diff(off)
    total = np.zeros((len(n), DIMENSIONS))
    full = np.flatnonzero(n)
    for k in range(DIMENSIONS):
        if len(full):
            total[full, k] = np.add.reduceat(points[:, k][ids], off[:-1][full], dtype=np.float64)
    mean = total / np.maximum(n, 1)[:, None]
    unit = np.arctan(6 * mean) / np.pi + 0.5
    return hilbert_key(np.clip(unit * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64))


_ENCODERS: dict[str, WordEncoder] = {}
#: The task that this Python worker runs, and the rows that it has keyed in it.
_task = [None, 0]


def _row_numbers(n: int) -> np.ndarray:
    """Numbers of the next ``n`` rows, of partition and place in it: the same in each run over the same files."""
    task = pyspark.TaskContext.get()
    if _task[0] != task.taskAttemptId():
        _task[:] = [task.taskAttemptId(), 0]
    first = (task.partitionId() << 40) + _task[1]
    _task[1] += n
    return np.arange(first, first + n, dtype=np.uint64)


def _encoder(file: str) -> WordEncoder:
    if file not in _ENCODERS:
        _ENCODERS[file] = WordEncoder(file)
    return _ENCODERS[file]


def _tokens(text: pa.Array, file: str) -> list[pa.Array]:
    enc = _encoder(file)
    ids, off = enc.encode(text)
    keys = _keys(ids, off, enc.points)
    tie = _mixed(_row_numbers(len(text)))
    keys = (keys << TIE_BITS) | (tie >> np.uint64(64 - TIE_BITS)).astype(np.int64)
    body = np.insert(ids, off[1:], np.uint32(END)).astype(np.uint32)
    off = off + np.arange(len(off))
    small = body.astype(np.uint16) if enc.points.shape[0] <= 1 << 16 else body
    del ids, body
    give_back()
    return [pa.array(keys, pa.int64()), pa.array(np.diff(off), pa.int64()),
            pa.Array.from_buffers(pa.binary(), len(text), [None, pa.py_buffer((off * small.itemsize).astype(np.int32)), pa.py_buffer(small)])]


def _tail(total: int, length: int) -> list[int]:
    """Ends of the sequences of the tail: the remaining tokens as falling powers of two."""
    rest, at, out = total % length, total - total % length, []
    for b in range(rest.bit_length() - 1, -1, -1):
        if rest >> b & 1:
            at += 1 << b
            out.append(at)
    return out


def _cut(base: dict[int, int], total: int, length: int, with_ids: bool):
    whole = total // length
    tail = np.array([whole * length, *_tail(total, length)], np.int64)
    names = [f.name for f in PIECE] + (["ids"] if with_ids else [])

    def run(batches):
        bucket_now, done = None, 0
        for b in batches:
            cols = {k: [] for k in names}
            for doc, n, raw, bucket in zip(*(b.column(b.schema.get_field_index(k)).to_pylist() for k in ("doc_id", "doc_tokens", "ids", "bucket")), strict=True):
                if bucket != bucket_now:
                    bucket_now, done = bucket, base[bucket]
                ids = np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32).astype("<u4")
                at = begin = done
                done += n
                while at < done:
                    if at < whole * length:
                        seq, offset = divmod(at, length)
                        stop = (seq + 1) * length
                    else:
                        k = int(np.searchsorted(tail, at, "right"))
                        seq, stop, offset = whole + k - 1, int(tail[k]), at - int(tail[k - 1])
                    stop = min(stop, done)
                    piece = ids[at - begin:stop - begin].tobytes()
                    row = (doc, at - begin, stop - at, zlib.crc32(piece), n, seq, offset, piece)
                    for k, v in zip(names, row, strict=False):
                        cols[k].append(v)
                    at = stop
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols["doc_id"], b.schema.field("doc_id").type),
                 *[pa.array(cols[k], pa.int64()) for k in names[1:7]], *[pa.array(cols[k], pa.binary()) for k in names[7:]]], names=names)

    return run


def _bucket(bounds: list[int]):
    edges = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def place(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, key.to_numpy(), "right").astype(np.int32))

    return place


PIECE = [T.StructField(n, T.LongType()) for n in
         ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
         length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """Pieces of documents in sequences of ``length`` tokens, one row per piece.

    (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]); ``ids`` are
    little-endian unsigned 32-bit numbers. ``tokenizer`` is the path of a tokenizer file that all
    executors have. Each row of ``docs`` is a document of its own, also if its doc_id
    repeats or is null; null and empty texts have the end token alone. The longest
    text is held whole. An empty table has no piece.
    """
    spark = docs.sparkSession
    fields = [T.StructField("key", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    rows = map_text(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text", ["doc_id"],
                    fields, lambda t: _tokens(t, tokenizer))
    with small_batches(spark):
        rows = saved(rows, "tokens")
    n_tokens = rows.agg(F.coalesce(F.sum("doc_tokens"), F.lit(0)).alias("n")).first()["n"]
    parts = max(LEAST_BUCKETS, -(-n_tokens // BUCKET_TOKENS))  # so a task's share does not grow with the data
    # parts - 1 quantiles of the keys; a bucket has a stretch of the curve
    bounds = rows.agg(F.percentile_approx("key", [k / parts for k in range(1, parts)] or [0.5], F.lit(20 * parts))).first()[0]
    if bounds is None:
        bounds = []
    laid = rows.withColumn("bucket", _bucket(sorted(set(bounds)))("key"))
    sizes = {r.bucket: r.n for r in laid.groupBy("bucket").agg(F.sum("doc_tokens").alias("n")).collect()}  # a row for each bucket
    base, total = {}, 0
    for p in sorted(sizes):
        base[p] = total
        total += sizes[p]
    out = T.StructType([T.StructField("doc_id", laid.schema["doc_id"].dataType), *PIECE[1:],
                        *([T.StructField("ids", T.BinaryType())] if with_ids else [])])
    laid = laid.repartitionById(parts, "bucket").sortWithinPartitions("bucket", "key")
    return laid.select("doc_id", "doc_tokens", "ids", "bucket").mapInArrow(_cut(base, total, length, with_ids), out)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)
