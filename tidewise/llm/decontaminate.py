"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are the windows of the items: 13 consecutive words, or all words of a shorter
item. Patterns of one length m share a block shift table over blocks of two words: the
hash of the block under the cursor gives how far the cursor may move, because no
pattern has that block nearer to its end. Where the shift is zero, the suffix hash
selects a bucket of patterns and a direct comparison of the words confirms. Every text
has cursors of its own, one for each stretch of it, which are moved together.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewise.llm.common import flat, map_text, read, saved

WINDOW = 13
BLOCK = 2
#: A shift table has 2**TABLE_BITS entries.
TABLE_BITS = 18
#: Words that one cursor walks through.
STRETCH = 512
#: Item bytes in one block of patterns; more items are searched block after block. A block's tables take about 20 bytes a byte.
ITEM_BLOCK_BYTES = 16 << 20
#: A longer item is cut into pieces that overlap by a window less a word.
PIECE_BYTES = 1 << 20
#: Text bytes whose word hashes are computed at once.
HASH_BYTES = 1 << 20

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_IS_WORD = np.array([bool(WORD.fullmatch(bytes([i | 32 if 65 <= i <= 90 else i]))) for i in range(256)])
_LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)
_PRIME = 0x9E3779B97F4A7C15
_PRIME_INVERSE = pow(_PRIME, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        take = min(done, n - done)
        out[done:done + take] = out[:take] * np.uint64(pow(base, done, 1 << 64))
        done += take
    return out


class _PowerTables:
    up = down = np.zeros(0, np.uint64)

    @classmethod
    def get(cls, n: int):
        if len(cls.up) < n:
            size = max(n, 1 << 20)
            cls.up, cls.down = _powers(_PRIME, size), _powers(_PRIME_INVERSE, size)
        return cls.up, cls.down


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def words_of(data: np.ndarray, off: np.ndarray):
    """Lower-cased bytes, first and end byte of each word, document of each word, word hash."""
    low = _LOWER[data]
    inside = _IS_WORD[data]
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return low, none, none, none, np.zeros(0, np.uint64)
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:n]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | cut[1:n]
    first, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
    doc = np.searchsorted(off, first, "right") - 1
    h = np.empty(len(first), np.uint64)
    a = 0
    while a < len(first):  # words of about HASH_BYTES: sums are taken over these alone
        b = max(a + 1, int(np.searchsorted(end, first[a] + HASH_BYTES, "right")))
        base = first[a]
        up, down = _PowerTables.get(int(end[b - 1] - base) + 1)
        part = low[base:end[b - 1]].astype(np.uint64) + np.uint64(1)
        total = np.r_[np.uint64(0), np.cumsum(part * up[:len(part)])]
        h[a:b] = _mix((total[end[a:b] - base] - total[first[a:b] - base]) * down[first[a:b] - base])
        a = b
    return low, first, end, doc, h


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(a * np.uint64(0xD6E8FEB86659FD93) + b)


def _same_words(low: np.ndarray, first: np.ndarray, end: np.ndarray, other: np.ndarray, other_first: np.ndarray, other_end: np.ndarray) -> np.ndarray:
    """Which words of two byte arrays are equal, byte by byte."""
    size = end - first
    out = size == other_end - other_first
    at = np.flatnonzero(out)
    if len(at):
        size = size[at]
        ends = np.cumsum(size)
        step = np.arange(ends[-1]) - np.repeat(ends - size, size)
        same = low[np.repeat(first[at], size) + step] == other[np.repeat(other_first[at], size) + step]
        out[at] = np.logical_and.reduceat(same, ends - size)
    return out


class Items:
    """The words of all items of a block, in arrays; windows are places in them."""

    def __init__(self, rows: list[tuple]):
        self.ids = [i for i, _ in rows]
        data, off = flat(pa.array([t or "" for _, t in rows], pa.large_string()))
        self.low, self.first, self.end, self.item, self.h = words_of(data, off)
        self.count = np.bincount(self.item, minlength=len(rows))[:len(rows)]


class Patterns:
    """Shift table and suffix buckets of all windows of ``m`` words of a block.

    Equal windows are one pattern, which knows its items. A window takes about 40 bytes beside its words.
    """

    def __init__(self, items: Items, at: np.ndarray, m: int):
        self.of, self.m, self.block = items, m, min(BLOCK, m)
        h = items.h
        whole = np.zeros((2, len(at)), np.uint64)
        for k in range(m):  # 128 bits tell windows apart
            whole[0] = _mix(whole[0] * np.uint64(_PRIME) + h[at + k])
            whole[1] = _mix((whole[1] ^ h[at + k]) * np.uint64(0xD6E8FEB86659FD93))
        order = np.lexsort((items.item[at], whole[1], whole[0]))
        at, whole = at[order], whole[:, order]
        new = np.r_[True, (whole[:, 1:] != whole[:, :-1]).any(axis=0)]
        del whole, order
        self.starts = np.r_[np.flatnonzero(new), len(at)]
        self.items = items.item[at].astype(np.int32)
        self.at = at[new]
        self.shift = np.full(1 << TABLE_BITS, m - self.block + 1, np.uint8)
        for end in range(self.block, m + 1):  # later blocks allow smaller shifts
            slot = (self._block_at(self.at + end - 1) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
            np.minimum.at(self.shift, slot, np.uint8(m - end))
        suffix = self._block_at(self.at + m - 1)
        self.bucket = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.bucket]

    def _block_at(self, last: np.ndarray) -> np.ndarray:
        return self.of.h[last] if self.block == 1 else _pair(self.of.h[last - 1], self.of.h[last])

    def items_of(self, number: int) -> set:
        """Ids of the items that have the pattern."""
        return {self.of.ids[i] for i in set(self.items[self.starts[number]:self.starts[number + 1]].tolist())}


def build_patterns(rows: list[tuple]) -> list[Patterns]:
    """Pattern sets by length, from (item id, text) rows."""
    items = Items(rows)
    place = np.arange(len(items.h)) - np.r_[0, np.cumsum(items.count)][items.item]
    length = np.minimum(items.count, WINDOW)[items.item]
    out = []
    for m in sorted(set(length.tolist())):
        out.append(Patterns(items, np.flatnonzero((length == m) & (place + m <= items.count[items.item])), m))
    return out


def search(p: Patterns, low, first, end, doc, h):
    """Occurrences of the patterns: position of the first word, number of the pattern."""
    n, m = len(h), p.m
    if n < m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    block = h.copy() if p.block == 1 else np.r_[np.uint64(0), _pair(h[:-1], h[1:])]
    slot = (block >> np.uint64(64 - TABLE_BITS)).astype(np.int32)
    doc_end = np.searchsorted(doc, doc, "right")
    doc_first = np.searchsorted(doc, doc, "left")
    # A cursor stands on the last word of a possible occurrence.
    is_first = np.r_[True, doc[1:] != doc[:-1]]
    heads = np.flatnonzero(((np.arange(n) - doc_first) % STRETCH == 0) | is_first)
    limit = np.minimum(np.r_[heads[1:], n], doc_end[heads])
    at = heads.copy()
    starts = doc_first[heads] == heads
    at[starts] += m - 1
    found = []
    live = at < limit
    at, limit = at[live], limit[live]
    while len(at):
        move = p.shift[slot[at]].astype(np.int64)
        hit = move == 0
        if hit.any():
            found.append(at[hit])
        at = at + np.maximum(move, 1)
        live = at < limit
        at, limit = at[live], limit[live]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = np.concatenate(found)
    last = last[last - m + 1 >= doc_first[last]]
    lo, hi = np.searchsorted(p.suffix, block[last], "left"), np.searchsorted(p.suffix, block[last], "right")
    width = hi - lo
    last, lo, width = last[width > 0], lo[width > 0], width[width > 0]
    rows = np.repeat(np.arange(len(last)), width)
    entry = np.repeat(lo, width) + np.arange(len(rows)) - np.repeat(np.cumsum(width) - width, width)
    begin = last[rows] - m + 1
    number = p.bucket[entry]
    for k in range(m):  # hashes narrow the bucket before the bytes are compared
        same = h[begin + k] == p.of.h[p.at[number] + k]
        begin, number = begin[same], number[same]
    for k in range(m):
        word, own = begin + k, p.at[number] + k
        same = _same_words(low, first[word], end[word], p.of.low, p.of.first[own], p.of.end[own])
        begin, number = begin[same], number[same]
    return begin, number


def scan(text: pa.Array, sets: list[Patterns]):
    """Words, hit flags by word, and (document, item) pairs of a slice of texts."""
    data, off = flat(text)
    low, first, end, doc, h = words_of(data, off)
    step = np.zeros(len(h) + 1, np.int64)
    pairs: dict[int, set] = {}
    for p in sets:
        begin, number = search(p, low, first, end, doc, h)
        np.add.at(step, begin, 1)
        np.add.at(step, begin + p.m, -1)
        for d, j in set(zip(doc[begin].tolist(), number.tolist(), strict=True)):
            pairs.setdefault(d, set()).update(p.items_of(j))
    return doc, np.cumsum(step)[:-1] > 0, pairs


FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.LongType())),
          T.StructField("item_ids", T.ArrayType(T.StringType()))]


def _spans(doc: np.ndarray, hit: np.ndarray, n: int) -> list[list[int]]:
    """First word and end of each hit stretch, flattened, by document."""
    out: list[list[int]] = [[] for _ in range(n)]
    if hit.any():
        base = np.searchsorted(doc, np.arange(n), "left")
        edge = np.r_[True, doc[1:] != doc[:-1]]
        start = np.flatnonzero(hit & (np.r_[True, ~hit[:-1]] | edge))
        stop = np.flatnonzero(hit & np.r_[~hit[1:] | edge[1:], True]) + 1
        for a, b in zip(start.tolist(), stop.tolist(), strict=True):
            d = int(doc[a])
            out[d] += [int(a - base[d]), int(b - base[d])]
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",),
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Benchmark windows in each text, one row per input row.

    Adds ``n_words``, ``hit_spans`` (first and end word of each stretch inside an
    occurrence, flattened), ``n_hit``, ``item_ids`` (items with an occurring window, as sorted
    strings), ``n_items``, ``items_sha256`` and ``contaminated`` (n_hit > 0 and 20 * n_hit >= n_words).

    The items are a query set: they are sent to the tasks in blocks of about
    ITEM_BLOCK_BYTES, and all rows pass each block. A long item is cut into pieces that share their last and first
    words, so blocks are even. Null or empty texts have no
    words, null or wordless items no window; an item with a null id matches and is not
    listed. Equal items are each listed, repeated rows are each searched.
    """
    sized = items.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{item_text}`").cast("string").alias("t"))
    sized = saved(sized.filter("t is not null").mapInArrow(_pieces, "i string, t string"), "items")
    size = sized.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = size // ITEM_BLOCK_BYTES + 1
    spread = F.pmod(F.xxhash64("i", "t"), F.lit(blocks))
    out = docs
    for k in range(blocks):
        rows = [(r.i, r.t) for r in sized.filter(spread == k).toLocalIterator()]
        known = docs.sparkSession.sparkContext.broadcast(rows)
        fields = FIELDS if k == 0 else [T.StructField(f"__{f.name}", f.dataType) for f in FIELDS]
        if k == 0:
            keep = list(dict.fromkeys([*carry, *([text] if blocks > 1 else [])]))
        else:
            keep = out.columns
        out = map_text(out, text, keep, fields, _searcher(known))
        if k:
            out = out.withColumn("hit_spans", F.concat("hit_spans", "__hit_spans")).withColumn(
                "item_ids", F.concat("item_ids", "__item_ids")).drop(*[f.name for f in fields])
    if blocks > 1 and text not in carry:
        out = out.drop(text)
    return _totals(out)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items of at most about PIECE_BYTES: every window of a longer one is whole in a piece of it."""
    for b in batches:
        out: list[tuple] = []
        for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            raw = text.encode()
            if len(raw) <= PIECE_BYTES:
                out.append((item, text))
                continue
            words = [m.span() for m in WORD.finditer(raw.translate(_LOWER.tobytes()))]
            if len(words) <= WINDOW:
                out.append((item, text))
                continue
            lo = 0
            while True:
                hi = lo + WINDOW
                while hi < len(words) and words[hi][1] - words[lo][0] <= PIECE_BYTES:
                    hi += 1
                out.append((item, raw[words[lo][0]:words[hi - 1][1]].decode()))
                if hi == len(words):
                    break
                lo = hi - WINDOW + 1
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*out, strict=True) if out else ((), ()))], names=["i", "t"])


def _searcher(known):
    """Scans a slice; the tables are built once in each Python worker."""
    mark = uuid.uuid4().hex

    def run(texts: pa.Array) -> list[pa.Array]:
        if mark not in _READY:
            _READY.clear()
            _READY[mark] = build_patterns(known.value)
        n = len(texts)
        doc, hit, pairs = scan(texts, _READY[mark])
        words = np.bincount(doc, minlength=n)[:n]
        spans = _spans(doc, hit, n)
        ids = [sorted(x for x in pairs.get(d, ()) if x is not None) for d in range(n)]
        return [pa.array(words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(ids, pa.list_(pa.string()))]

    return run


_READY: dict = {}


def _totals(out: DataFrame) -> DataFrame:
    """Counts of the united spans, the digest of the items and the verdict."""
    def joined(s):
        return F.array_join(F.array_sort(F.array_distinct(s)), ",")

    hit = F.expr("""aggregate(
        array_sort(transform(sequence(0, cast(size(hit_spans) / 2 as int) - 1), i -> struct(hit_spans[2 * i] as a, hit_spans[2 * i + 1] as b))),
        struct(0L as n, 0L as at),
        (s, x) -> struct(s.n + greatest(x.b - greatest(x.a, s.at), 0L) as n, greatest(s.at, x.b) as at),
        s -> s.n)""")
    return (out.withColumn("n_hit", F.when(F.size("hit_spans") > 0, hit).otherwise(F.lit(0)).cast("long"))
            .withColumn("item_ids", F.array_sort(F.array_distinct("item_ids")))
            .withColumn("n_items", F.size("item_ids").cast("long"))
            .withColumn("items_sha256", F.sha2(joined(F.col("item_ids")).cast("binary"), 256))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans")
