"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are grown on histograms of binned statistics of a bounded sample of labelled
documents; complete binary trees of one depth are flattened into arrays of features,
thresholds and leaf values, and all rows of a slice walk all trees in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewise.llm.common import flat, held_out, lines_of, map_text, per_doc, read, whitespace_words

#: Most labelled documents that the trees are fitted on: those with the smallest hashes of their ids.
SAMPLE = 20_000
TREES = 60
DEPTH = 4
BINS = 64
RATE = 0.2
SHRINK = 1.0
LEAST_WEIGHT = 4.0

_CLASSES = {
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "stop": ".,;:?", "exclaim": "!", "pipe": "|",
    "symbol": "#*$%&<>", "mark": "@=_/\\~^`+{}[]()\"'-", "blank": " \t", "newline": "\n"}
_CLASS_OF = np.zeros((256, len(_CLASSES) + 1), np.float64)
for _k, _chars in enumerate(_CLASSES.values()):
    _CLASS_OF[[ord(c) for c in _chars], _k] = 1
_CLASS_OF[128:, -1] = 1

FEATURES = ["log_bytes", "log_words", "word_bytes", *_CLASSES, "other_script", "entropy", "distinct_words", "top_word",
            "same_as_previous", "distinct_pairs", "dup_lines", "log_line", "log_longest_line", "log_lines"]


def _histograms(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Counts of byte values by document."""
    return np.array([np.bincount(data[a:b], minlength=256) for a, b in zip(off[:-1], off[1:], strict=True)], np.float64).reshape(-1, 256)


def statistics(text: pa.Array) -> np.ndarray:
    """One row of FEATURES per text; empty and null texts have zeros."""
    n = len(text)
    data, off = flat(text)
    hist = _histograms(data, off)
    size = np.maximum(hist.sum(axis=1), 1)
    share = hist / size[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)

    doc, code, words = whitespace_words(text)
    n_words = per_doc(doc, n)
    some = np.maximum(n_words, 1)
    length = pc.binary_length(words).to_numpy(zero_copy_only=False)
    word_bytes = per_doc(doc, n, length[code]) / some if len(code) else np.zeros(n)
    kinds, counts = np.unique(doc * (len(words) + 1) + code, return_counts=True)
    kind_doc = kinds // (len(words) + 1)
    top = np.zeros(n)
    np.maximum.at(top, kind_doc, counts)
    same = (doc[1:] == doc[:-1]) & (code[1:] == code[:-1])
    n_pairs = per_doc(doc[1:][doc[1:] == doc[:-1]], n)
    distinct_pairs = _distinct_pairs(doc, code, n)

    line_doc, line, lines = lines_of(text)
    line_bytes = pc.binary_length(lines).to_numpy(zero_copy_only=False)[line]
    real = line_bytes > 0
    line_doc, line, line_bytes = line_doc[real], line[real], line_bytes[real]
    n_lines = per_doc(line_doc, n)
    kept = per_doc(np.unique(line_doc * (len(lines) + 1) + line) // (len(lines) + 1), n)
    longest = np.zeros(n)
    np.maximum.at(longest, line_doc, line_bytes)

    columns = [np.log1p(hist.sum(axis=1)), np.log1p(n_words), word_bytes, *(hist @ _CLASS_OF / size[:, None]).T, entropy,
               per_doc(kind_doc, n) / some, top / some, per_doc(doc[1:][same], n) / some, distinct_pairs / np.maximum(n_pairs, 1),
               (n_lines - kept) / np.maximum(n_lines, 1), np.log1p(per_doc(line_doc, n, line_bytes) / np.maximum(n_lines, 1)),
               np.log1p(longest), np.log1p(n_lines)]
    return np.column_stack(columns).astype(np.float32)


def _distinct_pairs(doc: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """Distinct pairs of neighbouring words by document."""
    inside = doc[1:] == doc[:-1]
    order = np.lexsort((code[1:][inside], code[:-1][inside], doc[1:][inside]))
    d, a, b = doc[1:][inside][order], code[:-1][inside][order], code[1:][inside][order]
    first = np.r_[True, (d[1:] != d[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])][:len(d)]
    return per_doc(d[first], n)


@dataclass
class Trees:
    """Complete trees of one depth: inner nodes by level, then leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boost ``trees`` trees for the logistic loss; without both labels all scores are the prior."""
    inner, leaves = 2**depth - 1, 2**depth
    prior = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(prior / (1 - prior)))
    if len(np.unique(y)) < 2:
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, leaves)), bias)
    n, f = x.shape
    edges = [np.unique(np.quantile(x[:, k], np.arange(1, BINS) / BINS, method="lower")) for k in range(f)]
    binned = np.column_stack([np.searchsorted(edges[k], x[:, k], "left") for k in range(f)])
    cell = binned + np.arange(f) * BINS
    total = np.full(n, bias)
    out = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, leaves)), bias)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, base = 2**level, 2**level - 1
            at = (node[:, None] * (f * BINS) + cell).ravel()
            sums = [np.bincount(at, weights=np.repeat(w, f), minlength=width * f * BINS).reshape(width, f, BINS) for w in (g, h)]
            gl, hl = (s.cumsum(axis=2)[:, :, :-1] for s in sums)
            gt, ht = (s.sum(axis=2, keepdims=True) for s in sums)
            gain = gl**2 / (hl + SHRINK) + (gt - gl) ** 2 / (ht - hl + SHRINK) - gt**2 / (ht + SHRINK)
            gain = np.where((hl >= LEAST_WEIGHT) & (ht - hl >= LEAST_WEIGHT), gain, -1)
            for k in range(f):
                gain[:, k, len(edges[k]):] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            which, place = best // (BINS - 1), best % (BINS - 1)
            worth = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            for j in np.flatnonzero(worth):
                out.feature[t, base + j], out.threshold[t, base + j] = which[j], edges[which[j]][place[j]]
            right = worth[node] & (binned[np.arange(n), which[node]] > place[node])
            node = 2 * node + right
        num, den = (np.bincount(node, weights=w, minlength=leaves) for w in (g, h))
        out.leaf[t] = -RATE * num / (den + SHRINK)
        total += out.leaf[t][node]
    return out


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Statistics and label of the documents of at most ``sample`` labels outside the held-out third.

    Null or other labels than 0 and 1 and null ids are left out. An id that repeats gives several rows.
    """
    chosen = (labels.select("doc_id", F.col("quality").cast("int").alias("label"))
              .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
              .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample))
    # at most ``sample`` rows
    own = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return map_text(own, "text", ["label"], [T.StructField("x", T.ArrayType(T.FloatType()))], _packed)


def _packed(text: pa.Array) -> list[pa.Array]:
    x = statistics(text)
    return [pa.array(list(x), pa.list_(pa.float32()))]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees fitted on the driver; what comes here is bounded by ``sample`` rows of statistics.

    If ids repeat and there are more, the rows are cut by the hash of their statistics, whatever their label.
    """
    rows = training_rows(docs, labels, sample).orderBy(F.xxhash64("x"), "label", "x").limit(sample).toPandas()
    x = np.array(rows["x"].tolist(), np.float32).reshape(-1, len(FEATURES))
    return fit(x, rows["label"].to_numpy(np.float64))


def quality_scores(docs: DataFrame, trees: Trees, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row; only the text is an input of the score.

    Null and empty texts are scored by their zero statistics, repeated rows each for itself.
    """
    def run(t: pa.Array) -> list[pa.Array]:
        return [pa.array(trees.score(statistics(t)), pa.float64())]

    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    out = map_text(own, "text", ["doc_id"], [T.StructField("score", T.DoubleType())], run)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_scores(docs, train(docs, read(spark, sf_dir, "labels")))
