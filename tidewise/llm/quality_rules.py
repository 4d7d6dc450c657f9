"""Quality rules: repetition found with a suffix array over each text's words.

The words of a slice of documents get one suffix array by prefix doubling (ranks start
from (document, word), so a suffix never matches another document). The longest common
prefixes of neighbouring suffixes give, for each word position, the depth of the
deepest LCP interval that holds it: the length of the longest substring starting there
that occurs at least twice. The spans of all maximal repeated substrings are united, and
the covered share of words and the longest repeat are limited.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidewise.llm.common import ascii_table, flat, lines_of, map_text, per_doc, read, whitespace_words

SYMBOLS = ascii_table(r"[#*$%&|<>]")
BASE_WINDOW = 8

FIELDS = [T.StructField(n, t) for n, t in (
    ("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()),
    ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("n_covered_words", T.LongType()),
    ("longest_repeat", T.LongType()), ("n_repeats", T.LongType()), ("base_failed", T.BooleanType()),
    ("kept", T.BooleanType()))]


def _split_ranks(rank: np.ndarray, second: np.ndarray, active: np.ndarray):
    """Refine the groups of ``active`` positions by ``second``; returns those still shared.

    A rank is the place of its group's first suffix in the suffix array.
    """
    width = int(second.max()) + 1 if len(second) else 1
    key = rank[active].astype(np.int64) * width + second
    order = np.argsort(key, kind="stable")
    active, key = active[order], key[order]
    base = rank[active]
    n = len(active)
    at = np.arange(n)
    new_group = np.r_[True, base[1:] != base[:-1]]
    new_sub = np.r_[True, key[1:] != key[:-1]]
    group_first = np.maximum.accumulate(np.where(new_group, at, 0))
    sub_first = np.maximum.accumulate(np.where(new_sub, at, 0))
    rank[active] = base + (sub_first - group_first)
    shared = ~(new_sub & np.r_[new_sub[1:], True])
    return active[shared]


def repeat_lengths(doc: np.ndarray, code: np.ndarray) -> np.ndarray:
    """For each word: length of the longest repeated substring of its document starting there."""
    n = len(code)
    if n == 0:
        return np.zeros(0, np.int64)
    end = np.searchsorted(doc, doc, "right")
    rank = np.zeros(n, np.int32)
    active = _split_ranks(rank, doc * (int(code.max()) + 1) + code, np.arange(n))
    levels = [rank.copy()]
    while len(active):
        step = 1 << (len(levels) - 1)
        nxt = active + step
        inside = nxt < end[active]
        second = np.where(inside, rank[np.minimum(nxt, n - 1)].astype(np.int64) + 1, 0)
        active = _split_ranks(rank, second, active)
        levels.append(rank.copy())
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    a, b = order[:-1], order[1:]
    lcp = np.zeros(n - 1, np.int64)
    live = np.flatnonzero(levels[0][a] == levels[0][b])  # all others share no word
    x, y, got = a[live], b[live], np.zeros(len(live), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = x + got, y + got
        ok = (i < end[x]) & (j < end[y])
        same = ok & (levels[k][np.minimum(i, n - 1)] == levels[k][np.minimum(j, n - 1)])
        got += same.astype(np.int64) << k
    lcp[live] = got
    longest = np.zeros(n, np.int64)
    longest[a] = lcp
    longest[b] = np.maximum(longest[b], lcp)
    return longest


def _covered(length: np.ndarray, least: int, cap: int | None = None) -> np.ndarray:
    """Positions inside the union of the spans [i, i + length) with length >= least."""
    at = np.flatnonzero(length >= least)
    step = np.bincount(at, minlength=len(length) + 1).astype(np.int64)
    step -= np.bincount(at + (length[at] if cap is None else cap), minlength=len(length) + 1)
    return np.cumsum(step)[:-1] > 0


def measure(text: pa.Array, min_repeat: int, max_covered: float, max_longest: float) -> list[pa.Array]:
    n = len(text)
    doc, code, words = whitespace_words(text)
    n_words = per_doc(doc, n)
    chars = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    word_chars = per_doc(doc, n, chars[code]).astype(np.int64) if len(code) else n_words

    data, off = flat(text)
    count = np.r_[0, np.cumsum(SYMBOLS[data], dtype=np.int64)]
    n_symbols = count[off[1:]] - count[off[:-1]]

    line_doc, line, lines = lines_of(text)
    real = (pc.binary_length(pc.ascii_trim_whitespace(lines)).to_numpy(zero_copy_only=False) > 0)[line]
    line_doc, line = line_doc[real], line[real]
    distinct = np.unique(line_doc * (len(lines) + 1) + line) // (len(lines) + 1)
    n_dup = per_doc(line_doc, n) - per_doc(distinct, n)

    length = repeat_lengths(doc, code)
    n_repeat = per_doc(doc[_covered(length, BASE_WINDOW, BASE_WINDOW)], n)
    n_covered = per_doc(doc[_covered(length, min_repeat)], n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc, length)
    left = np.r_[False, (doc[1:] == doc[:-1]) & (length[:-1] == length[1:] + 1)] if len(length) else np.zeros(0, bool)
    n_repeats = per_doc(doc[(length >= min_repeat) & ~left], n)

    base_failed = (n_words < 20) | (100 * n_repeat > 30 * n_words)
    kept = ~base_failed & (n_covered <= max_covered * n_words) & (longest <= np.maximum(max_longest * n_words, min_repeat))
    return [pa.array(x, pa.int64()) for x in (n_words, word_chars, n_symbols, n_dup, n_repeat, n_covered, longest, n_repeats)] + [
        pa.array(base_failed), pa.array(kept)]


def quality_rules(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",),
                  min_repeat: int = 5, max_covered: float = 0.3, max_longest: float = 0.2) -> DataFrame:
    """Repetition figures and the verdict ``kept``, one row per input row.

    A maximal repeated substring counts from ``min_repeat`` words. Rejected are texts of
    under 20 words, texts of which over 30 % of the words stand in repeated 8-word
    windows, texts covered by repeats beyond ``max_covered``, and texts whose longest repeat
    exceeds ``max_longest`` of their words.

    Null and empty texts have 0 words and are rejected. Repeated rows are measured each for
    itself; a null in any carried column is passed on; one text is held whole in memory.
    """
    return map_text(docs, text, list(carry), FIELDS,
                    lambda t: measure(t, min_repeat, max_covered, max_longest))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))
