"""Importance resampling against a brute-force version."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

from hypothesis import given, settings
from hypothesis import strategies as st

from llm_helpers import EDGE, MEDIUM, ascii_lower, make, sentence
from tidewise.llm import importance as R
from tidewise.llm.common import read

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, buckets=10_000):
    w = WORD.findall(ascii_lower(text))
    return len(w), sorted(crc32(" ".join(w[i:i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(w) - n + 1))


def brute(docs, target, share=(5, 100), min_words=20):
    """Sorted (doc_id, n_features, weight, score, rank) of (doc_id, text) rows."""
    k = 10_000
    s = Counter(b for _, t in docs for b in grams(t)[1])
    t = Counter(b for x in target for b in grams(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(float((t[b] + 1) * (s_all + k)) / float((s[b] + 1) * (t_all + k)))) for b in range(k)]
    rows = []
    for d, x in docs:
        n, f = grams(x)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= min_words))
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    last = share[0] * len(order) // share[1]
    out = [(*r[:4], i + 1 if i < last else None) for i, r in enumerate(order)] + [(*r[:4], None) for r in rows if not r[4]]
    return sorted(out, key=repr)


def plain(df):
    return sorted([tuple(r)[:5] for r in df.collect()], key=repr)


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.none(), st.text(alphabet="aB1 .,é漢\n", max_size=40), st.text(max_size=30)))
def test_spans_are_all_ngrams(text):
    text = text.encode("utf-8", "ignore").decode() if text is not None else None
    n, found = R.ngram_buckets(text)
    assert (n, found.tolist()) == grams(text)
    assert R._unpack(R._pack(found)).tolist() == found.tolist()


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in read(spark, MEDIUM, "documents").select("doc_id", "text").collect()]
    target = [r.text for r in read(spark, MEDIUM, "benchmark").collect()]
    df = R.op13_importance_resampling(spark, MEDIUM)
    assert df.columns[:5] == ["doc_id", "n_features", "weight", "score", "rank"]
    assert plain(df) == brute(docs, target)


def test_edge_rows_ties_and_clashing_columns(spark, edge):
    rows = [r[:2] for r in EDGE]
    target = [sentence(10, 30), None, ""]
    goal = make(spark, list(enumerate(target)), weight="w")
    for share in ((5, 100), (100, 100)):
        got = R.importance_resampling(edge, goal, share=share)
        assert plain(got) == brute(rows, target, share=share)
    ranks = [r.rank for r in got.orderBy("rank").collect() if r.rank is not None]
    assert ranks == list(range(1, len(ranks) + 1))


def test_empty_tables(spark, empty):
    assert R.importance_resampling(empty, empty).collect() == []
    rows = [(i, sentence(i, 25)) for i in range(40)]
    assert plain(R.importance_resampling(make(spark, rows), empty)) == brute(rows, [])


def test_target_like_documents_are_drawn(spark):
    rows = [(i, sentence(i, 60)) for i in range(200)]
    target = [x for _, x in rows[:5]]
    drawn = {r.doc_id for r in R.importance_resampling(make(spark, rows), make(spark, list(enumerate(target)))).collect() if r.rank}
    assert len(drawn) == 10 and {0, 1, 2, 3, 4} <= drawn
