"""Substring dedup against all windows."""

import hashlib
import random
import re

import pytest

from llm_helpers import EDGE, SMALL, make, read_texts, sentence
from tidewise.llm import substring_dedup as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=13):
    """Sorted (doc_id, n_words, n_removed, spans, hash of the words left) of (doc_id, text) rows."""
    words = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - window + 1) if d is not None else ():
            key = tuple(w[i:i + window])
            first[key] = min(first.get(key, d), d)
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1) if d is not None else ():
            if first[tuple(w[i:i + window])] < d:
                gone.update(range(i, i + window))
        spans = [(a, next(n for n in range(a, len(w) + 1) if n not in gone) - a) for a in sorted(gone) if a - 1 not in gone]
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), spans, hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=repr)


def plain(df):
    rows = df.collect()
    for r in rows:
        if r.kept_text is not None:
            assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
        else:
            assert r.n_removed == 0
    return sorted([(r.doc_id, r.n_words, r.n_removed, [tuple(s) for s in r.spans], r.kept_sha256) for r in rows], key=repr)


@pytest.mark.parametrize("window", [13, 6, 1])
def test_random_corpora(spark, window):
    rng = random.Random(window)
    pool = [sentence(i, 40).split() for i in range(6)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randrange(5)):
            source, lo = rng.choice(pool), rng.randrange(30)
            words += source[lo:lo + rng.randrange(1, 40)] if rng.random() < 0.7 else sentence(rng.randrange(10 ** 6), rng.randrange(12)).split()
        rows.append((rng.randrange(100), rng.choice([" ", "\n", "\t "]).join(words)))  # some doc_ids are shared
    rows += [(200 + i, "a b a b " * (3 + i)) for i in range(8)] + [(300 + i, "the " * (11 + i)) for i in range(5)]
    assert plain(S.substring_dedup(make(spark, rows).repartition(7), window=window)) == brute(rows, window)


def test_every_alignment_of_a_passage(spark):
    # a passage of 13 words at every offset of the block cut, found by its only whole block
    passage = sentence(5, 13)
    rows = [(i, " ".join(filter(None, [sentence(100 + i, i), passage, sentence(200 + i, 3)]))) for i in range(16)]
    got = {r.doc_id: r for r in S.substring_dedup(make(spark, rows)).collect()}
    assert got[0].n_removed == 0 and got[0].kept_text is None
    assert all([tuple(s) for s in got[i].spans] == [(i, 13)] for i in range(1, 16))
    # a passage of 12 words is none
    rows = [(i, f"{sentence(i, 4)} {sentence(5, 12)} x{i}") for i in range(9)]
    assert all(r.n_removed == 0 for r in S.substring_dedup(make(spark, rows)).collect())


def test_equal_block_with_other_neighbours_in_the_smallest_document(spark):
    # the smallest document has the block only, another smaller one has the whole window
    block, left, right = sentence(1, 7), sentence(2, 3), sentence(3, 3)
    rows = [(1, f"{block} {sentence(9, 10)}"), (2, f"{left} {block} {right} {sentence(8, 5)}"), (3, f"{sentence(7, 2)} {left} {block} {right}")]
    got = {r.doc_id: r for r in S.substring_dedup(make(spark, rows)).collect()}
    assert [got[i].n_removed for i in (1, 2, 3)] == [0, 0, 13]


def test_many_copies_and_a_frequent_passage(spark):
    passage = sentence(1, 20)
    rows = [(i, sentence(77, 50)) for i in range(300)] + [(1000 + i, f"{passage} {sentence(1000 + i, 5)}") for i in range(300)]
    got = S.substring_dedup(make(spark, rows).repartition(6))
    assert plain(got) == brute(rows)


def test_small_folds(spark, monkeypatch):
    table = S._Least
    monkeypatch.setattr(S, "FOLD", 2)
    t = table(S.np.dtype("<u4"))
    for doc, rest in (([5, 6, 7], [1, 2, 1]), ([3, 9], [1, 2]), ([2], [8])):
        t.add(S.np.array(doc), S.np.array(rest, "<u4"))
    t.fold()
    assert (t.rest.tolist(), t.doc.tolist(), t.most.tolist()) == ([1, 2, 8], [3, 6, 2], [7, 9, 2])


def test_query_documents(spark):
    texts = sorted(read_texts(spark, SMALL).items())
    got = {r.doc_id: tuple(r)[1:] for r in S.op11_substring_dedup(spark, SMALL).collect()}
    assert got == {r[0]: (r[1], r[2], r[4]) for r in brute(texts)}


def test_edge_rows_and_clashing_columns(spark, edge, empty):
    df = edge.withColumnRenamed("spans", "digest").withColumnRenamed("key", "entries")
    assert plain(S.substring_dedup(df)) == brute([r[:2] for r in EDGE])
    assert S.substring_dedup(empty).collect() == []
