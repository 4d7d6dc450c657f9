"""Quality rules, decontamination and SimHash against brute force."""

import hashlib
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_helpers import EDGE, MEDIUM, ascii_lower, make, read_texts, sentence
from tidewise.llm import decontaminate as D
from tidewise.llm import quality_rules as Q
from tidewise.llm import simhash as S
from tidewise.llm.common import read

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_rules(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered (5), longest repeat."""
    text = text or ""
    w = WORD.findall(text)

    def starts(n):
        c = Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
        return [i for i in range(len(w) - n + 1) if c[tuple(w[i:i + n])] > 1]

    cover = [len({k for i in starts(n) for k in range(i, i + n)}) for n in (8, 5)]
    longest = next((n - 1 for n in range(1, len(w) + 2) if not starts(n)), 0)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), cover[0], cover[1], longest)


def measured(texts):
    cols = Q.measure(pa.array(texts, pa.string()), 5, 0.3, 0.2)
    return list(zip(*[cols[i].to_pylist() for i in (0, 1, 2, 3, 4, 5, 6)], strict=True))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n", max_size=60), st.text(max_size=30)), min_size=1, max_size=6))
def test_rules_random_texts(texts):
    texts = [t.encode("utf-8", "ignore").decode() if t is not None else None for t in texts]
    assert measured(texts) == [brute_rules(t) for t in texts]


def test_rules_documents(spark):
    texts = read_texts(spark, MEDIUM)
    got = {r.doc_id: tuple(r)[1:6] for r in Q.op9_quality_rules(spark, MEDIUM).collect()}
    assert got == {k: brute_rules(v)[:5] for k, v in texts.items()}


def test_rules_verdicts(spark):
    clean = sentence(1, 200)
    rows = [(1, clean), (2, "one two three"), (3, " ".join([sentence(3, 10)] * 20)), (4, sentence(4, 300) + "\n" + " ".join(sentence(5, 90).split()[:90]))]
    got = {r.doc_id: r for r in Q.quality_rules(make(spark, rows)).collect()}
    assert got[1].kept and got[4].kept and not got[1].base_failed
    assert got[2].base_failed and not got[2].kept
    assert got[3].base_failed and got[3].n_covered_words == 200 and got[3].longest_repeat == 190
    half = sentence(6, 100)
    moved = {r.doc_id: r for r in Q.quality_rules(make(spark, [(1, sentence(7, 300) + " " + half + " " + sentence(8, 10) + " " + half)])).collect()}
    assert moved[1].longest_repeat == 100 and moved[1].n_repeats == 2


def test_rules_edges(edge, empty):
    rows = Q.quality_rules(edge).collect()
    assert len(rows) == len(EDGE)
    by = [(r.doc_id, r.n_words, r.kept) for r in rows]
    assert (1, 0, False) in by and (None, 0, False) in by and by.count((10, 60, True)) == 2
    assert Q.quality_rules(empty).count() == 0


BWORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(texts, items):
    pattern = {}
    for i, t in items:
        w = BWORD.findall(ascii_lower(t))
        m = min(13, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            pattern.setdefault(tuple(w[k:k + m]), set()).add(i)
    lengths = {len(p) for p in pattern}
    out = {}
    for d, t in texts.items():
        w = BWORD.findall(ascii_lower(t))
        hit, own = set(), set()
        for m in lengths:
            for k in range(len(w) - m + 1):
                if tuple(w[k:k + m]) in pattern:
                    hit.update(range(k, k + m))
                    own |= pattern[tuple(w[k:k + m])]
        ids = ",".join(sorted(str(i) for i in own if i is not None))
        out[d] = (len(w), len(hit), len([i for i in own if i is not None]), hashlib.sha256(ids.encode()).hexdigest(),
                  len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def test_decontaminate_documents(spark):
    items = [tuple(r) for r in read(spark, MEDIUM, "benchmark").select("item_id", "text").collect()]
    got = {r.doc_id: tuple(r)[1:6] for r in D.op2_decontaminate(spark, MEDIUM).collect()}
    assert got == brute_hits(read_texts(spark, MEDIUM), items)
    assert sum(v[4] for v in got.values()) > 0


def test_decontaminate_edges_and_blocks(spark, edge, monkeypatch):
    items = [(1, "a b"), (2, "Word"), (3, None), (4, "!!!"), (5, sentence(10, 20)), (5, sentence(10, 20)), (None, "текст"),
             (6, " ".join(sentence(7, 20_000).split()[-13:])), (7, "b a b a b a b a b a b a b a"), (8, "漢字 Ünïcode")]
    table = spark.createDataFrame(items, "item_id long, text string")
    out = D.decontaminate(edge, table)
    got = sorted(map(str, (tuple(r) for r in out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())))
    texts = dict(enumerate(t for _, t in EDGE))
    brute = brute_hits(texts, items)
    assert got == sorted(str((EDGE[k][0], *v)) for k, v in brute.items())
    monkeypatch.setattr(D, "ITEM_BLOCK_BYTES", 60)  # many blocks of items
    again = D.decontaminate(edge, table).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted(map(str, (tuple(r) for r in again.collect()))) == got


def test_long_items_are_cut_into_pieces(spark, monkeypatch):
    """A long item in pieces, pieces in several blocks: the same windows, none more."""
    monkeypatch.setattr(D, "PIECE_BYTES", 300)
    long = sentence(1, 400).title().replace(" ", " — ")
    items = [(1, long), (2, sentence(2, 13)), (3, "word " * 200), (4, "ONE " + "y" * 2000 + " " + sentence(4, 30)), (5, sentence(5, 12))]
    table = spark.createDataFrame(items, "item_id long, text string")
    pieces = [r for b in D._pieces([pa.RecordBatch.from_arrays([pa.array([str(i) for i, _ in items]), pa.array([t for _, t in items])], names=["i", "t"])])
              for r in b.to_pylist()]
    assert len(pieces) > 20 and all(len(r["t"].encode()) < 2600 for r in pieces)
    words = sentence(1, 400).split()
    texts = {k: " ".join(words[k:k + 13 + k % 9]) + " end" for k in range(0, 387, 3)} | {
        1000: " ".join(words[:12]), 1001: sentence(2, 13), 1002: "word " * 12, 1003: "word " * 14, 1004: "one " + "y" * 2000 + " " + sentence(4, 11), 1005: sentence(5, 12)}
    want = brute_hits(texts, items)
    for block in (D.ITEM_BLOCK_BYTES, 900):
        monkeypatch.setattr(D, "ITEM_BLOCK_BYTES", block)
        got = {r.doc_id: tuple(r)[1:] for r in D.decontaminate(make(spark, list(texts.items())), table).select(
            "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()}
        assert got == want


def test_pattern_tables_are_small():
    """Two million characters of items take under 60 bytes of arrays each, at their peak too."""
    items = [(str(k), sentence(k, 3000)) for k in range(100)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    (p,) = D.build_patterns(items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size > 1_000_000 and peak < 60 * size + (64 << 20) and len(p.at) <= 100 * (3000 - 12)


def test_hashes_do_not_depend_on_their_stretch(monkeypatch):
    text = pa.array([sentence(3, 500), None, "é" * 50 + " x", sentence(4, 300)])
    whole = D.words_of(*D.flat(text))
    monkeypatch.setattr(D, "HASH_BYTES", 40)
    for a, b in zip(whole, D.words_of(*D.flat(text)), strict=True):
        assert (a == b).all()


def test_decontaminate_empty_tables(spark, empty, edge):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(empty, none).count() == 0
    rows = D.decontaminate(edge, none).collect()
    assert len(rows) == len(EDGE) and all(r.n_hit == 0 and not r.contaminated for r in rows)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "Cc", "é", "-"]), max_size=25), min_size=1, max_size=4),
       st.lists(st.lists(st.sampled_from(["a", "b", "cc", "é"]), max_size=16), max_size=5))
def test_search_random(docs, items):
    texts = {i: " ".join(d) for i, d in enumerate(docs)}
    pairs = [(str(i), " ".join(x)) for i, x in enumerate(items)]
    doc, hit, found = D.scan(pa.array(list(texts.values()), pa.string()), D.build_patterns(pairs))
    want = brute_hits(texts, pairs)
    assert np.bincount(doc[hit], minlength=len(texts)).tolist() == [want[i][1] for i in texts]
    assert [len(found.get(i, ())) for i in texts] == [want[i][2] for i in texts]


def brute_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, bits=3):
    """Smallest number of the component of each fingerprint, from all pairs."""
    u = np.array(sorted(set(fps)), np.uint64)
    parent = list(range(len(u)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1:] ^ u[i]) <= bits):
            a, b = find(i), find(i + 1 + int(j))
            parent[max(a, b)] = min(a, b)
    return {int(x): find(i) for i, x in enumerate(u)}


def check_groups(rows, texts):
    fp = {k: brute_fingerprint(t) for k, t in texts.items()}
    root = brute_components(fp.values())
    least = {}
    for k, v in fp.items():
        least[root[v]] = min(least.get(root[v], k), k)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {k: (f"{v:016x}", least[root[v]]) for k, v in fp.items()}


def test_simhash_documents(spark):
    from llm_helpers import SMALL
    check_groups(S.op5_simhash_neardup(spark, SMALL).collect(), read_texts(spark, SMALL))


def test_simhash_edges(spark, edge, empty):
    rows = S.simhash_groups(edge).collect()
    assert len(rows) == len(EDGE)
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in zero} == {1, 2, 3, None} and {r.component_id for r in zero} == {1}
    assert {r.component_id for r in rows if r.doc_id in (10, 11)} == {10}
    assert S.simhash_groups(empty).count() == 0


def test_links_in_crowded_cells(spark, monkeypatch):
    """Dense groups of fingerprints: all links, each once, also where a cell is divided again and dealt out."""
    monkeypatch.setattr(S, "CELL", 3)
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 63, 4)]
    fps = sorted({b ^ sum(1 << int(i) for i in rng.choice(64 if k % 2 else 12, rng.integers(0, 5), replace=False)) for k, b in enumerate(base * 40)})
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    rows = S.links(spark.createDataFrame(signed, "fp long"), 3).collect()
    got = {tuple(sorted((a & (1 << 64) - 1, b & (1 << 64) - 1))) for a, b in rows}
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if (a ^ b).bit_count() <= 3}
    assert got == want and len(rows) == len(want)


def test_one_of_each_group(spark):
    a, b = sentence(1, 80), sentence(2, 80)
    rows = [(5, a), (3, a), (3, a), (4, b), (None, a), (9, sentence(9, 50))]
    kept = S.one_of_each_group(make(spark, rows)).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["3", "4", "9", "None"]


def test_components_of_a_long_path(spark):
    from tidewise.llm.graph import components
    n = 40
    path = spark.createDataFrame([(i * 7 % 41, (i + 1) * 7 % 41) for i in range(n)] + [(100, 101), (101, 101), (200, 200)], "a long, b long")
    got = {r.node: r.root for r in components(path, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
