"""Packing against the tokenizer itself."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from llm_helpers import EDGE, SMALL, make, read_texts, sentence
from tidewise.llm import packing as P

TOKENIZER = Tokenizer.from_file(P.tokenizer_path())


def direct(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [2]


def check_pieces(rows, texts):
    """texts: list of (doc_id, text) rows. Every id in one piece, sequences gapless and full."""
    want = sorted((str(d), tuple(direct(t))) for d, t in texts)
    docs = {}
    for r in rows:
        docs.setdefault((str(r.doc_id), r.doc_tokens), []).append(r)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert r.length > 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for r in pieces:
            assert r.offset == at
            at += r.length
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)
    total = sum(r.length for r in rows)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert len(by_sequence) == total // 4096 + bin(total % 4096).count("1")
    assert total == sum(len(t) for _, t in want)
    left = {}
    for d, ids in want:
        left.setdefault((d, len(ids)), []).append(ids)
    for key, pieces in docs.items():
        copies = left.pop(key)
        assert sum(r.length for r in pieces) == key[1] * len(copies)
        crcs = {(r.start, r.length, r.ids_crc32) for r in pieces}
        for start, length, crc in crcs:
            assert any(zlib.crc32(np.array(c[start:start + length], "<u4").tobytes()) == crc for c in copies)
        for c in copies:
            assert sum(1 for r in pieces if r.start == 0) == len(copies)
    assert not left


def test_pack_documents(spark):
    check_pieces(P.op3_hilbert_packing(spark, SMALL).collect(), list(read_texts(spark, SMALL).items()))


def test_pack_edges(spark, edge, empty):
    out = P.pack(edge, P.tokenizer_path())
    rows = out.collect()
    check_pieces(rows, EDGE)
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    assert P.pack(empty, P.tokenizer_path()).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="aB'sé ,.!<|>\n1", max_size=40),
                          st.sampled_from(["<|endoftext|>", "x<|startoftext|>y", "it's we'll", "İstanbul ǅ ß", "é ,́"])),
                min_size=1, max_size=4))
def test_words_encode_as_texts(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, off = P._encoder(P.tokenizer_path()).encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:], strict=False)] == [direct(t)[:-1] for t in texts]


#: Letters whose normal or lower-case form ends in a mark (composition exclusions and a Turkish capital), and others.
LETTERS = list("İaZéÉßẞǅJHTWYhtw") + ["\u0958", "\u09dc", "\ufb1d", "\ufb2a", "\u0f43", "\u0a33", "\u2126", "\u212a", "e\u0301", "J\u030c",
                                       "H\u0331", "T\u0308", "W\u030a", "Y\u030a", "A\u02be", "\u1100\u1161", "漢", "Σ", "ς", "1", "²", "١"]
MARKS = [chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()] + ["\u0338", "\u0301", "«", "…", "’", "'s", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "|", " ", ""]


def encoded(texts):
    ids, off = P._encoder(P.tokenizer_path()).encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(off, off[1:], strict=False)]


def test_every_letter_before_every_mark():
    texts = [f"ab{a}{m}{b}" for a in LETTERS for m in MARKS for b in ("", "c", m)]
    want = [direct(t)[:-1] for t in texts]
    assert encoded(texts) == want  # one slice, special tokens among them
    assert [encoded([t])[0] for t in texts[::7]] == want[::7]  # each alone
    assert encoded([t + "." for t in ("YENİ", "SERİ, yeni", "क़", "ड़", "יִ", "שׁ-", "གྷ")]) == [direct(t + ".")[:-1] for t in ("YENİ", "SERİ, yeni", "क़", "ड़", "יִ", "שׁ-", "གྷ")]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from([*"".join(LETTERS), *"".join(MARKS), "\n", "\u00a0"]), max_size=14), min_size=1, max_size=4))
def test_mixed_scripts_encode_as_texts(texts):
    assert encoded(texts) == [direct(t)[:-1] for t in texts]


def test_full_word_table_stays_right(monkeypatch):
    monkeypatch.setattr(P, "KNOWN_WORDS", 5)
    enc = P.WordEncoder(P.tokenizer_path())
    for k in range(4):
        ids, off = enc.encode(pa.array([sentence(k, 30), sentence(0, 30)]))
        assert ids[off[0]:off[1]].tolist() == direct(sentence(k, 30))[:-1]
        assert ids[off[1]:off[2]].tolist() == direct(sentence(0, 30))[:-1]


@pytest.mark.parametrize("d,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_walks_to_neighbours(d, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d), -1).reshape(-1, d)
    key = P.hilbert_key(grid, bits)
    assert sorted(key) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_similar_documents_lie_close(spark):
    """Documents of two vocabularies do not mix along the curve."""
    rows = [(k, " ".join(("sea sand sun wave shore " if k % 2 else "tax law court judge clause ").split() * 20)) for k in range(40)]
    pieces = sorted(P.pack(make(spark, rows), P.tokenizer_path()).collect(), key=lambda r: (r.sequence_id, r.offset))
    kinds = [r.doc_id % 2 for r in pieces if r.start == 0]
    assert sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) == 1
