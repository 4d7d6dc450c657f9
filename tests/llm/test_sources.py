"""WARC round trip and line dedup against SQL and brute force."""

import base64
import gzip
import hashlib
import io
import re

import pytest
from pyspark.sql import types as T

from llm_helpers import EDGE, MEDIUM, SMALL, make, sentence
from oracle_harness import compare, duck
from tidewise.llm import line_dedup as L
from tidewise.llm import warc as W


@pytest.mark.parametrize("query,sql", [(W.op6_warc, W.OP6_SQL), (L.op7_line_dedup, L.OP7_SQL)])
def test_against_sql(spark, query, sql):
    r = compare(spark, MEDIUM, query(spark, MEDIUM), sql, duck(MEDIUM))
    assert r["cols_match"] and r["values_match"], r


A, B = "a" * 100, "é" * 50
PAGES = [(1, "http://h/x?q=1", A), (2, "http://h/y", A), (3, None, A), (4, "http://h/s p\r\nX: y%41", B), (5, "u", B), (6, "v", "a" * 99),
         (7, "w", "a" * 99), (8, "n", None), (9, "e", ""), (10, "http://[bad", "<html>\r\n\r\nWARC/1.1\r\n"), (11, "r", "dup" * 50),
         (11, "r", "dup" * 50), (None, "z", A), (None, "k", "only" * 40), (12, "l", "long " * 200_000)]


def test_warc_captures(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'x' as digest", "1 as part", "2 as n")
    rows = W.warc_round_trip(pages).collect()
    got = sorted(str((r.page_id, r.response.target_uri, r.response.type, r.refers_to)) for r in rows)
    first = {A: 1, B: 4, "dup" * 50: 11}

    def expected(page, url, html):
        orig = first.get(html)
        revisit = orig is not None and orig != page
        return str((page, url, "revisit" if revisit else "response", orig if revisit else None))

    assert got == sorted(expected(*p) for p in PAGES)
    for r in rows:
        assert len(r.requests) == 1 and len(r.metadata) == 1
        if r.response.type == "response":
            assert r.response.digest_ok and hashlib.sha256(r.response.payload).hexdigest() == r.response.payload_digest
            assert r.response.payload_bytes == len(r.response.payload)
    texts = {r.page_id: bytes(r.response.payload).decode() for r in rows if r.page_id in (4, 8, 10, 12)}
    assert texts == {4: B, 8: "", 10: PAGES[9][2], 12: PAGES[14][2]}
    assert {r.response.payload_bytes for r in rows if r.page_id in (2, 5)} == {100}


def test_warc_empty_table(spark):
    assert W.warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def records_of(data, chunk=1 << 18):
    return [W.parse(h, block, True) for h, block in W.raw_records(io.BytesIO(data), chunk)]


def own(body="body", page_id=5, **more):
    raw = body.encode()
    return W.transaction(page_id, "http://h/", W.DATE, len(raw), hashlib.sha256(raw).hexdigest(), raw, **more)[1]


@pytest.mark.parametrize("chunk", [1, 7, 1 << 18])
def test_plain_and_packed_archives_are_the_same_records(chunk):
    packed = own("a\r\n\r\nWARC/1.1\r\n") + own("")
    want = records_of(b"".join(packed))
    assert [r[1] for r in want] == ["response", "request", "metadata"] * 2
    plain = b"".join(gzip.decompress(p) for p in packed)
    for data in (b"".join(packed), plain, gzip.compress(plain)):
        assert records_of(data, chunk) == want
    assert records_of(b"") == []


def test_every_cut_is_an_error():
    packed = own("some payload " * 3)
    whole = b"".join(packed)
    ends, plain_ends, at, plain_at = set(), set(), 0, 0
    for p in packed:
        at, plain_at = at + len(p), plain_at + len(gzip.decompress(p))
        ends.add(at)
        plain_ends.add(plain_at)
    plain = gzip.decompress(whole)
    for data, sound in ((whole, ends), (plain, plain_ends), (gzip.compress(plain), {len(gzip.compress(plain))})):
        for n in range(1, len(data)):
            if n not in sound:
                with pytest.raises((W.Cut, ValueError)):
                    records_of(data[:n])
    with pytest.raises(ValueError, match="no WARC|not a WARC"):
        records_of(b"HTTP/1.1 200\r\n\r\n")
    with pytest.raises(ValueError, match="no length"):
        records_of(b"WARC/1.0\r\nWARC-Type: request\r\n\r\n")
    with pytest.raises(ValueError, match="does not end"):
        records_of(plain[:-4] + b"more")


def test_cut_archive_ends_the_job(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i} " * 50) for i in range(6)], "page_id long, url string, html string")
    manifest = W.write_archives(pages.coalesce(1)).collect()
    assert sum(m.n_records for m in manifest) == 18
    files, path = W._file_system(manifest[0].archive)
    with files.open_input_stream(path, compression=None) as f:
        data = f.read()
    ends = [i for i in range(len(data)) if data[i:i + 3] == b"\x1f\x8b\x08"]
    for n in (len(data) // 2, ends[3], len(data) - 1):  # inside a record, between records, in the last trailer
        (tmp_path / f"{n}.warc.gz").write_bytes(data[:n])
        cut = spark.createDataFrame([(f"{tmp_path}/{n}.warc.gz", manifest[0].n_records)], "archive string, n_records long")
        with pytest.raises(Exception, match="cut short|its manifest says"):
            W.read_archives(cut).collect()


def test_odd_urls_survive(spark):
    urls = ["http://ex\u2100mple.com", "http://[bad", "http://h:port/x?q#f", "//", "", "a b", "http://h?q=1", "%zz%41", "x://\u0000/\n"]
    pages = spark.createDataFrame([(i, u, "p") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: r.response.target_uri for r in W.warc_round_trip(pages).collect()}
    assert got == dict(enumerate(urls))


def foreign(kind, block, **headers):
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{kind}-{len(block)}>", "WARC-Date": "2021-05-05T00:00:00Z", **headers, "Content-Length": len(block)}
    return ("WARC/1.0\r\n" + "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    http = {"Content_Type": "application/http; msgtype=response"}
    body = b"hello world"
    sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhello\r\n6;x=1\r\n world\r\n0\r\n\r\n"
    data = [foreign("warcinfo", b"software: x\r\n"),
            foreign("response", b"HTTP/1.1 200 OK\r\n\r\n" + body, WARC_Record_ID="<r1>", WARC_Target_URI="<http://h/%41 b>", **http),
            foreign("response", b"HTTP/1.1 200 OK\r\nX: a\r\n b\r\n\r\n" + body, WARC_Record_ID="<r2>", WARC_Payload_Digest=f"sha1:{sha1}", **http),
            foreign("response", chunked, WARC_Record_ID="<r3>", WARC_Payload_Digest=f"sha1:{sha1.lower()}", **http),
            foreign("response", b"HTTP/1.1 200 OK\r\n\r\nother", WARC_Record_ID="<r4>", WARC_Payload_Digest=f"sha1:{sha1}", **http),
            foreign("response", b"1.2.3.4", WARC_Record_ID="<r5>", WARC_Payload_Digest="blake9:x", Content_Type="text/dns"),
            foreign("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", WARC_Record_ID="<v1>", WARC_Payload_Digest=f"sha1:{sha1}", **http),
            foreign("revisit", b"", WARC_Record_ID="<v2>", WARC_Refers_To="<r4>"),
            foreign("metadata", b"page-id: 7\r\n", WARC_Record_ID="<m2>", WARC_Concurrent_To="<r2>"),
            foreign("metadata", b"page-id: 9\r\n", WARC_Record_ID="<m4>", WARC_Concurrent_To="<r4>"),
            foreign("conversion", b"text", WARC_Record_ID="<c>", WARC_Refers_To="<r1>")]
    (tmp_path / "a.warc").write_bytes(b"".join(data))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b""))
    archives = spark.createDataFrame([(f"{tmp_path}/a.warc",), (f"{tmp_path}/b.warc.gz",)], "archive string")
    got = {r.capture_id: r for r in W.assemble(W.read_archives(archives), T.LongType()).collect()}
    assert set(got) == {"r1", "r2", "r3", "r4", "r5", "v1", "v2"}
    assert got["r1"].response.digest_ok is None and got["r1"].response.target_uri == "http://h/%41 b"
    assert [got[k].response.digest_ok for k in ("r2", "r3", "r4", "r5")] == [True, True, False, None]
    assert [bytes(got[k].response.payload) for k in ("r1", "r2", "r3")] == [body] * 3 and bytes(got["r5"].response.payload) == b"1.2.3.4"
    assert got["r1"].response.payload_digest == hashlib.sha256(body).hexdigest() and got["r1"].response.date.startswith("2021")
    assert got["v1"].refers_to == 7 and got["v2"].refers_to == 9
    assert got["v1"].response.payload_bytes is None and got["v1"].response.payload_digest is None


def test_revisits_name_their_record(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", A, f"2022-01-0{i}T00:00:00Z" if i != 2 else None) for i in range(1, 5)],
                                  "page_id long, url string, html string, taken string")
    records = {r.record_id: r for r in W.read_archives(W.write_archives(pages, date="taken")).collect()}
    revisits = [r for r in records.values() if r.type == "revisit"]
    assert len(revisits) == 3
    for r in revisits:
        assert records[r.refers_to_record].type == "response" and r.refers_to_uri == records[r.refers_to_record].target_uri == "http://h/1"
    assert {r.date for r in records.values()} == {"2022-01-01T00:00:00Z", W.DATE, "2022-01-03T00:00:00Z", "2022-01-04T00:00:00Z"}


def test_satellites_without_a_response(spark):
    base = dict.fromkeys(W.RECORD.names)
    rows = [{**base, "record_id": "a", "type": "request", "concurrent_to": "gone", "request_line": "GET /"},
            {**base, "record_id": "b", "type": "metadata", "concurrent_to": "c", "page_id": "7"},
            {**base, "record_id": "c", "type": "response", "payload_digest": "d", "payload_bytes": 1}]
    out = {r.capture_id: r for r in W.assemble(spark.createDataFrame([tuple(r.values()) for r in rows], W.RECORD), T.LongType()).collect()}
    assert out["gone"].response is None and len(out["gone"].requests) == 1
    assert out["c"].page_id == 7 and out["c"].requests == []


def brute_lines(rows, min_sites, long_words=L.LONG_WORDS, long_sites=L.LONG_SITES):
    """(text, n_lines, n_removed) of each row, from (doc_id, text, lang, source) rows."""
    def need(k):
        return long_sites if len(re.split("[ \t\r]+", k)) >= long_words else min_sites

    def key(x):
        return x.strip(" \t\r").lower()

    sites, docs = {}, {}
    for d, t, _, s in rows:
        for x in (t or "").split("\n") if t is not None else []:
            sites.setdefault(key(x), set()).add(s or "")
            docs.setdefault(key(x), set()).add(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in docs.items()}
    out = []
    for d, t, _, _ in rows:
        if t is None:
            out.append((d, None, 0, 0))
            continue
        lines = t.split("\n")
        kept = [x for x in lines if not key(x) or len(sites[key(x)]) < need(key(x)) or least[key(x)] == d]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(map(str, out))


def test_line_dedup_edges(spark, edge, empty):
    rows = [(d, t, "en", f"s{k % 7}") for k, (d, t) in enumerate(EDGE * 2)]
    rows += [(100 + k, f" Shared LINE\t\nown {k}\r\n\nshared line\nalmost {k % 4}", "en", f"s{k % 9}" if k else None) for k in range(12)]
    rows += [(None, "shared line", "en", "s1"), (101, "shared line\nown 1", "en", "s0")]
    df = make(spark, rows, n_lines="x", n_removed="y", h="z", site="q", line="l", n=1)
    got = sorted(str(tuple(r)) for r in L.line_dedup(df).select("doc_id", "text", "n_lines", "n_removed").collect())
    assert got == brute_lines(rows, L.MIN_SITES)
    assert any("own 1" in g and "hared" not in g for g in got)
    assert L.line_dedup(empty).count() == 0


@pytest.mark.parametrize("min_sites", [2, 40])
def test_line_dedup_thresholds(spark, min_sites):
    """Lines just below, at and above the threshold, and far above it."""
    rows, d = [], 0
    for n in (min_sites - 1, min_sites, min_sites + 1, 3 * min_sites):
        for s in range(n):
            d += 1
            rows.append((d, f"line of {n} sites\nown {d}", "en", f"site {s}"))
    got = sorted(str(tuple(r)) for r in L.line_dedup(make(spark, rows), min_sites=min_sites).select("doc_id", "text", "n_lines", "n_removed").collect())
    assert got == brute_lines(rows, min_sites)


def test_long_lines_have_their_own_threshold(spark):
    """Lines of 49, 50 and 51 words on one to five sites, and on two documents of one site."""
    rows, d = [], 0
    for words in (1, 49, 50, 51, 400):
        for n in (1, 2, 3, 4, 5):
            for s in range(n):
                d += 1
                rows.append((d, f"own {d}\n  {'  '.join(sentence(words * 10 + n, words).split())}\t\r", "en", f"site {s}"))
        for _ in range(2):
            d += 1
            rows.append((d, sentence(words, words), "en", "site 0"))
    got = sorted(str(tuple(r)) for r in L.line_dedup(make(spark, rows)).select("doc_id", "text", "n_lines", "n_removed").collect())
    assert got == brute_lines(rows, L.MIN_SITES) and sum(g.endswith(" 1)") for g in got) == 2 * 4 + 3 * (1 + 2 + 3 + 4)


def test_small_table_by_sql(spark):
    r = compare(spark, SMALL, L.op7_line_dedup(spark, SMALL), L.OP7_SQL, duck(SMALL))
    assert r["values_match"], r
