"""WARC archives: written from captures, read back and assembled into transactions.

The writer emits, for each capture, a response (or a revisit of an equal payload), its
request and its metadata record, each a gzip member of its own; the satellites name the
response in WARC-Concurrent-To, a revisit names it in WARC-Refers-To. Archives are files in the shared folder; a
task writes them under fresh names and returns a manifest, so files of a failed attempt are never read.

The reader parses each archive as a stream and the assembly joins request, response
and metadata through the concurrent-to identifiers into one nested row per capture. Archives of other
writers are read too: plain or packed, records in one member or many, other digests or none, chunked bodies.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewise.llm.common import look_up, read, saved
from tidewise.session import scratch_path

#: Smallest payload that a revisit may stand for.
MIN_REVISIT_BYTES = 100
#: An archive is closed once it has so many bytes.
ARCHIVE_BYTES = 32 << 20
LEVEL = 3
DATE = "2020-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Header of a record of ours whose URIs have escaped characters; others' URIs are taken as they are.
ESCAPED = "X-Escaped-URI"


def _file_system(uri: str):
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "", 1))


def _record(kind: str, record_id: str, date: str, content_type: str, block: bytes, headers: list[tuple[str, str]]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), *headers,
            ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(text.encode("utf-8") + block + b"\r\n\r\n") + packer.flush()


def _line(value: str) -> str:
    """A header value: control characters and % are escaped, so that no value ends its line."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or c == "%" else c for c in value)


def _unline(value: str) -> str:
    parts = value.split("%")
    return parts[0] + "".join(chr(int(p[:2], 16)) + p[2:] for p in parts[1:])


def _uris(**uris: str | None) -> list[tuple[str, str]]:
    """Headers of the URIs that are there."""
    there = [(f"WARC-{k.replace('_', '-')}", u) for k, u in uris.items() if u is not None]
    return [(k, _line(u)) for k, u in there] + ([(ESCAPED, "1")] if any(_line(u) != u for _, u in there) else [])


def _host_and_path(url: str | None) -> tuple[str, str]:
    """Host and request target; any text is taken, what has no host gets none."""
    rest = (url or "").partition("://")[2].partition("#")[0]
    at = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    return rest[:at], rest[at:] if rest[at:at + 1] == "/" else "/" + rest[at:]


def transaction(page_id, url, date: str, n_bytes: int, digest: str, body: bytes | None, original: dict | None = None) -> tuple[str, list[bytes]]:
    """Id of the response or revisit and the three records of one capture.

    With ``original`` (record_id, url) the capture is a revisit of that record, and ``body`` is not needed.
    """
    response, request, metadata = (f"urn:uuid:{uuid.uuid4()}" for _ in range(3))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    payload = [("WARC-Payload-Digest", f"sha256:{digest}")]
    if original is not None:
        first = _record("revisit", response, date, "application/http; msgtype=response", http,
                        [*_uris(Target_URI=url, Refers_To_Target_URI=original["url"]), *payload, ("WARC-Profile", REVISIT_PROFILE),
                         ("WARC-Refers-To", f"<{original['record_id']}>")])
    else:
        first = _record("response", response, date, "application/http; msgtype=response", http + body, [*_uris(Target_URI=url), *payload])
    host, target = _host_and_path(url)
    get = f"GET {_line(target)} HTTP/1.1\r\nHost: {_line(host)}\r\n\r\n"
    link = [*_uris(Target_URI=url), ("WARC-Concurrent-To", f"<{response}>")]
    return response, [first, _record("request", request, date, "application/http; msgtype=request", get.encode("utf-8"), link),
                      _record("metadata", metadata, date, "application/warc-fields", f"page-id: {json.dumps(page_id)}\r\n".encode(), link)]


MANIFEST = T.StructType([T.StructField("archive", T.StringType()), T.StructField("n_records", T.LongType()),
                         T.StructField("n_bytes", T.LongType())])


def _capture_fields(rows: DataFrame) -> list[T.StructField]:
    return [rows.schema["page_id"], T.StructField("url", T.StringType()), T.StructField("date", T.StringType()),
            T.StructField("payload_bytes", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("record_id", T.StringType())]


def _writer(folder: str, schema: T.StructType):
    """Writes captures; returns the archives (kind 0), the originals that others revisit (1) and, unwritten, the revisits
    whose original is not known yet (2)."""
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _file_system(folder)
        out, made = None, (0, 0)
        id_type = None

        def batch(rows: list[dict]) -> pa.RecordBatch:
            kinds = {"kind": pa.int32(), "page_id": id_type or pa.null(), "payload_bytes": pa.int64(), "n_records": pa.int64(), "n_bytes": pa.int64()}
            return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kinds.get(c, pa.string())) for c in names], names=names)

        def close() -> list[dict]:
            nonlocal out
            if out is None:
                return []
            name, stream = out
            stream.close()
            out = None
            return [{"kind": 0, "archive": name, "n_records": made[0], "n_bytes": made[1]}]

        for b in batches:
            id_type = b.schema.field("page_id").type
            found: list[dict] = []
            for row in b.to_pylist():
                body = row["html"].encode("utf-8") if row.get("html") is not None else None
                if "html" in row:
                    row["payload_bytes"], row["digest"] = len(body), hashlib.sha256(body).hexdigest()
                capture = {c: row[c] for c in ("page_id", "url", "date", "payload_bytes", "digest")}
                if row.get("is_revisit"):
                    found.append({"kind": 2, **capture})
                    continue
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    files.create_dir(base, recursive=True)
                    out, made = (f"{folder}/{name}", files.open_output_stream(f"{base}/{name}", compression=None)), (0, 0)
                original = {"record_id": row["original_id"], "url": row["original_url"]} if "html" not in row else None
                record_id, records = transaction(row["page_id"], row["url"], row["date"] or DATE, row["payload_bytes"], row["digest"], body, original)
                for r in records:
                    out[1].write(r)
                made = (made[0] + len(records), made[1] + sum(map(len, records)))
                if row.get("is_original"):
                    found.append({"kind": 1, **capture, "record_id": record_id})
                if made[1] >= ARCHIVE_BYTES:
                    found += close()
            if found:
                yield batch(found)
        last = close()
        if last:
            yield batch(last)

    return run


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
                   min_bytes: int = MIN_REVISIT_BYTES, date: str | None = None) -> DataFrame:
    """Write one transaction per row; returns the manifest (archive, n_records, n_bytes).

    Of the rows with an equal payload of at least ``min_bytes`` bytes, the one with the smallest
    page_id is the response; so is each other row with that id. Payloads that no row with an
    id has are all responses. A null html is an empty payload, a null url is left out. ``date`` names a column
    of ISO times of capture; without one, and for nulls, all captures have :data:`DATE`. The responses are written
    first, then the revisits, which name the record that they refer to. A record is held whole in memory.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"),
                        F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias("html"),
                        (F.col(f"`{date}`").cast("string") if date else F.lit(None).cast("string")).alias("date"))
    # 128 bits of the digest
    keyed = rows.withColumn("key", F.substring(F.unhex(F.sha2(F.col("html").cast("binary"), 256)), 1, 16))
    light = saved(keyed.filter(F.octet_length("html") >= min_bytes).groupBy("key").agg(
        F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first_id is not null"), "payloads")
    marked = look_up(keyed, "key", light, "n", "payloads").withColumns({
        "is_revisit": F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")),
        "is_original": F.coalesce(F.col("page_id") == F.col("first_id"), F.lit(False))})
    capture = _capture_fields(rows)
    out = T.StructType([T.StructField("kind", T.IntegerType()), *capture, *MANIFEST.fields])
    written = saved(marked.select("page_id", "url", "date", "html", "is_revisit", "is_original")
                    .mapInArrow(_writer(scratch_path(spark, "archives"), out), out), "responses")
    revisits = written.filter("kind = 2").select("page_id", "url", "date", "payload_bytes", "digest")
    # repeated rows of the smallest id are several responses: the revisits name one of them
    originals = saved(written.filter("kind = 1").groupBy("digest").agg(
        F.min("record_id").alias("original_id"), F.min_by("url", "record_id").alias("original_url")), "originals")
    wanted = saved(revisits.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).join(originals, "digest"), "revisited")
    more = look_up(revisits, "digest", wanted, "n", "originals").drop("n")
    more = saved(more.mapInArrow(_writer(scratch_path(spark, "revisits"), out), out), "revisits")
    return written.unionByName(more).filter("kind = 0").select(*MANIFEST.names)


RECORD = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("concurrent_to", T.StringType()), T.StructField("target_uri", T.StringType()),
    T.StructField("refers_to_uri", T.StringType()), T.StructField("refers_to_record", T.StringType()),
    T.StructField("page_id", T.StringType()), T.StructField("date", T.StringType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("stated_digest", T.StringType()), T.StructField("digest_ok", T.BooleanType()),
    T.StructField("request_line", T.StringType()), T.StructField("payload", T.BinaryType())])

CAPTURES = ("response", "resource", "revisit")


class Cut(ValueError):
    """An archive or a record ends too early."""


class _Unpacked:
    """Bytes of a plain or gzip stream, of one member or many; the end inside a member is an error."""

    def __init__(self, stream, chunk: int = 1 << 18):
        self.stream, self.chunk, self.buffer, self.ended = stream, chunk, bytearray(), False
        self.packed: bytes | None = None  # bytes after the end of a member
        self.member = None
        self.gzip: bool | None = None

    def _more(self) -> bool:
        """Add to the buffer; False at the end."""
        data = self.packed or self.stream.read(self.chunk)
        self.packed = None
        if self.gzip is None and data:
            while len(data) < 2 and (more := self.stream.read(1)):
                data += more
            self.gzip = data[:2] == b"\x1f\x8b"
        if not data:
            if self.member is not None:
                raise Cut("the archive is cut short inside a gzip member")
            return False
        if not self.gzip:
            self.buffer += data
            return True
        if self.member is None:
            self.member = zlib.decompressobj(31)
        self.buffer += self.member.decompress(data)
        if self.member.eof:
            self.packed, self.member = self.member.unused_data or None, None
        return True

    def until(self, mark: bytes, what: str) -> bytes | None:
        """Bytes before ``mark``, which is taken too; None at the end of the stream."""
        at = 0
        while (found := self.buffer.find(mark, at)) < 0:
            at = max(0, len(self.buffer) - len(mark))
            if not self._more():
                if self.buffer:
                    raise Cut(f"the archive is cut short inside {what}")
                return None
        out = bytes(self.buffer[:found])
        del self.buffer[:found + len(mark)]
        return out

    def exactly(self, n: int, what: str) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise Cut(f"{what} is cut short")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def raw_records(stream, chunk: int = 1 << 18) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a stream, one at a time; what is cut short or no WARC record is an error."""
    source = _Unpacked(stream, chunk)
    while (head := source.until(b"\r\n\r\n", "a record's header")) is not None:
        if not head.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        h = _fields(head)
        name = f"record {h.get('warc-record-id')}"
        if not h.get("content-length", "").isdigit():
            raise ValueError(f"{name} has no length")
        block = source.exactly(int(h["content-length"]), name)
        if source.exactly(4, name) != b"\r\n\r\n":
            raise ValueError(f"{name} does not end where its length says")
        yield h, block
    while source._more():  # an unfinished member without any byte of a record
        pass


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with a space continues the one before."""
    text = head.decode("utf-8", "replace").replace("\r\n ", " ").replace("\r\n\t", " ")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in text.split("\r\n")[1:]) if v}


def _dechunked(body: bytes) -> bytes:
    """The content of a chunked body; a body that is not well formed is returned as it is."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            n = int(body[at:end].partition(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            n = -1
        if n < 0 or end + 2 + n > len(body):
            return body
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2:end + 2 + n])
        at = end + 4 + n


def _digest_matches(stated: str, *contents: bytes) -> bool | None:
    """Whether the stated digest (hexadecimal or base32) is that of any of the contents; None for an unknown algorithm."""
    name, _, value = stated.partition(":")
    name = name.lower().replace("-", "")
    if name not in ("sha1", "sha256", "sha512", "md5"):
        return None
    for c in contents:
        d = hashlib.new(name, c).digest()
        if value.lower() == d.hex() or value.upper().rstrip("=") == base64.b32encode(d).decode().rstrip("="):
            return True
    return False


def parse(h: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    """One row of RECORD. ``payload_digest`` is the SHA-256 of the payload, computed anew (a revisit's: as stated, if it is
    a SHA-256); ``digest_ok`` compares the stated digest, null where there is none of a known kind."""
    kind, payload, n, digest, ok, page, line = h.get("warc-type", ""), None, None, None, None, None, None
    stated = h.get("warc-payload-digest")
    is_http = h.get("content-type", "").lower().startswith("application/http")
    if kind in CAPTURES:
        http, _, body = block.partition(b"\r\n\r\n") if is_http else (b"", b"", block)
        fields = _fields(http)
        if kind == "revisit":
            length = fields.get("content-length", "")
            n = int(length) if length.isdigit() else None
            name, _, value = (stated or "").partition(":")
            digest = value.lower() if name.lower() == "sha256" and len(value) == 64 else None
        else:
            payload = _dechunked(body) if "chunked" in fields.get("transfer-encoding", "").lower() else body
            n, digest = len(payload), hashlib.sha256(payload).hexdigest()
            ok = _digest_matches(stated, payload, *([body] if body is not payload else [])) if stated else None
    elif kind == "metadata":
        page = _fields(b"\r\n" + block).get("page-id")
    elif kind == "request":
        line = block.split(b"\r\n", 1)[0].decode("utf-8", "replace")
    read_uri = _unline if ESCAPED.lower() in h else str
    uri = {k: read_uri(h[k].strip("<>")) if k in h else None for k in ("warc-target-uri", "warc-refers-to-target-uri")}
    named = {k: h[k].strip("<>") if k in h else None for k in ("warc-record-id", "warc-concurrent-to", "warc-refers-to")}
    return (named["warc-record-id"], kind, named["warc-concurrent-to"], uri["warc-target-uri"], uri["warc-refers-to-target-uri"],
            named["warc-refers-to"], page, h.get("warc-date"), n, digest, stated, ok, line, payload if with_payload else None)


def _reader(with_payload: bool):
    types = {"payload_bytes": pa.int64(), "digest_ok": pa.bool_(), "payload": pa.binary()}

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types.get(c, pa.string())) for i, c in enumerate(RECORD.names)],
                                          names=RECORD.names)

    def run(batches):
        for b in batches:
            for archive, expected in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                files, path = _file_system(archive)
                with files.open_input_stream(path, compression=None) as stream:
                    rows, held, seen = [], 0, 0
                    for h, block in raw_records(stream):
                        rows.append(parse(h, block, with_payload))
                        seen += 1
                        held += 500 + (len(block) if with_payload else 0)
                        if held > 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)
                if expected is not None and seen != expected:
                    raise Cut(f"{archive} has {seen} records, its manifest says {expected}")

    return run


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives (archive, and n_records if the number is known).

    An archive or record that is cut short, one that has another number of records than its manifest says, and
    what is no WARC record, are errors. A missing payload digest, one of another kind and a missing length of a revisit
    give nulls. A record is held whole in memory.
    """
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = F.col("n_records").cast("long") if "n_records" in manifest.columns else F.lit(None).cast("long")
    return manifest.select("archive", count.alias("n_records")).repartition(n).mapInArrow(_reader(with_payload), RECORD)


def assemble(records: DataFrame, id_type: T.DataType) -> DataFrame:
    """One nested row per capture: its response, resource or revisit, its requests and metadata.

    Satellites join the record that they name in concurrent-to; a satellite whose
    response is missing makes a row without one. Records of other kinds (warcinfo, conversion) are no captures. The groups
    are single captures. A revisit's ``refers_to`` is the page_id of the record that it names in WARC-Refers-To; where it names
    none, the smallest page_id among the responses of its payload digest.
    """
    def some(kinds: tuple[str, ...], *names: str):
        return F.collect_list(F.when(F.col("type").isin(*kinds), F.struct(*names)))

    records = records.filter(F.col("type").isin(*CAPTURES, "request", "metadata"))
    captures = records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(
        some(CAPTURES, "record_id", "type", "target_uri", "refers_to_uri", "refers_to_record", "date", "payload_bytes", "payload_digest",
             "stated_digest", "digest_ok", "payload").alias("responses"),
        some(("request",), "record_id", "target_uri", "request_line").alias("requests"),
        some(("metadata",), "record_id", "page_id").alias("metadata"))
    page = F.get("metadata", F.lit(0))["page_id"]
    captures = captures.select(
        "capture_id", F.when(page != "null", F.from_json(F.concat(F.lit('{"v":'), page, F.lit("}")), T.StructType([T.StructField("v", id_type)]))["v"]).alias("page_id"),
        F.get("responses", F.lit(0)).alias("response"), "requests", "metadata")
    captures = saved(captures, "captures")
    r = "response."
    is_revisit = F.col(f"{r}type").eqNullSafe("revisit")
    by_digest = F.concat(F.lit("digest "), F.coalesce(f"{r}payload_digest", f"{r}stated_digest"))
    revisits = captures.filter(is_revisit).withColumn("original", F.coalesce(F.concat(F.lit("record "), F.col(f"{r}refers_to_record")), by_digest, F.lit("")))
    names = F.explode(F.array(F.concat(F.lit("record "), F.col(f"{r}record_id")), by_digest, F.concat(F.lit("digest "), F.col(f"{r}stated_digest"))))
    pages = captures.filter(F.col(f"{r}type").isin("response", "resource")).select(names.alias("original"), "page_id").groupBy("original").agg(
        F.min("page_id").alias("refers_to"))
    wanted = saved(revisits.groupBy("original").agg(F.count(F.lit(1)).alias("n")).join(pages, "original"), "revisited-pages")
    revisits = look_up(revisits, "original", wanted, "n", "revisited-pages").drop("original", "n")
    others = captures.filter(~is_revisit).withColumn("refers_to", F.lit(None).cast(id_type))
    return others.unionByName(revisits)


def warc_round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
                    min_bytes: int = MIN_REVISIT_BYTES, with_payload: bool = True, date: str | None = None) -> DataFrame:
    """Nested captures of ``pages`` after a round trip through WARC archives, one per row."""
    manifest = write_archives(pages, page_id, url, html, min_bytes, date)
    return assemble(read_archives(manifest, with_payload), pages.schema[page_id].dataType)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc_round_trip(read(spark, sf_dir, "pages"), with_payload=False)
    return out.select("page_id", "response.payload_bytes", "response.payload_digest", F.col("response.type").alias("record_type"),
                      "refers_to", F.col("response.target_uri").alias("url"), F.size("requests").alias("n_requests"), "response.digest_ok")


OP6_SQL = f"""
with p as (
  select page_id, url, coalesce(html, '') as html, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as first_id from p where n >= {MIN_REVISIT_BYTES} group by d)
select p.page_id, n as payload_bytes, p.d as payload_digest,
       case when f.first_id is null or f.first_id = p.page_id then 'response' else 'revisit' end as record_type,
       case when f.first_id <> p.page_id then f.first_id end as refers_to,
       url, 1 as n_requests, case when f.first_id is null or f.first_id = p.page_id then true end as digest_ok
from p left join f on p.d = f.d and p.n >= {MIN_REVISIT_BYTES}
"""
