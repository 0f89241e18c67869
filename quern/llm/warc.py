"""WARC archives: a writer of one gzip member a record, and a salvage reader.

The writer puts a record for each page into archives in a folder that all executors share, one archive
a task, under a fresh name for each attempt: only archives that a finished task reports are read.

The reader walks an archive's gzip members (of one record or many) and plain records. A member is
inflated step by step and its records are given out as they pass. Each record is checked: version line,
headers, length, the closing blank lines, the block's and the payload's digest. After a failed check the
reader searches the inflated bytes for the next version line at which a record passes all checks. Where
inflating itself fails or the member is cut, what was inflated before is kept, and the search goes on in
the file for the next gzip magic or version line. The bytes between are logged as quarantined gaps, in
the file or within a member. An archive is one task's work; its memory is bounded by the largest record,
not by the member or the archive: a length is believed only if the blank lines stand where it ends, which
is looked up without keeping the bytes before.

Defined results: null html counts as empty; null urls leave the header out; null page_ids are kept as
null and revisit the smallest page_id that has their payload, if there is one; rows with the same page_id
and payload are records of their own and of one kind; records written and not read back are an error.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.work import new_path, save

LEAST_SHARED = 100
LEVEL, BLOCK = 3, 1 << 16
VERSION = regex.compile(rb"WARC/\d+\.\d+\r\n")
START = regex.compile(rb"\x1f\x8b\x08|WARC/\d+\.\d+\r\n")


class Damaged(Exception):
    """A check failed."""


# ---- writing


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()), ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _safe(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        *([("WARC-Target-URI", _safe(url))] if url is not None else []),
        *([("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")] if revisit else []),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    return record(headers, http if revisit else http + payload)


def classify(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """Adds digest and refers_to: of equal payloads of at least ``least`` bytes all but those of the smallest page_id refer to it."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    shared = p.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    shared = shared.where("n > 1").select("digest", "first")
    later = F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))
    return p.join(shared, "digest", "left").select("page_id", "url", "html", "digest", F.when(later, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the records of ``classify(pages)`` into ``folder``; path, records, bytes of each archive. Runs at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(folder)
        name, out, n, size = f"pages-{uuid.uuid4().hex}.warc.gz", None, 0, 0
        try:
            for b in batches:
                for row in zip(*b.columns, strict=True):
                    page_id, url, html, digest, refers_to = (x.as_py() for x in row)
                    if out is None:
                        fs.create_dir(base, recursive=True)
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    member = gzip.compress(page_record(page_id, url, html.encode(), digest, refers_to, refers_to is not None), LEVEL, mtime=0)
                    out.write(member)
                    n, size = n + 1, size + len(member)
        finally:
            if out is not None:
                out.close()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

    return save(classify(pages).mapInArrow(run, "path string, records bigint, bytes bigint"), "archives")


# ---- reading


class Source:
    """Random reads of a file through a small window."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def read(self, at: int, n: int) -> bytes:
        if not self.at <= at or at + n > self.at + len(self.data):
            want = min(max(n, BLOCK), self.size - at)
            if want <= 0:
                return b""
            self.at, self.data = at, self.file.read_at(want, at)
        return self.data[at - self.at : at - self.at + n]

    peek = read


class Member:
    """The inflated bytes of the gzip member at ``start``, read forwards: what lies before ``drop`` is gone."""

    def __init__(self, source: Source, start: int):
        self.source, self.start = source, start
        self.z, self.raw = zlib.decompressobj(31), start
        self.at, self.data = 0, bytearray()
        #: why the bytes end before the member does; None for a sound member
        self.fault: str | None = None

    def _inflate(self, z, raw: int) -> tuple[object, int, bytes, str | None]:
        """Inflates one step on: state and place in the file after it, the bytes, and a fault if that is the end of them."""
        feed, before = self.source.read(raw, BLOCK), z.copy()
        try:
            out = z.decompress(feed, BLOCK)
        except zlib.error as e:
            # byte by byte, to keep all that precedes the fault
            out, i = bytearray(), 0
            for i in range(len(feed)):
                try:
                    out += before.decompress(feed[i : i + 1])
                except zlib.error:
                    break
            return before, raw + i, bytes(out), f"gzip: {e}"
        used = len(feed) - len(z.unused_data if z.eof else z.unconsumed_tail)
        return z, raw + used, out, None if feed or out or z.eof else "member cut short"

    def read(self, at: int, n: int) -> bytes:
        while self.at + len(self.data) < at + n and not (self.z.eof or self.fault):
            self.z, self.raw, out, self.fault = self._inflate(self.z, self.raw)
            self.data += out
        return bytes(self.data[at - self.at : at - self.at + n])

    def peek(self, at: int, n: int) -> bytes:
        """The same without keeping what lies between."""
        if self.z.eof or self.fault or at + n <= self.at + len(self.data):
            return self.read(at, n)
        z, raw, fault = self.z.copy(), self.raw, self.fault
        end, tail = self.at + len(self.data), bytes(self.data[-n:])
        while end < at + n and not (z.eof or fault):
            z, raw, out, fault = self._inflate(z, raw)
            end, tail = end + len(out), (tail + out)[-n - len(out) :]
        first = at - (end - len(tail))
        return tail[first : first + n] if 0 <= first else b""

    def drop(self, before: int) -> None:
        gone = min(before - self.at, len(self.data))
        del self.data[:gone]
        self.at += gone


def check_digest(value: str | None, data: bytes, what: str) -> None:
    """sha256 and sha1, in hexadecimal; other algorithms pass."""
    kind, _, digest = (value or "").partition(":")
    if kind in ("sha256", "sha1") and len(digest) == hashlib.new(kind).digest_size * 2 and hashlib.new(kind, data).hexdigest() != digest.lower():
        raise Damaged(f"{what} digest differs")


def parse(source: Source | Member, at: int) -> tuple[dict[str, str], bytes, int]:
    """The record at ``at``: headers (names in lower case), payload, end."""
    start = source.read(at, 16)
    if not (m := VERSION.match(start)):
        raise Damaged("no version line")
    n = 4096
    while (end := (head := source.read(at, n)).find(b"\r\n\r\n")) < 0:
        if len(head) < n:
            raise Damaged("no end of headers")
        n *= 4
    headers = {}
    for line in head[m.end() : end].split(b"\r\n"):
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise Damaged("bad header line")
        headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        raise Damaged("no content length")
    body = at + end + 4
    if source.peek(body + int(length), 4) != b"\r\n\r\n":
        raise Damaged("cut short, or no blank lines after the block")
    block = source.read(body, int(length))
    check_digest(headers.get("warc-block-digest"), block, "block")
    payload = block
    if headers.get("content-type", "").startswith("application/http"):
        http, blank, payload = block.partition(b"\r\n\r\n")
        if not blank:
            raise Damaged("no end of HTTP headers")
        for line in http.lower().split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            if name == b"content-length" and value.strip().isdigit():
                headers["http-length"] = value.strip().decode()
        if headers.get("warc-type") != "revisit" and int(headers.get("http-length", len(payload))) != len(payload):
            raise Damaged("payload's length differs")
    if headers.get("warc-type") != "revisit":
        check_digest(headers.get("warc-payload-digest"), payload, "payload")
    return headers, payload, body + len(block) + 4


class _Memory:
    """Bytes as a file."""

    def __init__(self, data: bytes):
        self.data = data

    def read_at(self, n: int, at: int) -> bytes:
        return self.data[at : at + n]


def walk(source: Member) -> Iterator[tuple]:
    """("record", start, end, headers, payload) and ("gap", start, end, reason), by inflated places."""
    here = 0
    while source.read(here, 1):
        try:
            headers, payload, end = parse(source, here)
        except Damaged as e:
            end = _next_record(source, here + 1)
            yield "gap", here, end, str(e)
        else:
            yield "record", here, end, headers, payload
        here = end
        source.drop(here)


def _next_record(source: Member, at: int) -> int:
    """Of inflated bytes the next version line from which a record passes, or the end."""
    while data := source.read(at, BLOCK):
        m = VERSION.search(data)
        if m:
            at += m.start()
            try:
                parse(source, at)
                return at
            except Damaged:
                at += 1
        elif len(data) < BLOCK:
            return at + len(data)
        else:
            at += len(data) - 16
        source.drop(at)
    return at


def _next_start(source: Source, at: int, known: set) -> int:
    """Of a file the next gzip magic or version line from which a record passes that isn't ``known``, or the end."""
    while at < source.size:
        data = source.read(at, BLOCK)
        m = START.search(data)
        if not m:
            at += len(data) if at + len(data) >= source.size else max(1, len(data) - 16)
            continue
        at += m.start()
        if m[0][:1] == b"\x1f":
            if source.read(at, 3) and any(kind == "record" for kind, *_ in walk(Member(source, at))):
                return at
            at += 1
        else:
            try:
                headers, payload, end = parse(source, at)
            except Damaged:
                at += 1
            else:
                if _name(headers, payload) not in known:
                    return at
                at = end
    return source.size


def _name(headers: dict[str, str], payload: bytes) -> bytes:
    return hashlib.sha256(repr(sorted(headers.items())).encode() + payload).digest()


def salvage(source: Source) -> Iterator[tuple]:
    """("record", start, end, inner, headers, payload) and ("gap", start, end, inner, reason) in the order of the file.

    start, end: places in the file, for a record in a gzip member the member's start and how far it was read;
    inner: for a gzip member the place in the inflated bytes, for a gap all from there on or up to the next record.
    """
    at = 0
    while at < source.size:
        if source.read(at, 2) != b"\x1f\x8b":
            try:
                headers, payload, end = parse(source, at)
            except Damaged as e:
                end = _next_start(source, at + 1, set())
                yield "gap", at, end, None, str(e)
            else:
                yield "record", at, end, None, headers, payload
            at = end
            continue
        m, known, lost, last = Member(source, at), set(), None, 0
        for kind, start, end, *what in walk(m):
            if kind == "gap":
                lost = start, what[0]
                continue
            if lost:
                yield "gap", at, m.raw, *lost
                lost = None
            known.add(_name(*what))
            last = end
            yield "record", at, m.raw, start, *what
        if known and not m.fault:
            if lost:
                yield "gap", at, m.raw, *lost
            at = m.raw
            continue
        # a stored block of a broken member shows its records in the file as well: those given out are known
        end = _next_start(source, at + 1 if m.fault else m.raw, known)
        yield "gap", at, end, last if known else None, m.fault or (lost[1] if lost else "member without a record")
        at = end


READ = "kind string, path string, start bigint, end bigint, inner bigint, reason string, headers map<string,string>, payload binary"


def read(paths: DataFrame) -> DataFrame:
    """``paths``: column path → a row for each record (kind 'record') and each gap (kind 'gap'), as READ has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.string()), ("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("inner", pa.int64()), ("reason", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = pa.fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with fs.open_input_file(at) as f:
                    for kind, start, end, inner, what, *payload in salvage(Source(f, f.size())):
                        rows.append((kind, path, start, end, inner, *((None, list(what.items()), payload[0]) if payload else (what, None, None))))
                        size += len(payload[0]) if payload else 0
                        if size > 8_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return paths.select("path").mapInArrow(run, READ)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as read back from the archives.

    Raises, with the quarantined gaps, where an archive gives back other than the records written to it.
    """
    archives = write(pages, new_path(spark, "warc"))
    h = lambda name: F.col("headers")[name]
    page = lambda name: F.nullif(F.regexp_extract(h(name), "<urn:page:(-?[0-9]*)>", 1), F.lit("")).cast("long")
    back = read(archives.select("path").repartition(max(1, archives.count()))).select(
        "kind",
        "path",
        F.when(F.col("kind") == "gap", F.concat_ws(" ", "start", "end", "inner", "reason")).alias("gap"),
        page("warc-record-id").alias("page_id"),
        F.coalesce(h("http-length").cast("long"), F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.substring_index(h("warc-payload-digest"), ":", -1).alias("payload_digest"),
        h("warc-type").alias("record_type"),
        F.when(h("warc-type") == "revisit", page("warc-refers-to")).alias("refers_to"),
    )
    back = save(back, "read")
    found = back.groupBy("path").agg(F.count_if(F.col("kind") == "record").alias("found"), F.min("gap").alias("gap"))
    wrong = archives.join(found, "path", "left").where("found IS NULL OR found <> records OR gap IS NOT NULL")
    if lost := wrong.select("path", "records", "found", "gap").head(20):
        raise ValueError(f"records written and read back differ: {lost}")
    return back.where("kind = 'record'").drop("kind", "path", "gap")


#: DuckDB SQL for the columns of the query.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, sha256(t) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d),
r AS (SELECT *, payload_bytes >= 100 AND first IS NOT NULL AND (page_id IS NULL OR page_id > first) AS again FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM r
"""
