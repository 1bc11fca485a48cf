"""WARC/1.1 archives with revisit records.

First every page is written as a ``response`` record and the archives are read
back.  Then the record headers alone are shuffled by payload digest: of equal
payloads the smallest page id stays a ``response``, the others become ``revisit``
records, which are joined with the headers of their originals.  Each raw archive
then gets the list of its revisits, and is written again, record by record, with
fresh headers; payloads are not shuffled.

An archive is gzip with one member to a record (a record over MEMBER bytes has
several), begins with a ``warcinfo`` record, and holds about ``file_bytes``.  It
is one row of a Spark text table, written by Spark's committer to any store.
Archives are read as streams: a task holds one compressed archive and a batch
of records.

Records are HTTP responses, so the payload is the body; a revisit has the HTTP
header alone, whose Content-Length is that of the original's payload.

Defined cases: a null payload is empty; a null url is written as
``about:blank`` and read as null; line breaks in a url are percent-encoded; a
row with a null page id gets a record and is the original only where no equal
payload has an id (revisits then refer to null); repeated rows give a record
each, of which one is the original and the others revisit it; an empty table
gives no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import time
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, small_batches, splittable

RECORD = "path string, record_id string, record_type string, page_id long, url string, date string, refers_to long, refers_to_id string, payload_bytes long, payload_digest string, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A gzip member holds less than 2**24 bytes, so that its last byte is zero: that is the separator of Spark's text writer.
MEMBER = 8 << 20
_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
_FIELDS = [(c.split()[0], _KINDS[c.split()[1]]) for c in RECORD.split(", ")]
_NO_URL = "about:blank"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(*parts) -> str:
    """A ``urn:uuid:`` that stands for the parts."""
    raw = hashlib.blake2b("\x1f".join(map(str, parts)).encode(), digest_size=16).digest()
    return f"urn:uuid:{uuid.UUID(bytes=raw, version=5)}"


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record; headers without a value are left out."""
    lines = "".join(f"{name}: {value}\r\n" for name, value in headers if value is not None)
    return b"WARC/1.1\r\n%bContent-Length: %d\r\n\r\n%b\r\n\r\n" % (lines.encode(), len(block), block)


def information(own: str, date: str) -> bytes:
    body = b"software: batchlog\r\nformat: WARC File Format 1.1\r\n"
    return record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{own}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], body)


def page_record(own: str, date: str, page_id: int | None, url: str | None, payload: bytes, digest: str, original: dict | None = None) -> bytes:
    """A response, or a revisit of ``original`` (page_id, record_id, url, date)."""
    target = lambda u: _NO_URL if u is None else u.replace("\r", "%0D").replace("\n", "%0A")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    headers = [
        ("WARC-Type", "response" if original is None else "revisit"), ("WARC-Record-ID", f"<{own}>"), ("WARC-Date", date), ("WARC-Target-URI", target(url)), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"), ("X-Page-Id", page_id),
    ]
    if original is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{original['record_id']}>"), ("WARC-Refers-To-Target-URI", target(original["url"])), ("WARC-Refers-To-Date", original["date"]), ("X-Refers-To-Page", original["page_id"])]
        payload = b""
    return record(headers, http + payload)


def members(raw: bytes, level: int) -> Iterator[bytes]:
    """A record as gzip members."""
    for at in range(0, len(raw), MEMBER):
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        yield z.compress(raw[at : at + MEMBER]) + z.flush()


class Stream:
    """The records of an archive, compressed or not, one at a time."""

    STEP = 1 << 14

    def __init__(self, content):
        self.content, self.at, self.held = memoryview(content), 0, bytearray()
        self.zipped = bytes(self.content[:2]) == b"\x1f\x8b"
        self.z = None

    def _more(self) -> bool:
        if self.at >= len(self.content):
            return False
        chunk = self.content[self.at : self.at + self.STEP]
        self.at += len(chunk)
        if self.zipped:
            self.z = self.z or zlib.decompressobj(31)
            self.held += self.z.decompress(chunk)
            if self.z.eof:
                self.at -= len(self.z.unused_data)
                self.z = None
        else:
            self.held += chunk
        return True

    def _find(self, what: bytes) -> int:
        begin = 0
        while (at := self.held.find(what, begin)) < 0:
            begin = max(0, len(self.held) - len(what))
            if not self._more():
                return -1
        return at

    def _take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("an archive ends within a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        """Headers (names in lower case) and block of each record."""
        while (at := self._find(b"\r\n\r\n")) >= 0:
            version, *lines = self._take(at + 4)[:-4].decode().split("\r\n")
            if not version.startswith("WARC/"):
                raise ValueError(f"not a record: {version[:40]!r}")
            headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
            yield headers, self._take(int(headers["content-length"]))
            self._take(4)


def page_of(headers: dict[str, str], block: bytes) -> dict:
    """What the record of a page says."""
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda x: None if x is None else int(x)
    urn = lambda x: None if x is None else x.strip("<>")
    url = headers["warc-target-uri"]
    return {
        "record_id": urn(headers["warc-record-id"]), "record_type": headers["warc-type"], "page_id": number(headers.get("x-page-id")), "url": None if url == _NO_URL else url, "date": headers["warc-date"],
        "refers_to": number(headers.get("x-refers-to-page")), "refers_to_id": urn(headers.get("warc-refers-to")), "payload_bytes": length, "payload_digest": headers["warc-payload-digest"].removeprefix("sha1:"), "payload": payload,
    }


def pages_in(content) -> Iterator[dict]:
    return (page_of(h, b) for h, b in Stream(content).records() if h["warc-type"] in ("response", "revisit"))


def _archives(records: Callable[[Iterator[pa.RecordBatch], str], Iterator[bytes]], date: str, file_bytes: int, level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows that are an archive each, less its last byte, from what makes records of a partition's rows and a prefix for their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, n, held, size = f"{date} {uuid.uuid4().hex} {TaskContext.get().partitionId()}", 0, [], 0
        whole = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["value"])
        for raw in records(batches, prefix):
            if not held:
                held.extend(members(information(record_id(prefix, "warcinfo", n), date), level))
                n += 1
            for m in members(raw, level):
                held.append(m)
                size += len(m)
            if size >= file_bytes:
                yield whole()
                held.clear()
                size = 0
        if held:
            yield whole()

    return run


def _save(archives: DataFrame, path: str) -> None:
    archives.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def write_archives(pages: DataFrame, path: str, file_bytes: int = 16 << 20, level: int = 6) -> None:
    """Writes a response record for each row of (page_id, url, html)."""
    date = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())

    def records(batches: Iterator[pa.RecordBatch], prefix: str) -> Iterator[bytes]:
        n = 0
        for batch in batches:
            html = batch.column(2)
            html = html.cast(pa.large_binary() if pa.types.is_large_string(html.type) else pa.binary())
            for page_id, url, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), (x.as_py() or b"" for x in html), strict=True):
                yield page_record(record_id(prefix, n), date, page_id, url, payload, payload_digest(payload))
                n += 1

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    _save(rows.mapInArrow(_archives(records, date, file_bytes, level), "value binary"), path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of pages in all archives in a folder, in batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                for r in pages_in(content.as_buffer()):
                    r["path"] = name
                    size += 256 + (len(r["payload"]) if with_payload else 0)
                    rows.append(r if with_payload else r | {"payload": None})
                    if size >= 1 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return _files(spark, path).mapInArrow(run, RECORD)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[name] for r in rows], kind) for name, kind in _FIELDS], [name for name, _ in _FIELDS])


def revisits(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(path, record_id, original) of each record header whose payload an earlier page has, ``original`` being that record's.

    A digest's originals come from an aggregate that is combined before the
    shuffle; the join back has one row per digest on its side, so a digest with
    many records can be split.
    """
    big = headers.filter(F.col("payload_bytes") >= least_bytes)
    # Null page ids come last; equal ones by record.
    first = F.min(F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "record_id", "url", "date")).alias("original")
    originals = splittable(big.groupBy("payload_digest").agg(first, F.count("*").alias("n")).filter("n > 1").drop("n"), "digests")
    return big.join(originals, "payload_digest").filter(F.col("original.record_id") != F.col("record_id")).select("path", "record_id", "original")


def deduplicate(spark: SparkSession, raw: str, path: str, least_bytes: int = 0, file_bytes: int = 16 << 20, level: int = 6) -> None:
    """Writes the archives in ``raw`` again, with revisit records for payloads that came before."""
    date = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
    headers = read_archives(spark, raw, with_payload=False).drop("payload")
    # As many as an archive's records at most.
    by_file = revisits(headers, least_bytes).groupBy("path").agg(F.collect_list(F.struct("record_id", "original")).alias("revisits"))

    def records(batches: Iterator[pa.RecordBatch], prefix: str) -> Iterator[bytes]:  # noqa: ARG001
        for batch in batches:
            for content, own in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                again = {x["record_id"]: x["original"] for x in own or ()}
                for r in pages_in(content.as_buffer()):
                    # Ids stay, as other archives refer to them.
                    yield page_record(r["record_id"], r["date"], r["page_id"], r["url"], r["payload"], r["payload_digest"], again.get(r["record_id"]))

    rows = _files(spark, raw).join(by_file, "path", "left").select("content", "revisits")
    _save(rows.mapInArrow(_archives(records, date, file_bytes, level), "value binary"), path)


def archive(pages: DataFrame, path: str, least_bytes: int = 0, file_bytes: int = 16 << 20) -> DataFrame:
    """Writes raw and then deduplicated archives under ``path``, and reads the latter back (headers and payloads)."""
    spark = pages.sparkSession
    small_batches(spark)
    write_archives(pages, f"{path}/raw", file_bytes)
    deduplicate(spark, f"{path}/raw", f"{path}/deduplicated", least_bytes, file_bytes)
    return read_archives(spark, f"{path}/deduplicated")


def archive_pages(pages: DataFrame, least_bytes: int = 0, file_bytes: int = 16 << 20) -> DataFrame:
    """``archive`` under a new folder of the shared one."""
    return archive(pages, new_path(pages.sparkSession, "warc"), least_bytes, file_bytes)
