"""WARC archives: one gzip member a record, written and read by Spark tasks."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.shared import SEPARATOR, cut, read_bytes, write_bytes

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, target_uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member: a response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    digest = sha1_base32(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    head.append(f"WARC-Record-ID: <urn:page:{page_id if page_id is not None else 'unknown:' + digest}>")
    head.append(f"WARC-Date: {date}")
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()


class Member:
    """Reads one gzip member of data from start on, some compressed bytes at a time."""

    def __init__(self, data: memoryview, start: int, step: int = 1 << 16) -> None:
        self.data, self.at, self.step = data, start, step
        self.unzip, self.ready = zlib.decompressobj(31), bytearray()

    def more(self) -> bool:
        if self.unzip.eof:
            return False
        chunk = self.data[self.at : self.at + self.step]
        if not len(chunk):
            raise ValueError("the archive ends within a record")
        self.ready += self.unzip.decompress(chunk)
        self.at += len(chunk) - len(self.unzip.unused_data)
        return True

    def until(self, mark: bytes) -> bytes:
        seen = 0
        while (k := self.ready.find(mark, seen)) < 0:
            seen = max(0, len(self.ready) - len(mark) + 1)
            if not self.more():
                raise ValueError("a record's header doesn't end")
        return self.take(k + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.ready) < n:
            if not self.more():
                raise ValueError("a record is shorter than its Content-Length")
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out

    def end(self) -> int:
        """The place behind the member, which has to be read in full."""
        while self.more():
            pass
        if self.ready:
            raise ValueError("a member goes on behind its record")
        return self.at


def _fields(head: bytes) -> dict[str, str]:
    first, *rest = head.decode().split("\r\n")
    return {"": first} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest if x)}


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def records(archive: memoryview) -> Iterator[dict]:
    """All records of an archive, each framed by its Content-Length and held against its digests."""
    at = 0
    while at < len(archive):
        if archive[at] == SEPARATOR[0]:  # padding behind a member
            at += 1
            continue
        member = Member(archive, at)
        head = _fields(member.until(b"\r\n\r\n"))
        if not head[""].startswith("WARC/"):
            raise ValueError("not a WARC record")
        block = member.take(int(head["content-length"]))
        if member.take(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end with two line ends")
        at = member.end()
        if head["warc-block-digest"] != f"sha1:{sha1_base32(block)}":
            raise ValueError(f"block digest of {head['warc-record-id']} differs")
        http, _, payload = block.partition(b"\r\n\r\n")
        n, revisit = int(_fields(http)["content-length"]), head["warc-type"] == "revisit"
        if not revisit and (len(payload) != n or head["warc-payload-digest"] != f"sha1:{sha1_base32(payload)}"):
            raise ValueError(f"payload of {head['warc-record-id']} differs from its digest or length")
        yield {
            "page_id": _page(head["warc-record-id"]), "target_uri": head.get("warc-target-uri"), "record_type": head["warc-type"],
            "refers_to": _page(head.get("warc-refers-to")), "payload_bytes": n, "payload_digest": head["warc-payload-digest"][5:],
            "payload": None if revisit else payload,
        }


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", archive_bytes: int = 1 << 26, broadcast_rows: int = 100_000) -> None:
    """Write a record for each row of pages (page_id, url, html), the html in UTF-8 as payload.

    Of rows with equal payloads of at least least_bytes, that with the largest page_id is the
    response and the others are revisits of it. Null html is an empty payload; a null url leaves the
    field out; a row with a null page_id never is what others refer to (where all of a group are null,
    all are responses); rows that share the largest page_id all are responses. Other columns are
    ignored; an empty table gives no records.

    An archive ends with the record that brings it to archive_bytes, so it is one record or a bounded
    number of bytes. Only digests that occur twice are joined. They are broadcast if there are at most broadcast_rows,
    else joined by a shuffle, in which Spark splits skewed digests.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload"))
    keyed = rows.withColumn("sha1", F.unhex(F.sha1("payload")))
    same = keyed.filter(F.length("payload") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    same = cut(same.filter((F.col("n") > 1) & F.col("keeper").isNotNull()).select("sha1", "keeper"))
    if same.count() <= broadcast_rows:
        same = F.broadcast(same)
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("keeper")) & (F.length("payload") >= least_bytes), F.col("keeper"))
    joined = keyed.join(same, "sha1", "left").select("page_id", "url", "payload", refers.alias("refers_to"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: list[bytes] = []
        size = 0

        def archive() -> pa.RecordBatch:
            # The writer puts a zero byte behind each row, which is a file: mostly it is the last byte
            # of the last member's length field, else padding, which readers of gzip files skip.
            out = b"".join(members).removesuffix(SEPARATOR)
            members.clear()
            return pa.RecordBatch.from_pydict({"archive": pa.array([out], pa.binary())})

        for batch in batches:
            for k in range(batch.num_rows):
                member = record(*(batch.column(c)[k].as_py() for c in range(4)), date)
                members.append(member)
                size += len(member)
                if size >= archive_bytes:
                    yield archive()
                    size = 0
        if members:
            yield archive()

    write_bytes(joined.mapInArrow(pack, "archive binary"), "archive", path, 1)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives in path, one task an archive or several; a damaged record is an error.

    A revisit's payload is null, its payload_bytes and payload_digest are those of the full payload.
    """
    schema = RECORD if payloads else RECORD.rpartition(",")[0]
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(n, types[k]) for n, k in (x.split() for x in schema.split(", "))])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                found: list[dict] = []
                for x in records(memoryview(content.as_buffer())):
                    found.append({n: x[n] for n in names})
                    if len(found) == 1000:
                        yield pa.RecordBatch.from_pylist(found, arrow)
                        found = []
                yield pa.RecordBatch.from_pylist(found, arrow)

    return read_bytes(spark, path).select("content").mapInArrow(unpack, schema)
