"""WARC files: a writer of one gzip member per record, and a sequential reader.

The reader goes through a file once, a block at a time: it inflates member after member, frames each
record by its Content-Length, and verifies its digests. It never holds more than one record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import Work, col

READ = 1 << 20
MAGIC = b"\x1f\x8b\x08"
END = b"\r\n\r\n"
_RECORDS = "path string, offset long, warc_type string, record_id string, url string, date string, page_id long, status int, payload binary, length_ok boolean, digest_ok boolean, error string"
_NAMES = [c.split()[0] for c in _RECORDS.split(", ")]
_KINDS = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.bool_(), pa.bool_(), pa.string()]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def verified(said: str | None, data: bytes) -> bool | None:
    """Whether a digest field, of md5 or of the sha family, in base 32 or hexadecimal, is that of data; null if it can't be told."""
    kind, _, value = (said or "").partition(":")
    kind = kind.strip().lower().replace("-", "")
    if kind not in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
        return None
    made, value = hashlib.new(kind, data), value.strip()
    return value.lower() == made.hexdigest() or value.upper().rstrip("=") == base64.b32encode(made.digest()).decode().rstrip("=")


def make_record(page_id: int | None, url: str | None, body: bytes, date: str) -> bytes:
    """A response record. Line breaks inside the URL are percent-encoded."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    block = http + body
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url} {digest(body)}")
    head = ["WARC/1.0", "WARC-Type: response", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    head += [f"WARC-Payload-Digest: {digest(body)}", f"WARC-Block-Digest: {digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


def parse_record(raw: bytes, path: str, offset: int) -> tuple:
    """One inflated record as a row. Faults are reported in length_ok, digest_ok and error, not raised."""
    cut = raw.find(END)
    if cut < 0 or not raw.startswith(b"WARC/"):
        return (path, offset, *[None] * 7, False, None, "no WARC header")
    fields = {}
    for line in raw[:cut].decode("utf-8", "replace").split("\r\n")[1:]:
        key, _, value = line.partition(":")
        fields.setdefault(key.strip().lower(), value.strip())
    size, begin = fields.get("content-length", ""), cut + 4
    if not size.isdigit():
        return (path, offset, fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-date"), None, None, None, False, None, "no Content-Length")
    block, tail = raw[begin : begin + int(size)], raw[begin + int(size) :]
    length_ok = len(block) == int(size) and tail == END
    status, payload = None, block
    if fields.get("content-type", "").startswith("application/http"):
        body = block.find(END)
        said = re.match(rb"HTTP/\d(?:\.\d)? (\d{3})", block)
        if said and body >= 0:
            status, payload = int(said[1]), block[body + 4 :]
    checks = [ok for k, v in (("warc-payload-digest", payload), ("warc-block-digest", block)) if (ok := verified(fields.get(k), v)) is not None]
    page = fields.get("x-page-id", "")
    return (path, offset, fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-date"), int(page) if re.fullmatch(r"-?\d{1,18}|-?[0-8]\d{18}", page) else None, status, payload, length_ok, all(checks) if checks else None, None if length_ok else "wrong length")


def read_members(stream, path: str) -> Iterator[tuple]:
    """Rows of all records of one open file."""
    data, offset = b"", 0  # offset: of data[0] in the file
    while True:
        if len(data) < len(MAGIC):
            more = stream.read(READ)
            data += more
            if not data:
                return
            if more and len(data) < len(MAGIC):
                continue
        if not data.startswith(MAGIC):  # damage: on to the next member
            at = data.find(MAGIC, 1)
            yield (path, offset, *[None] * 7, False, None, "not a gzip member")
            while at < 0:
                keep = data[-2:]
                offset += len(data) - len(keep)
                more = stream.read(READ)
                if not more:
                    return
                data = keep + more
                at = data.find(MAGIC)
            data, offset = data[at:], offset + at
            continue
        inflate, out, used = zlib.decompressobj(wbits=31), [], 0
        try:
            while not inflate.eof:
                if not data and not (data := stream.read(READ)):
                    break
                out.append(inflate.decompress(data))
                used += len(data) - len(inflate.unused_data)
                data = inflate.unused_data
        except zlib.error as e:
            yield (path, offset, *[None] * 7, False, None, f"damaged member: {str(e)[:60]}")
            offset += used + 1
            data = data[1:]
            at = data.find(MAGIC)
            while at < 0:
                keep = data[-2:]
                offset += len(data) - len(keep)
                more = stream.read(READ)
                if not more:
                    return
                data = keep + more
                at = data.find(MAGIC)
            data, offset = data[at:], offset + at
            continue
        if not inflate.eof:
            yield (path, offset, *[None] * 7, False, None, "truncated member")
            return
        yield parse_record(b"".join(out), path, offset)
        offset += used


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)

    for part in batches:
        for uri in part.column(0).to_pylist():
            files, path = pafs.FileSystem.from_uri(uri)
            rows, size = [], 0
            with files.open_input_stream(path, compression=None) as stream:
                for row in read_members(stream, uri):
                    rows.append(row)
                    size += len(row[8] or b"")
                    if size > 8 << 20 or len(rows) >= 5000:
                        yield batch(rows)
                        rows, size = [], 0
            if rows:
                yield batch(rows)


def read_warc(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """Records of gzipped WARC files named by the first column of paths (URIs that all machines can open), about a task a file.

    Rows: path, offset of the member, warc_type, record_id, url, date, page_id, status, payload, length_ok
    (block and trailer have the lengths declared), digest_ok (null without a digest of a known kind), error. A damaged
    or truncated member gives a row that says so, and reading goes on at the next member. Null paths are
    left out; an empty file or table gives no rows; a file named twice is read twice.
    """
    uris = paths.select(F.col(f"`{paths.columns[0]}`").alias("path")).where("path is not null")
    # Ranges of row numbers, as hashes of the paths would put several files into one task and none into another.
    numbered = uris.withColumn("i", F.monotonically_increasing_id()).repartitionByRange(max(1, uris.count()), "i")
    return numbered.select("path").mapInArrow(_reader, _RECORDS)


def _writer(base: str, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files, root = pafs.FileSystem.from_uri(base)
        files.create_dir(root, recursive=True)
        part, draft = f"part-{task.partitionId():06d}.warc.gz", f".draft-{task.partitionId()}-{task.taskAttemptId()}"
        n, size = 0, 0
        with files.open_output_stream(f"{root}/{draft}", compression=None) as out:
            for batch in batches:
                for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    pack = zlib.compressobj(6, wbits=31)
                    member = pack.compress(make_record(page, url, (html or "").encode("utf-8", "replace"), date)) + pack.flush()
                    out.write(member)
                    n, size = n + 1, size + len(member)
        files.move(f"{root}/{draft}", f"{root}/{part}")  # only whole files get their name, however often a task is run
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([f"{base}/{part}"]), pa.array([n]), pa.array([size])], names=["path", "records", "bytes"])

    return write


def write_warc(pages: DataFrame, base: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a response record for every row under base, a file a partition; lazily: (path, records, bytes), a row a file.

    A null html is an empty body, a null url or id leaves its field out. Repeated rows are repeated records.
    """
    return pages.select(col(id_col).cast("long"), col(url_col).cast("string"), col(html_col).cast("string")).mapInArrow(_writer(base, date), "path string, records long, bytes long")


def through_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages written to WARC files in the shared folder and read back: (page_id, url, html, status, length_ok, digest_ok).

    A null html comes back empty, null ids and urls as null; line breaks in a url percent-encoded. An
    empty table gives no rows. Other columns aren't kept.
    """
    spark = pages.sparkSession
    work = Work(spark, "warc")
    files = work.table(write_warc(pages, work.path("files"), id_col, url_col, html_col), "manifest")
    return read_warc(spark, files).select("page_id", "url", F.decode("payload", "UTF-8").alias("html"), "status", "length_ok", "digest_ok")


WARC_SQL = "SELECT page_id, url, html, CAST(200 AS INTEGER) AS status, true AS length_ok, true AS digest_ok FROM pages"
