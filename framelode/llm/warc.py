"""WARC archives: a writer with revisit records and a splittable reader.

Every record is a gzip member of its own. The reader deals byte ranges of the files to tasks. A task looks for the
gzip magic in its range, takes a place for a member only if its decoded start is a WARC header and what follows the
member is another one or the end of the file, and from there walks from member to member. It owns the records that
start inside its range, so it may read past the end of the range, and no record is read twice.

Files are opened with pyarrow.fs, which takes local paths and the usual remote stores by their URI.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import attach, shared_folder

MAGIC = b"\x1f\x8b\x08"
READ = 1 << 20
SPLIT = 16 << 20
#: Tasks that read ranges for each core, at most; beyond it a task reads several.
READERS = 64
ID = "urn:framelode:record:"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "path string, offset long, record_type string, record_id long, target_uri string, date string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def payload_digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32, as WARC-Payload-Digest has it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(record_id: int, uri: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record; with refers_to a revisit, which keeps the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{ID}{record_id}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {quote(uri, safe=':/?#[]@!$&()*+,;=%~')}"] if uri else []),
        *([f"WARC-Refers-To: <{ID}{refers_to}>", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []),
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 6) -> bytes:
    """raw as one gzip member."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if not urlsplit(path).scheme:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def first_of_equal(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, refers_to): for each page whose payload a smaller id has too, the smallest such id."""
    ids = pages.select("page_id", F.octet_length("payload").alias("size"), F.sha1("payload").alias("digest")).where(F.col("size") >= min_bytes)
    firsts = ids.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    return attach(ids.select("page_id", "digest"), firsts, "digest", "copies", "page_id").where("first_id < page_id").select("page_id", F.col("first_id").alias("refers_to")).distinct()


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes a record for each row, one archive for each task, and returns the archives: path, bytes, records.

    Of rows with equal payloads of at least min_bytes bytes, the one with the smallest id is a response (so are rows
    that repeat that id) and the others revisit it. A null payload is empty, a null url leaves the target out, control
    characters and spaces in urls are percent-encoded, rows with a null id are left out. An empty table yields no
    archive. The list is written as Parquet beside the archives and holds only what succeeded: a repeated task writes
    a file under a new name.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).where("page_id IS NOT NULL")

    def write(batches):
        files, name = opened(folder)
        files.create_dir(name, recursive=True)
        path, size, count, out = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0, None
        for batch in batches:
            for page_id, url, body, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = out or files.open_output_stream(f"{name}/{path}", compression=None)
                out.write(raw := member(record_bytes(page_id, url, body, refers_to)))
                size, count = size + len(raw), count + 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "bytes": [size], "records": [count]})

    listed = rows.join(first_of_equal(rows, min_bytes), "page_id", "left").select("page_id", "url", "payload", "refers_to").mapInArrow(write, "path string, bytes long, records long")
    listed.write.parquet(f"{folder}/_archives")
    return pages.sparkSession.read.schema(listed.schema).parquet(f"{folder}/_archives")


class Archive:
    """One archive, read in steps of READ bytes."""

    def __init__(self, path: str, size: int):
        files, name = opened(path)
        self.file, self.size, self.at, self.held = files.open_input_file(name), size, 0, b""

    def read(self, at: int, n: int = READ) -> bytes:
        """Up to n bytes from at; nearby reads share what was read last."""
        if not self.at <= at < self.at + len(self.held) or at + min(n, 64) > self.at + len(self.held) < self.size:
            self.file.seek(at)
            self.at, self.held = at, self.file.read(max(n, READ))
        return self.held[at - self.at : at - self.at + n]

    def record(self, at: int) -> tuple[bytes, int] | None:
        """The decoded member at a place and where it ends, or None if no whole WARC record stands there."""
        z, out, seen, place = zlib.decompressobj(31), [], b"", at
        try:
            while not z.eof:
                raw = self.read(place)
                if not raw:
                    return None
                out.append(z.decompress(raw))
                place += len(raw)
                if len(seen) < 7:
                    seen += out[-1][:7]
                    if not b"WARC/1.".startswith(seen[:7]):
                        return None
        except zlib.error:
            return None
        return b"".join(out), place - len(z.unused_data)

    def starts(self, at: int, end: int) -> Iterator[int]:
        """Places of the gzip magic in [at, end)."""
        while at < end:
            raw = self.read(at, READ)
            for hit in re.finditer(re.escape(MAGIC), raw):
                if at + hit.start() < end:
                    yield at + hit.start()
            if at + len(raw) >= self.size or not raw:
                return
            at += max(len(raw) - len(MAGIC) + 1, 1)

    def records(self, start: int, end: int) -> Iterator[tuple[int, bytes]]:
        """(offset, bytes) of the records that start in [start, end)."""
        for at in self.starts(start, min(end, self.size)):
            found = self.record(at)
            if found and (found[1] == self.size or self.read(found[1], 3) == MAGIC):
                break
        else:
            return
        while found and at < end:
            yield at, found[0]
            at = found[1]
            found = self.record(at) if at < min(end, self.size) else None
            if found is None and at < min(end, self.size):
                raise ValueError(f"no WARC record at byte {at}")


def _id(value: str | None) -> int | None:
    number = (value or "").strip("<>").removeprefix(ID)
    return int(number) if number.lstrip("-").isdigit() else None


def parsed(raw: bytes) -> dict:
    """The fields of RECORDS, without path and offset, from one record's bytes."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = block[: int(fields.get("content-length", len(block)))]
    http, _, payload = block.partition(b"\r\n\r\n") if "application/http" in fields.get("content-type", "") else (b"", b"", block)
    kind = fields.get("warc-type")
    length = re.search(rb"(?i)\ncontent-length:\s*(\d+)", http)
    revisit = kind == "revisit"
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if not revisit and digest and digest != payload_digest(payload):
        raise ValueError(f"payload of {fields.get('warc-record-id')} doesn't have its digest")
    return {"record_type": kind, "record_id": _id(fields.get("warc-record-id")), "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "refers_to": _id(fields.get("warc-refers-to")), "payload_digest": digest, "payload_bytes": int(length[1]) if revisit and length else len(payload), "payload": None if revisit else payload}


def read_warc(spark: SparkSession, archives: DataFrame, split_bytes: int = SPLIT, payloads: bool = True) -> DataFrame:
    """One row for each record of the archives (path, bytes), read in ranges of split_bytes, each by a task of its own.

    Columns: path, offset (of the member), record_type, record_id, target_uri, date, refers_to, payload_digest,
    payload_bytes, payload (null for revisits, and everywhere with payloads=False). payload_bytes and payload_digest
    are those of the full payload for revisits too. A response whose payload doesn't have its digest, and bytes that
    are no record between two records, raise.
    """

    def read(batches):
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                archive, rows, held = Archive(path, size), [], 0
                for offset, raw in archive.records(start, start + split_bytes):
                    row = {"path": path, "offset": offset} | parsed(raw)
                    rows.append(row if payloads else row | {"payload": None})
                    held += len(raw)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.int64()), ("target_uri", pa.string()), ("date", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
    ranges = archives.where("bytes > 0").select("path", "bytes", F.expr(f"explode(sequence(0L, bytes - 1, {split_bytes}L))").alias("start"))
    context = spark.sparkContext
    # a number of its own, which Spark keeps: by size alone these few bytes of rows would be one task
    return ranges.repartition(min(max(ranges.count(), 1), READERS * context.defaultParallelism)).mapInArrow(read, RECORDS)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """Writes all pages as WARC into the shared folder and returns what the archives hold, page by page."""
    archives = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), shared_folder(spark, "warc"))
    out = read_warc(spark, archives, payloads=False)
    return out.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
