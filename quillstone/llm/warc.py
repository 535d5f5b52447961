"""WARC archives: a writer with revisit records, and a reader that salvages what is intact.

``write`` puts one record per page into gzip members (or plain) of ``*.warc.gz`` files in a shared folder, each task its own files, and
returns the manifest of the files that finished tasks wrote; leftovers of lost tasks are in no manifest. ``read`` takes files from a
manifest and checks each record: version line, header, length, the end mark, digests of block and payload. After a failed check it looks
for the next gzip member that opens with a version line (or, in plain archives, for the next version line), goes on there, and logs
the bytes between as a quarantined gap.

Defined results: null html is an empty payload; pages with a null id are written without one; of equal payloads with equal largest ids
all are responses; a null url is an empty target. An empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import keep, shared_path, table

REVISIT_FROM = 1000  # bytes of payload
FILE_BYTES = 64 << 20
BROADCAST_DIGESTS = 200_000  # rows of some 60 bytes; more repeated payloads than that are joined by shuffle
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, salt: str) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, salt)}>"


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, date: str, salt: str) -> bytes:
    """One WARC record; a revisit if ``refers_to`` is given, which has HTTP headers but no payload."""
    uri = quote(url, safe="!#$%&'()*+,/:;=?@[]~")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, salt)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}",
        "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: {sha1(payload)}", f"WARC-Block-Digest: {sha1(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, '')}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + END + block + END


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record that starts at ``at`` and where it ends. ValueError says which check failed."""
    if not VERSION.match(data, at):
        raise ValueError("no version line")
    stop = data.find(END, at)
    if stop < 0:
        raise ValueError("header has no end")
    head = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("bad header line")
        head[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    if not head.get("content-length", "").isdigit():
        raise ValueError("no length")
    if not {"warc-record-id", "warc-type", "warc-date"} <= head.keys():
        raise ValueError("a required header is missing")
    start = stop + 4
    end = start + int(head["content-length"])
    if data[end : end + 4] != END:
        raise ValueError("no end mark")
    block = data[start:end]
    if "warc-block-digest" in head and head["warc-block-digest"] != sha1(block):
        raise ValueError("block digest")
    payload = block.partition(END)[2] if head.get("content-type", "").startswith("application/http") else block
    if head.get("warc-type") == "response" and "warc-payload-digest" in head and head["warc-payload-digest"] != sha1(payload):
        raise ValueError("payload digest")
    return {"head": head, "payload": payload}, end + 4


def _open(data: bytes, at: int, step: int = 1 << 16) -> tuple[bytes, int]:
    """A gzip member's content and where it ends. It is fed in steps, as what a step holds past the end is copied."""
    z, view, out = zlib.decompressobj(31), memoryview(data), []
    try:
        while not z.eof and at < len(data):
            out.append(z.decompress(view[at : at + step]))
            at = min(len(data), at + step)
    except zlib.error as e:
        raise ValueError(f"gzip: {e}") from None
    if not z.eof:
        raise ValueError("gzip: cut off")
    return b"".join(out), at - len(z.unused_data)


def _first_line(data: bytes, at: int) -> bool:
    z = zlib.decompressobj(31)
    try:
        return bool(VERSION.match(z.decompress(memoryview(data)[at : at + 4096], 64)))
    except zlib.error:
        return False


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | str]]:
    """(start, end, record) for every intact record of an archive, and (start, end, reason) for every gap between them."""
    packed = not VERSION.match(data) and (data[:2] == b"\x1f\x8b" or data.find(b"\x1f\x8b\x08") >= 0 and not VERSION.search(data))
    at = 0
    while at < len(data):
        try:
            if packed:
                inner, end = _open(data, at)
                found, used = parse_record(inner)
                if used != len(inner):
                    raise ValueError("more than a record in the member")
            else:
                found, end = parse_record(data, at)
            yield at, end, found
        except ValueError as e:
            end = at + 1
            if packed:
                while (end := data.find(b"\x1f\x8b\x08", end)) >= 0 and not _first_line(data, end):
                    end += 1
            else:
                m = VERSION.search(data, end)
                end = m.start() if m else -1
            end = len(data) if end < 0 else end
            yield at, end, str(e)
        at = end


def _file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def _writer(folder: str, date: str, gz: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _file_system(folder)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        done: list[tuple] = []
        out, size, n = None, 0, 0
        for batch in batches:
            for page_id, url, refers, html in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                data = record(page_id, url or "", (html.as_py() or "").encode(), refers, date, f"{name}-{len(done)}-{n}")
                data = member(data) if gz else data
                if out is None or size and size + len(data) > FILE_BYTES:
                    if out:
                        out.close()
                        done.append((file, size, n))
                    file = f"{folder}/{name}-{len(done):04d}.warc{'.gz' * gz}"
                    out, size, n = fs.open_output_stream(_file_system(file)[1], compression=None), 0, 0
                out.write(data)
                size, n = size + len(data), n + 1
        if out:
            out.close()
            done.append((file, size, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["file", "bytes", "records"])

    return run


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2000-01-01T00:00:00Z", gz: bool = True) -> DataFrame:
    """Writes the archives; returns their manifest (file, bytes, records). Only digests shuffle to find equal payloads; those that
    repeat are counted, and are broadcast to the pages if they are few, so no html travels."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    repeated = rows.filter(F.octet_length("html") >= REVISIT_FROM).groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    repeated = keep(repeated, "repeated")
    rows = rows.join(F.broadcast(repeated) if repeated.count() <= BROADCAST_DIGESTS else repeated, "digest", "left")
    refers = F.when(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return keep(rows.select("page_id", "url", refers.alias("refers"), "html").mapInArrow(_writer(folder, date, gz), "file string, bytes long, records long"), "manifest")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("gap", pa.string()), ("record_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])
    for batch in batches:
        for file in batch.column(0).to_pylist():
            fs, at = _file_system(file)
            with fs.open_input_stream(at, compression=None) as f:
                data = f.read()
            rows, size = [], 0
            for start, end, found in salvage(data):
                if isinstance(found, str):
                    rows.append((file, start, end, found, *[None] * 6))
                    continue
                head = found["head"]
                rows.append((file, start, end, None, head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-type"), head.get("warc-payload-digest"), head.get("warc-refers-to"), found["payload"]))
                size += len(found["payload"])
                if size > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), schema.types)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), schema.types)], schema=schema)


def read(files: DataFrame) -> DataFrame:
    """Records and gaps of the archives named in column ``file``: a gap has a reason in ``gap``, a record has none. Files go one to a task."""
    names = files.select("file")
    return names.repartition(max(1, names.count()), "file").mapInArrow(
        _reader, "file string, start long, `end` long, gap string, record_id string, url string, record_type string, payload_digest string, refers_to string, payload binary"
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages, reads the archives back; a revisit's payload is that of the response it refers to."""
    found = read(write(table(spark, sf_dir, "pages"), shared_path(spark, "warc"))).filter("gap is null")
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)")
    found = found.select("record_type", number("record_id").alias("page_id"), number("refers_to").alias("refers_to"), F.octet_length("payload").cast("long").alias("own_bytes"), F.sha1("payload").alias("own_digest"))
    found = keep(found, "records")
    own = [F.col("own_bytes").alias("payload_bytes"), F.col("own_digest").alias("payload_digest"), "record_type", "refers_to"]
    revisits, rest = found.filter("record_type = 'revisit'"), found.filter("record_type <> 'revisit'")
    # only revisits look for the response that they refer to
    full = keep(rest.join(revisits.select(F.col("refers_to").alias("page_id")).distinct(), "page_id", "left_semi").groupBy(F.col("page_id").alias("refers_to")).agg(F.max(F.struct("own_bytes", "own_digest")).alias("full")), "full")
    met = revisits.join(full, "refers_to", "left").select("page_id", F.col("full.own_bytes").alias("payload_bytes"), F.col("full.own_digest").alias("payload_digest"), "record_type", "refers_to")
    return rest.select("page_id", *own).unionByName(met)


SQL = """
WITH t AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
g AS (SELECT *, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS last FROM t)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM g
"""
