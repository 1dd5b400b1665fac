"""WARC archives with an index that comes first.

``write`` puts pages into gzip members of WARC 1.1 files in a shared folder, one
file per task attempt, and writes an index table: file, offset, length, URL and
digest per record. Equal payloads are stored once; the rest are revisit records.
``read`` takes index rows, sorts them by file and offset, joins neighbouring byte
ranges into one read, and checks every digest.

A task that runs twice writes two files, but the index names only the file of
the attempt that Spark committed, so lost executors leave no wrong record.

Cases: a null html is an empty payload; equal empty payloads are revisits too
(unless ``least`` is higher); a null URL leaves the header out; rows with a null
page_id are revisits of an equal payload that has one, else responses, and are never referred to; repeated rows of the smallest page_id
are all responses; every record has an id of its own; an empty table gives an empty index; payloads of any length
are stored whole; other columns are not read.
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
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._common import bounded_batches

#: Bytes between two records that are read over rather than sought, and the most bytes of one read.
GAP, READ = 64 << 10, 8 << 20
#: Bytes of archive that a reading task gets, about; the index alone says nothing of the work behind it.
TASK = 32 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SAFE = "".join(map(chr, range(33, 127)))


def _store(uri: str):
    """(file system, path) of a URI that pyarrow knows; a path without a scheme is local."""
    from pyarrow import fs

    if urlsplit(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlsplit(uri).path
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str, name: str = "") -> bytes:
    """One uncompressed WARC record, with an id made from ``name``, which must be its own. Pages are named by header fields of our own."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, name)}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_SAFE)}")
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """page_id, payload (None for a revisit), payload_bytes, payload_digest, record_type and refers_to of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *fields = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:40]!r}")
    h = {k.lower(): v for k, _, v in (f.partition(": ") for f in fields)}
    block = rest[: int(h["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record does not end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda field: int(h[field]) if field in h else None
    digest, revisit = h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"] == "revisit"
    if not revisit and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"the payload of {h['warc-record-id']} does not match its digest")
    return {"page_id": number("page-id"), "payload": None if revisit else payload, "payload_bytes": size, "payload_digest": digest, "record_type": h["warc-type"], "refers_to": number("refers-to-page-id")}


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write(pages: DataFrame, folder: str, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archives of ``pages`` (page_id, url, html) below ``folder``, a shared URI; returns the index, read from where it was written.

    Of records with equal payloads of at least ``least`` bytes, the one with the smallest page_id is the response.
    """
    bounded_batches(pages.sparkSession)
    base = pages.select("page_id", "url", "html")
    payload = F.coalesce("html", F.lit("")).cast("binary")
    prints = base.select("page_id", F.sha1(payload).alias("d"), F.octet_length(payload).alias("n")).where(F.col("n") >= least)
    first = prints.groupBy("d", "n").agg(F.min("page_id").alias("first"))
    again = prints.join(first, ["d", "n"]).where("page_id <> first or page_id is null and first is not null")
    known = again.select(F.col("page_id").alias("p"), "d", "first").distinct()
    # The payload travels once, by page_id and digest, which tells apart different payloads of one page_id; null ids join too.
    rows = base.withColumn("b", F.sha1(payload)).join(known, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("b") == F.col("d")), "left").select("page_id", "url", "html", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        name, out, at = f"records-{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for b in batches:
                if out is None and b.num_rows:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                got = []
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                    data = (html or "").encode()
                    digest = digest_of(data)
                    z = zlib.compressobj(3, zlib.DEFLATED, 31)
                    packed = z.compress(record(page_id, url, data, digest, refers_to, refers_to is not None, date, f"{name}/{at}")) + z.flush()
                    out.write(packed)
                    got.append((page_id, url, digest, name, at, len(packed)))
                    at += len(packed)
                cols = list(zip(*got)) if got else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], ["page_id", "url", "digest", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    rows.mapInArrow(run, "page_id bigint, url string, digest string, file string, offset bigint, length bigint").write.parquet(f"{folder}/index")
    return pages.sparkSession.read.parquet(f"{folder}/index")


def read(index: DataFrame, folder: str, with_payload: bool = True, gap: int = GAP, most: int = READ) -> DataFrame:
    """The records of the selected ``index`` rows, from as few sorted byte-range reads as the limits allow."""
    bounded_batches(index.sparkSession)
    names = ["page_id", *(["payload"] if with_payload else []), "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = {"page_id": pa.int64(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        opened: tuple[str, object] | None = None
        try:
            for b in batches:
                rows = list(zip(*(c.to_pylist() for c in b.columns)))
                while rows:
                    file, start, size = rows[0]
                    n, stop = 1, start + size
                    while n < len(rows) and rows[n][0] == file and rows[n][1] - stop <= gap and rows[n][1] + rows[n][2] - start <= most:
                        stop = max(stop, rows[n][1] + rows[n][2])
                        n += 1
                    if opened is None or opened[0] != file:
                        if opened is not None:
                            opened[1].close()
                        opened = (file, store.open_input_file(f"{root}/{file}"))
                    data = opened[1].read_at(stop - start, start)
                    got = [parse(zlib.decompress(data[o - start : o - start + k], 31)) for _, o, k in rows[:n]]
                    rows = rows[n:]
                    yield pa.RecordBatch.from_arrays([pa.array([g[c] for g in got], types[c]) for c in names], names)
        finally:
            if opened is not None:
                opened[1].close()

    kinds = {"page_id": "bigint", "payload": "binary", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"}
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    ordered = index.select("file", "offset", "length").repartitionByRange(total // TASK + 1, F.col("file"), F.col("offset")).sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names))


def archive(spark: SparkSession, pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes the pages and reads every record back."""
    return read(write(pages, folder, least), folder, with_payload=False)
