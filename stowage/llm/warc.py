"""WARC archives with an index that is written first.

Writing: each task streams its rows into one archive file of gzip members (one
member for each record) in the shared folder and returns the index: file,
offset, length, URL, digest and kind of each record. The index is a Parquet
table; only files that it names count, so the file of a task that was lost or
run twice is never read. Reading: records are selected on the index alone;
the selected ranges are sorted by file and offset, cut into groups of at most
``GROUP_BYTES``, and ranges that lie within ``GAP_BYTES`` of each other are
read at once.

Of records with equal payloads of at least ``revisit_bytes`` bytes, the one
with the largest id is the response and the others are revisits that refer to
it and store no payload. Digests that several payloads have are looked up where
the payloads are, if they are few enough to be sent out; else by a join that
moves the payloads, whose hot digests Spark splits.

Files are opened with ``pyarrow.fs``, by the URI of the folder that
``spark.checkpoint.dir`` names.

Defined results: a null payload is empty; a null URL is written as ``about:blank``
and read back as it is written; rows that repeat an id are records of their
own (of equal payloads and ids, all are responses). Rows with a null id are
records whose id is null.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .memory import in_arrow
from .shared import light, materialize, new_path

GAP_BYTES, GROUP_BYTES, TASK_BYTES, REVISIT_BYTES = 64 << 10, 2 << 20, 64 << 20, 1000
_LEVEL = 3
_DATE = "2024-01-01T00:00:00Z"
INDEX = "id long, url string, file string, offset long, length long, digest string, payload_bytes long, record_type string, refers_to long"
RECORDS = "id long, url string, record_type string, refers_to long, digest string, payload_bytes long, payload binary"


def _open(uri: str):
    """(filesystem, path) of a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def record_bytes(id_: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    kind = "response" if refers_to is None else "revisit"
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = status + f"Content-Length: {len(payload)}\r\n\r\n".encode() + (payload if refers_to is None else b"")
    name = "" if id_ is None else str(id_)
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {(url or 'about:blank').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """A record's fields; ``payload`` is None for a revisit. ValueError if lengths don't fit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]):
        raise ValueError("a WARC record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    number = lambda x: int(x) if x else None
    kind = fields["WARC-Type"]
    if kind == "response" and len(payload) != size:
        raise ValueError("a payload is cut short")
    return {
        "id": number(fields["WARC-Record-ID"][10:-1]),
        "url": fields["WARC-Target-URI"],
        "record_type": kind,
        "refers_to": number(fields["WARC-Refers-To"][10:-1]) if kind == "revisit" else None,
        "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "payload_bytes": size,
        "payload": payload if kind == "response" else None,
    }


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, at = None, f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
        try:
            for batch in batches:
                rows = {k: [] for k in ("id", "url", "file", "offset", "length", "digest", "payload_bytes", "record_type", "refers_to")}
                for i in range(batch.num_rows):
                    id_, url, payload, digest, refers = (batch.column(c)[i].as_py() for c in ("id", "url", "payload", "digest", "refers_to"))
                    if out is None:
                        store, at_path = _open(path)
                        store.create_dir(at_path.rpartition("/")[0], recursive=True)
                        out = store.open_output_stream(at_path, compression=None)
                    packer = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
                    packed = packer.compress(record_bytes(id_, url, payload, digest, refers)) + packer.flush()
                    out.write(packed)
                    for k, v in (("id", id_), ("url", url), ("file", path), ("offset", at), ("length", len(packed)), ("digest", digest), ("payload_bytes", len(payload)), ("record_type", "response" if refers is None else "revisit"), ("refers_to", refers)):
                        rows[k].append(v)
                    at += len(packed)
                kinds = {"id": pa.int64(), "offset": pa.int64(), "length": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64()}
                yield pa.RecordBatch.from_pydict({k: pa.array(v, type=kinds.get(k, pa.string())) for k, v in rows.items()})
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write a record for each row; the index as a written table."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= revisit_bytes).groupBy(F.col("digest").alias("_digest")).agg(F.max("id").alias("last"), F.count("*").alias("copies"))
    large = light(materialize(large.where("copies > 1 and last is not null").select("_digest", "last"), "copies"))
    refers = F.when(F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last")), F.col("last"))
    rows = rows.join(large, F.col("digest") == F.col("_digest"), "left").select("id", "url", "payload", "digest", refers.alias("refers_to"))
    return materialize(in_arrow(rows, _write(new_path(pages.sparkSession, "warc")), INDEX), "warc-index")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records at (file, offset, length), which come sorted."""
    opened: tuple[str, object] | None = None

    def records(ranges: list[tuple[str, int, int]]) -> list[dict]:
        nonlocal opened
        out, i = [], 0
        while i < len(ranges):
            file, low, size = ranges[i]
            high, j = low + size, i + 1
            while j < len(ranges) and ranges[j][0] == file and ranges[j][1] - high <= GAP_BYTES and ranges[j][1] + ranges[j][2] - low <= GROUP_BYTES:
                high, j = max(high, ranges[j][1] + ranges[j][2]), j + 1
            if opened is None or opened[0] != file:
                if opened:
                    opened[1].close()
                store, path = _open(file)
                opened = (file, store.open_input_file(path))
            data = opened[1].read_at(high - low, low)
            for _, at, n in ranges[i:j]:
                out.append(parse_record(zlib.decompress(data[at - low : at - low + n], 31)))
            i = j
        return out

    kinds = {"id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
    names = [x.split()[0] for x in RECORDS.split(", ")]
    for batch in batches:
        for low in range(0, batch.num_rows, 500):
            part = batch.slice(low, 500)
            found = records(list(zip(*(part.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True)))
            yield pa.RecordBatch.from_pydict({k: pa.array([x[k] for x in found], type=kinds.get(k, pa.string())) for k in names})
    if opened:
        opened[1].close()


def read_records(selected: DataFrame) -> DataFrame:
    """``id, url, record_type, refers_to, digest, payload_bytes, payload`` of the records of (rows of) an index.

    The payload of a revisit is null; its size and digest are those of the
    payload it refers to.
    """
    group = F.floor(F.col("offset") / GROUP_BYTES)
    # the index is narrow, so the number of tasks follows the bytes to read
    total = selected.agg(F.sum("length")).first()[0] or 0
    tasks = max(selected.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    ranges = selected.select("file", "offset", "length", group.alias("group")).repartition(tasks, "file", "group").sortWithinPartitions("file", "offset")
    return in_arrow(ranges, _read, RECORDS)


def payload_digest(payload: bytes) -> str:
    return hashlib.sha1(payload).hexdigest()
