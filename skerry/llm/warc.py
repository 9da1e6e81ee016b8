"""WARC archives: writing, normalising to one gzip member a record, and reading by offset.

``write_archives`` writes response and revisit records into archives that are each
one gzip stream.  ``normalise`` is a monolithic pass over such a file: it inflates
the whole stream once, rewrites every record as a member of its own, and writes a
sidecar index (offset, length, type, id, one JSON line a record).  With the index,
``read_records`` opens any record by itself.

Payloads that are equal and have MIN_REVISIT bytes or more are stored once, with
the smallest id; the others are revisit records, which keep the HTTP header (with
the payload's length) and the digest and name the response.

Files go to a folder that all executors share, through ``pyarrow.fs``.  Each
attempt of a task writes files of its own, a file gets its name only when it is
complete, and only the files in the tables that Spark commits are read on, so
tasks may fail and run again.  Null html is the empty payload, null urls the empty
string.  Equal rows (same id) each give a record.  Extra columns are ignored.
Archives hold ARCHIVE_BYTES of payload or one larger record; a record has to fit
into memory, a file does not.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from skerry.plans.cuts import cut, shared_folder
from skerry.plans.shipping import ship
from skerry.plans.skew import looked_up

MIN_REVISIT = 100
ARCHIVE_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BLOCK = 1 << 16


def _folder(place: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(place)


def record_id(page: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page}')}>"


def record_bytes(page: int, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit has the payload's HTTP header without the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub('[\r\n]', ' ', url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-ID: {'' if page is None else page}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def decided(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``payload``, ``digest`` and ``refers_to`` (null for responses)."""
    payload = F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b""))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    alike = (
        rows.where(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    )
    # the pages of a digest that many share don't meet in one task with their payloads
    joined = looked_up(rows, cut(alike), ("digest",), "n", F.xxhash64("page_id"))
    return joined.select("page_id", "url", "payload", "digest", F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("refers_to"))


def _complete(files: fs.FileSystem, name: str, parts: Iterator[bytes]) -> int:
    """Write ``parts`` under a name of the attempt's own, then give the file its name; returns the bytes."""
    trial = f"{name}.{uuid.uuid4().hex}.part"
    size = 0
    with files.open_output_stream(trial) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    files.move(trial, name)
    return size


def write_archives(rows: DataFrame, place: str) -> DataFrame:
    """Archives of one gzip stream each, from ``decided`` rows; (path, records)."""

    def streams(records: list[bytes]) -> Iterator[bytes]:
        squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
        for record in records:
            yield squeeze.compress(record)
        yield squeeze.flush()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = _folder(place)
        files.create_dir(folder, recursive=True)
        task, made = TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal held, size, made
            name = f"pages-{task:05d}-{made:05d}-{uuid.uuid4().hex[:8]}.warc.gz"
            _complete(files, f"{folder}/{name}", streams(held))
            out = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64())], names=["name", "records"])
            held, size, made = [], 0, made + 1
            return out

        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                for row in batch.slice(begin, 256).to_pylist():
                    held.append(record_bytes(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"]))
                    size += len(held[-1])
                    if size >= ARCHIVE_BYTES:
                        yield close()
        if held:
            yield close()

    return rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "name string, records long")


def read_headers(stream: io.BufferedIOBase) -> dict[str, str] | None:
    """The header fields of the next record, by lower-case names; None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"a WARC record should begin here: {line[:40]!r}")
    fields = {"": line.decode().strip()}
    while (line := stream.readline()).strip():
        name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


def _records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, the record's bytes) one after the other; header bytes are kept as they are."""

    class Tee:
        def __init__(self):
            self.seen: list[bytes] = []

        def readline(self) -> bytes:
            line = stream.readline()
            self.seen.append(line)
            return line

    while True:
        tee = Tee()
        fields = read_headers(tee)
        if fields is None:
            return
        head = b"".join(x for x in tee.seen if x)
        block = stream.read(int(fields["content-length"]))
        yield fields, head.lstrip(b"\r\n") + block + b"\r\n\r\n"


def normalise(archives: DataFrame, place: str, to: str) -> DataFrame:
    """Each archive rewritten with a member for each record, and its index; (name, records, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (files, source), (out_files, target) = _folder(place), _folder(to)
        out_files.create_dir(target, recursive=True)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                index: list[str] = []
                at = 0

                def members() -> Iterator[bytes]:
                    nonlocal at
                    # one inflation of the whole stream, however many members it has
                    with files.open_input_stream(f"{source}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=io.BufferedReader(_Readable(raw), _BLOCK)) as flat:
                        for fields, record in _records(io.BufferedReader(flat, _BLOCK)):
                            member = gzip.compress(record, 6, mtime=0)
                            entry = {"offset": at, "length": len(member), "type": fields["warc-type"], "id": fields["warc-record-id"]}
                            index.append(json.dumps(entry))
                            at += len(member)
                            yield member

                size = _complete(out_files, f"{target}/{name}", members())
                _complete(out_files, f"{target}/{name}.idx", iter(["".join(x + "\n" for x in index).encode()]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([len(index)], pa.int64()), pa.array([size], pa.int64())], names=["name", "records", "bytes"]
                )

    return archives.select("name").mapInArrow(run, "name string, records long, bytes long")


class _Readable(io.RawIOBase):
    """An Arrow input stream as a raw stream."""

    def __init__(self, stream: pa.NativeFile):
        self.stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.stream.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


def read_records(archives: DataFrame, place: str) -> DataFrame:
    """Each record of normalised archives, opened by itself at its offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = _folder(place)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with files.open_input_stream(f"{folder}/{name}.idx", compression=None) as f:
                    entries = [json.loads(x) for x in f.read().splitlines()]
                with files.open_input_file(f"{folder}/{name}") as f:
                    for begin in range(0, len(entries), 256):
                        yield _parsed([f.read_at(e["length"], e["offset"]) for e in entries[begin : begin + 256]])

    return archives.select("name").mapInArrow(
        run, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
    )


def _parsed(members: list[bytes]) -> pa.RecordBatch:
    rows = []
    for member in members:
        stream = io.BytesIO(gzip.decompress(member))
        fields = read_headers(stream)
        block = stream.read(int(fields["content-length"]))
        head, _, payload = block.partition(b"\r\n\r\n")
        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
        digest = fields["warc-payload-digest"].removeprefix("sha256:")
        response = fields["warc-type"] == "response"
        if response and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"the payload of {fields['warc-record-id']} is damaged")
        refers = fields.get("x-refers-to-page-id")
        page = fields["x-page-id"]
        rows.append((int(page) if page else None, fields["warc-target-uri"], fields["warc-type"], payload if response else None, length, digest, refers and int(refers)))
    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
    names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def through_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Pages written to archives, normalised, and read back."""
    ship(pages.sparkSession)
    spark: SparkSession = pages.sparkSession
    base = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    if "://" not in base and not base.startswith("/"):
        raise ValueError("the folder has to be a URI or an absolute path")
    raw = cut(write_archives(decided(pages), f"{base}/stream"))
    # few file names; each is a task of its own, as one file may be large
    many = max(1, min(raw.count(), 4096))
    done = cut(normalise(raw.repartition(many, "name"), f"{base}/stream", f"{base}/records"))
    return read_records(done.repartition(many, "name"), f"{base}/records")


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), f AS (
  SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS d, min(page_id) OVER (PARTITION BY h) AS first FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first < page_id THEN first END AS refers_to
FROM f
"""
