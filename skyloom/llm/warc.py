"""WARC archives: monolithic gzip files, their normaliser, and reading back by offset index.

The writer makes archives that are one gzip stream each.  The normaliser inflates
such a stream once, from its start to its end, rewrites every record as a gzip
member of its own and writes a sidecar index of offsets.  The reader seeks each
member by that index.  Archives and indexes are files in the folder that driver
and executors share; their names are unique to a task attempt, and only the
names that a finished task returns are ever read.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, shared_dir

#: Payload bytes after which a new archive is begun, and bytes read at once.
ARCHIVE_BYTES, READ_BYTES = 8 << 20, 1 << 20
#: Tasks that archives are dealt over, at most.
MOST_TASKS = 100_000
#: Payload bytes from which equal payloads become revisits.
REVISIT_BYTES = 1000
LEVEL = 5
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder named as Hadoop names it, and the path in it."""
    local = re.match(r"(?:file:)?(?://)?(/.*)", uri)
    if local and not re.match(r"(?!file:)[a-z0-9]+://", uri):
        return fs.LocalFileSystem(), local[1]
    return fs.FileSystem.from_uri(uri)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response, or a revisit without payload if ``refers_to`` is given."""
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    kind = "response" if refers_to is None else "revisit"
    body = b"" if refers_to is not None else payload
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + body
    name = lambda x: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{x}')}>"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


class Splitter:
    """Cuts an inflated stream into whole records, whatever pieces it comes in."""

    def __init__(self):
        self.held = bytearray()

    def feed(self, data: bytes) -> Iterator[bytes]:
        self.held += data
        at = 0
        while (end := self.held.find(b"\r\n\r\n", at)) >= 0:
            head = bytes(self.held[at:end])
            if not head.startswith(b"WARC/"):
                raise ValueError(f"no WARC record begins here: {head[:40]!r}")
            length = int(re.search(rb"(?im)^Content-Length:\s*(\d+)", head)[1])
            stop = end + 4 + length + 4
            if len(self.held) < stop:
                break
            yield bytes(self.held[at:stop])
            at = stop
        del self.held[:at]


def parse(raw: bytes) -> dict:
    """Page id, full payload length and digest, type and reference of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda x: int(fields[x]) if x in fields else None
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(re.search(rb"(?im)^Content-Length:\s*(\d+)", http)[1])
    if not revisit and (size != len(payload) or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return {"page_id": number("X-Page-ID"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page")}


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = file_system(folder)
        store.create_dir(path, recursive=True)
        out = None
        for batch in batches:
            for row in range(batch.num_rows):
                page_id, url, html, refers_to = (batch.column(k)[row].as_py() for k in range(4))
                payload = (html or "").encode("utf-8", "surrogatepass")
                if out is None:
                    name, size, n = f"{path}/whole-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, packer = store.open_output_stream(name, compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                out.write(packer.compress(record(page_id, url, payload, hashlib.sha1(payload).hexdigest(), refers_to)))
                size, n = size + len(payload), n + 1
                if size >= ARCHIVE_BYTES:
                    out.write(packer.flush())
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["archive", "records"])
        if out is not None:
            out.write(packer.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["archive", "records"])

    return run


def _normalise(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = file_system(folder)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                name = f"{path}/members-{uuid.uuid4().hex}.warc.gz"
                index, at, splitter, unpacker = [], 0, Splitter(), zlib.decompressobj(31)
                with store.open_input_stream(archive, compression=None) as source, store.open_output_stream(name, compression=None) as out:
                    while data := source.read(READ_BYTES):
                        for raw in splitter.feed(unpacker.decompress(data)):
                            packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                            member = packer.compress(raw) + packer.flush()
                            out.write(member)
                            index.append((at, len(member)))
                            at += len(member)
                    if not unpacker.eof or splitter.held:
                        raise ValueError(f"{archive} ends within a record")
                with store.open_output_stream(f"{name}.idx", compression=None) as out:
                    out.write("".join(f"{json.dumps({'offset': a, 'length': n})}\n" for a, n in index).encode())
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(index)], pa.int64())], ["archive", "records"])

    return run


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(folder)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                with store.open_input_stream(f"{archive}.idx", compression=None) as f:
                    index = [json.loads(x) for x in f.read().decode().splitlines()]
                rows = []
                with store.open_input_file(archive) as f:
                    for x in index:
                        f.seek(x["offset"])
                        rows.append(parse(zlib.decompress(f.read(x["length"]), 31)))
                yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    return run


SCHEMA = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_NAMES = "archive string, records long"
_ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record per page into monolithic archives under ``folder``; returns their names (archive, records).

    Of pages with equal payloads of ``REVISIT_BYTES`` or more, the one with the
    largest id is a response and the others are revisits of it.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    body = F.col("html").cast("binary")
    # Only a page with another of equal payload needs to know it; its row is told by id and digest, as ids may repeat.
    digests = durable(rows.select("id", F.sha1(body).alias("digest"), F.octet_length(body).alias("bytes")).where(f"bytes >= {REVISIT_BYTES}"), "digests")
    first = digests.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select("digest", "refers_to")
    refers = digests.join(first, "digest").where("id <> refers_to").select("id", "digest", "refers_to").distinct()
    rows = rows.withColumn("digest", F.when(F.octet_length(body) >= REVISIT_BYTES, F.sha1(body))).join(refers, ["id", "digest"], "left").select("id", "url", "html", "refers_to")
    return durable(rows.mapInArrow(_write(folder), _NAMES), "archives")


def _each(archives: DataFrame) -> DataFrame:
    """The archives' names, about one in a task: a name is short but its file is not, so partitions are not coalesced by size."""
    return archives.select("archive").repartition(max(1, min(archives.count(), MOST_TASKS)), "archive")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites monolithic archives into one gzip member per record with a sidecar index; returns the new names."""
    return durable(_each(archives).mapInArrow(_normalise(folder), _NAMES), "members")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """One row per record of normalised archives, found by their indexes; payloads are checked against their digests."""
    return _each(archives).mapInArrow(_read(folder), _ROWS)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archives every page, normalises the archives and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null page is an empty payload and a null address about:blank; rows without id
    are responses without id.  Rows of one id are records of their own, each judged by
    its own payload; equal ones are all responses if they are the largest id.  An empty
    table gives no archive and an empty result.
    """
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_archives(normalise(write_archives(pages, folder, id_col, url_col, html_col), folder), folder)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN top END AS refers_to FROM r
"""
