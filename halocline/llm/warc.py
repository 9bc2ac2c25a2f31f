"""WARC: archives as one gzip stream each, normalised to a member per record with a sidecar offset index.

``write_archives`` writes records as they come from crawlers that compress a whole file at once. ``normalise``
inflates such a file in one pass and writes every record as a gzip member of its own, so that a record can be read
alone, with an index of (offset, length) beside it. ``read_archives`` reads records by those offsets. A record whose
payload of at least ``min_bytes`` another one has too is a revisit of the one with the largest id, without payload.

Files go to a folder that all executors share, through pyarrow's file systems. Each has a name that only one attempt of
a task uses, so repeated and speculative attempts never write the same file, and the manifest, a table, has those of the
attempts that count. Memory holds one record and one archive's index.

Cases: a null or empty payload is a response of 0 bytes. Rows with one id and one payload are alike: all are
responses where the id is the largest, else all are revisits. A null id can be written and read back; it is never
the target of a revisit, and its record's id is made of its place. A null url is left out, and so is one of a table
without such a column. Very long payloads are written whole. Empty tables give empty archives and no rows. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, table, written

_END = b"\r\n\r\n"
_GZIP = 31  # zlib's window bits for a gzip wrapper
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


@dataclass(frozen=True)
class WarcParameters:
    min_bytes: int = 1000
    archive_bytes: int = 16_000_000  # of records before compression, after which a task begins a new archive
    level: int = 6
    chunk: int = 1 << 20
    date: str = "2000-01-01T00:00:00Z"  # of pages that don't tell when they were fetched


def classify(pages: DataFrame, p: WarcParameters, key: str = "page_id", payload: str = "html", url: str = "url") -> DataFrame:
    """pages with payload as text, its size and digest, and refers_to: null for responses.

    Only digests are aggregated and joined before the last join, which is on the page's id; payloads that many pages
    share meet nowhere.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).alias("page_id"), (F.col(url) if url in pages.columns else F.lit(None)).cast("string").alias("url"), body.alias("body"), F.octet_length(body).cast("long").alias("payload_bytes"), F.sha1(body).alias("payload_digest"))
    large = rows.where((F.col("payload_bytes") >= p.min_bytes) & F.col("page_id").isNotNull()).select("page_id", "payload_digest")
    winners = large.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("low")).where("low < refers_to").drop("low")
    revisits = large.join(winners, "payload_digest").where("page_id <> refers_to").select("page_id", "payload_digest", "refers_to").distinct()
    return rows.join(written(revisits, "revisits"), ["page_id", "payload_digest"], "left")


def _record(page_id, url, body: bytes, size: int, digest: str, refers_to, date: str, place: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (body if refers_to is None else b"")
    name = f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{place} {digest}')}"
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), f"WARC-Record-ID: <{name}>".encode(), f"WARC-Date: {date}".encode(), f"WARC-Payload-Digest: sha1:{digest}".encode(), b"Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append(b"WARC-Target-URI: " + re.sub(rb"[\r\n]", b"", url.encode()))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>".encode(), b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return b"\r\n".join([*head, f"Content-Length: {len(block)}".encode()]) + _END + block + _END


def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in folder and not folder.startswith("file:"):
        return pafs.LocalFileSystem(), folder
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def write_archives(records: DataFrame, folder: str, p: WarcParameters) -> DataFrame:
    """A manifest (path, records) of the archives written to folder, each a single gzip stream."""

    def write(batches: Iterator[pa.RecordBatch]):
        fs, root = _opened(folder)
        fs.create_dir(root, recursive=True)
        task, number, out = TaskContext.get(), 0, None
        for batch in batches:
            for x in batch.to_pylist():
                if out is None:
                    path, held, count, pack = f"{root}/{task.partitionId():06d}-{task.taskAttemptId()}-{number:05d}.warc.gz", 0, 0, zlib.compressobj(1, wbits=_GZIP)
                    out = fs.open_output_stream(path, compression=None)
                record = _record(x["page_id"], x["url"], x["body"].encode(), x["payload_bytes"], x["payload_digest"], x["refers_to"], p.date, f"{task.partitionId()} {number} {count}")
                out.write(pack.compress(record))
                held, count = held + len(record), count + 1
                if held >= p.archive_bytes:
                    out.write(pack.flush())
                    out.close()
                    yield pa.RecordBatch.from_pydict({"path": [path], "records": [count]})
                    out, number = None, number + 1
        if out is not None:
            out.write(pack.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [count]})

    return records.mapInArrow(write, "path string, records long")


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records, each whole, of an inflated WARC stream that arrives in pieces."""
    held = bytearray()
    need = None
    for chunk in chunks:
        held += chunk
        while True:
            if need is None:
                at = held.find(_END)
                if at < 0:
                    break
                size = re.search(rb"\r\nContent-Length: *(\d+)", bytes(held[: at + 2]), re.I)
                if not held.startswith(b"WARC/") or not size:
                    raise ValueError("not a WARC record")
                need = at + 4 + int(size[1]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("the last record is cut off")


def inflated(source, chunk: int) -> Iterator[bytes]:
    """A gzip file's content in pieces, read and inflated once, also if it has several members."""
    z = zlib.decompressobj(_GZIP)
    while data := source.read(chunk):
        while data:
            yield z.decompress(data)
            data = z.unused_data
            if z.eof:
                z = zlib.decompressobj(_GZIP)
            else:
                break


def normalise(manifest: DataFrame, folder: str, p: WarcParameters) -> DataFrame:
    """Rewrites each archive with a member per record and a sidecar of offsets; a manifest of the new files."""

    def rewrite(batches):
        fs, root = _opened(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                new, index, at = f"{root}/{TaskContext.get().taskAttemptId()}-{os.path.basename(path)}", [], 0
                with fs.open_input_stream(path, compression=None) as source, fs.open_output_stream(new, compression=None) as out:
                    for record in split_records(inflated(source, p.chunk)):
                        pack = zlib.compressobj(p.level, wbits=_GZIP)
                        member = pack.compress(record) + pack.flush()
                        out.write(member)
                        index.append(f"{at} {len(member)}")
                        at += len(member)
                with fs.open_output_stream(f"{new}.idx", compression=None) as out:
                    out.write(json.dumps({"archive": os.path.basename(new), "records": len(index)}).encode() + b"\n" + "\n".join(index).encode())
                yield pa.RecordBatch.from_pydict({"path": [new], "records": [len(index)]})

    return manifest.mapInArrow(rewrite, "path string, records long")


def _field(head: bytes, name: bytes) -> str | None:
    found = re.search(rb"\r\n" + name + rb": *([^\r]*)", head, re.I)
    return found[1].decode() if found else None


def parse(record: bytes) -> dict:
    head, _, block = record.partition(_END)
    http, _, rest = block.partition(_END)
    page, target = _field(head, b"WARC-Record-ID"), _field(head, b"WARC-Refers-To")
    kind, size = _field(head, b"WARC-Type"), int(_field(http, b"Content-Length"))
    digest = _field(head, b"WARC-Payload-Digest").removeprefix("sha1:")
    if kind == "response":
        body = rest[: len(rest) - 4]
        if len(body) != size or hashlib.sha1(body).hexdigest() != digest:
            raise ValueError(f"the payload of {page} is not what its header says")
    number = lambda urn: int(urn[len("<urn:page:") : -1]) if urn and urn.startswith("<urn:page:") else None
    return {"page_id": number(page), "url": _field(head, b"WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(target)}


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives, each read alone at the offset that the sidecar has for it."""

    def read(batches):
        fs, _ = _opened(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with fs.open_input_stream(f"{path}.idx", compression=None) as side:
                    spots = [tuple(map(int, x.split())) for x in side.read().decode().split("\n")[1:] if x]
                rows = []
                with fs.open_input_file(path) as source:
                    for at, length in spots:
                        source.seek(at)
                        rows.append(parse(zlib.decompress(source.read(length), _GZIP)))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema=_schema())
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=_schema())

    return manifest.mapInArrow(read, RECORD)


def _schema() -> pa.Schema:
    return pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _spread(manifest: DataFrame) -> DataFrame:
    """One archive a task, as far as there are cores."""
    return manifest.repartition(max(1, min(manifest.count(), 10_000)))


def round_trip(pages: DataFrame, folder: str, p: WarcParameters | None = None) -> DataFrame:
    p = p or WarcParameters()
    records = classify(pages, p)
    raw = written(write_archives(records, f"{folder}/raw", p), "raw-manifest")
    ready = written(normalise(_spread(raw), f"{folder}/records", p), "manifest")
    return read_archives(_spread(ready), f"{folder}/records")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its WARC record tells it after being written, normalised and read back."""
    rows = round_trip(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
