"""WARC archives: one gzip member per record, read back in byte ranges.

Writing: every task writes one archive file of its rows to the given folder, under a name no
other attempt uses, and reports it; files of lost attempts are in no report and never read.
Of records with equal payloads of at least ``REVISIT_BYTES`` bytes the one with the smallest
id is a response, the others revisit it.

Reading: files are cut into byte ranges. A task looks for the gzip magic in its range, takes
a place for a record only if it inflates to a WARC header of any length, and owns the records
that start inside its range; the last may end beyond it. The round trip fails if it reads
another number of records than were written.

Defined results: null html counts as empty; a null url gives a record without target. A null
id never is the response of others. Rows that repeat id and payload of a response are
responses too. An empty table gives an empty archive and result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from pixelstrata.llm.tables import stored
from pixelstrata.sources.storage import fresh_path

REVISIT_BYTES = 100
SPLIT_BYTES = 8 << 20
SMALL = 100_000  # repeated payloads up to which their table is sent to every task
LEVEL = 4
MAGIC = b"\x1f\x8b\x08"
STEP = 1 << 16
OPENING = b"WARC/1."
# Media types and the profile of the WARC 1.1 specification.
RESPONSE_TYPE = "application/http;msgtype=response"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One gzip member that holds a response, or a revisit without its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else quote(str(page_id), safe='')}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=~"))
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"Content-Type: {RESPONSE_TYPE}", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{quote(str(refers_to), safe='')}>"]
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def _revisits(pages: DataFrame) -> DataFrame:
    """digest, first: smallest id of each payload of REVISIT_BYTES or more that occurs again."""
    long = pages.where(f"bytes >= {REVISIT_BYTES}").groupBy("digest")
    return long.agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("digest", "first")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """path, size, records of the files written, from all rows of ``pages(page_id, url, html)``."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", body.alias("payload"))
    marked = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload"))
    again = stored(_revisits(marked.drop("payload", "url")), "warc-repeated")
    if again.count() <= SMALL:
        again = F.broadcast(again)
    first = F.when((F.col("bytes") >= REVISIT_BYTES) & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    todo = marked.join(again, "digest", "left").select("page_id", "url", "payload", "digest", first.alias("refers_to"))
    system, root = file_system(folder)
    system.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        path, size, records, out = f"{root}/part-{uuid.uuid4().hex}.warc.gz", 0, 0, None
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                out = out or system.open_output_stream(path, compression=None)
                member = record(page_id, url, payload, digest, refers_to)
                out.write(member)
                size, records = size + len(member), records + 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([records], pa.int64())], names=["path", "size", "records"])

    return stored(todo.mapInArrow(run, "path string, size bigint, records bigint"), "warc-files")


def _opens(data: bytes) -> bool:
    """Whether a gzip member that opens like a WARC record starts with these bytes."""
    try:
        return zlib.decompressobj(31).decompress(data, len(OPENING)) == OPENING
    except zlib.error:
        return False


def members(read, size: int, start: int, end: int) -> Iterator[bytes]:
    """Contents of the members that start in [start, end); ``read(offset, n)`` gives bytes of the file."""
    at = start
    held, base = b"", start
    while at < end:
        if at - base >= len(held) or len(held) - (at - base) < len(MAGIC):
            held, base = read(at, STEP), at
        found = held.find(MAGIC, at - base)
        if found < 0:
            if base + len(held) >= size:
                return
            at = base + len(held) - len(MAGIC) + 1
            held, base = read(at, STEP), at
            continue
        at = base + found
        if at >= end:
            return
        probe = held[found : found + STEP] if len(held) - found >= STEP or base + len(held) >= size else read(at, STEP)
        if not _opens(probe):
            at += 1
            continue
        inflate, parts, place = zlib.decompressobj(31), [], at
        data = probe
        while True:
            parts.append(inflate.decompress(data))
            place += len(data)
            if inflate.eof or place >= size:
                break
            data = read(place, STEP)
        if not inflate.eof:
            return  # the file was cut off inside this record
        content = b"".join(parts)
        if b"\r\n\r\n" not in content:
            at += 1
            continue
        yield content
        at = place - len(inflate.unused_data)


def parse(content: bytes) -> dict[str, str | bytes]:
    """Header fields by lower-case name, and the payload behind the HTTP header as '#payload'."""
    head, _, block = content.partition(b"\r\n\r\n")
    fields: dict[str, str | bytes] = {}
    for line in head.decode("utf-8").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.lower()] = value.strip()
    block = block[: int(fields["content-length"])]
    http, _, fields["#payload"] = block.partition(b"\r\n\r\n")
    for line in http.decode("latin-1").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields["http:" + name.lower()] = value.strip()
    return fields


def _page(urn: str | None) -> str | None:
    return None if urn is None else unquote(urn.removeprefix("<urn:page:").removesuffix(">")) or None


def read_archives(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """record_id, url, record_type, refers_to, payload_bytes, payload_digest, payload of every record of ``files(path, size)``.

    Bytes and digest of a response are those of the payload read; a revisit states its own.
    """
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("bigint")))
    ranges = files.where("size > 0").select("path", "size", starts.alias("start"))
    ranges = ranges.withColumn("end", F.least("size", F.col("start") + split_bytes)).repartition("path", "start")
    kinds = [("record_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = file_system(row["path"])
                rows, held = [], 0
                with system.open_input_file(path) as f:
                    for content in members(lambda offset, n: f.read_at(n, offset), row["size"], row["start"], row["end"]):
                        m = parse(content)
                        payload, digest, size = m["#payload"], m["warc-payload-digest"].removeprefix("sha256:"), int(m["http:content-length"])
                        if m["warc-type"] == "response":
                            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        url = m.get("warc-target-uri")
                        rows.append((_page(m["warc-record-id"]), None if url is None else unquote(url), m["warc-type"], _page(m.get("warc-refers-to")), size, digest, payload))
                        held += len(payload)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])

    return ranges.mapInArrow(run, "record_id string, url string, record_type string, refers_to string, payload_bytes bigint, payload_digest string, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, read back from archives of all pages."""
    kind = dict(pages.dtypes)["page_id"]
    files = write_archives(pages, fresh_path(pages.sparkSession, "warc"))
    read = read_archives(files).select(F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "url")
    read = stored(read, "warc-read")
    written, found = files.agg(F.sum("records")).first()[0] or 0, read.count()
    if found != written:
        raise ValueError(f"{found} records read of {written} written")
    return read
