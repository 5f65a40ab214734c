"""WARC archives of pages: written by tasks, read again by byte ranges.

Each record is a gzip member of its own. Of pages with equal payloads of at least ``MIN_BYTES``, the
one with the smallest ``page_id`` is stored as a response and the others as revisits that refer to it.

Reading splits files into byte ranges. A task looks for gzip's first bytes inside its range, takes a
place for a member's start only if what follows inflates to a WARC header whose length fits, and
owns the records that start inside the range, to their end beyond it. From one record to the
next it needs no search. So a range needs no index, and any number of tasks can read one file.

Tasks write files under names of their own; the manifest, a table that Spark commits, names those
of the attempts that counted.

Rules: a null ``html`` is an empty payload, a null ``url`` becomes ``urn:page``. A page with null id is a
response that nothing refers to. Rows that repeat the smallest id of a payload are responses all.
Line ends in a ``url`` are written as spaces. Columns besides these three are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import file_system, new_name, spread, written

MIN_BYTES = 100
FILE_BYTES, RANGE_BYTES, READ_BYTES = 64 << 20, 4 << 20, 256 << 10
# Fixed values of the formats: a gzip member's first bytes, WARC's first line, a revisit's profile.
_GZIP = b"\x1f\x8b\x08"
_VERSION = b"WARC/1.1\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"
_MANIFEST = pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])
_RECORDS = pa.schema(
    [
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("url", pa.string()),
    ]
)


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}').urn}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A record as a gzip member."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", re.sub(r"[\r\n]", " ", url) if url is not None else "urn:page"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        fields += [
            ("WARC-Profile", _PROFILE),
            ("WARC-Refers-To", _record_id(refers_to, digest)),
            ("X-Refers-To-Page-Id", str(refers_to)),
        ]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = _VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"
    packer = zlib.compressobj(wbits=31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def _write(batches: Iterator[pa.RecordBatch], folder: str, file_bytes: int) -> Iterator[pa.RecordBatch]:
    files, root = file_system(folder)
    out, name, size, records = None, "", 0, 0

    def close() -> pa.RecordBatch:
        out.close()
        row = ([name], [size], [records])
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, _MANIFEST)], schema=_MANIFEST)

    for batch in batches:
        for row in zip(*(batch[c] for c in ("page_id", "url", "html", "digest", "refers_to"))):
            page_id, url, html, digest, refers_to = (x.as_py() for x in row)
            if out is None:
                name, size, records = new_name("pages", ".warc.gz"), 0, 0
                out = files.open_output_stream(f"{root}/{name}", compression=None)
            member = record_bytes(page_id, url, (html or "").encode(), digest, refers_to)
            out.write(member)
            size, records = size + len(member), records + 1
            if size >= file_bytes:
                yield close()
                out = None
    if out is not None:
        yield close()


def write_warc(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all pages under ``folder`` (shared by all executors); the manifest of files comes back."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn(
        "digest", F.sha2(payload, 256)
    )
    # Only payloads that repeat; counted before the shuffle, so many copies are one row a task.
    firsts = (
        rows.where((F.octet_length("html") >= min_bytes) & F.col("page_id").isNotNull())
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    # AQE splits the pages of a payload with very many copies; the other side has one row for it.
    joined = rows.join(firsts, "digest", "left").withColumn(
        "refers_to", F.when(F.col("page_id") != F.col("first"), F.col("first"))
    )
    files, root = file_system(folder)
    files.create_dir(root, recursive=True)
    chosen = joined.select("page_id", "url", "html", "digest", "refers_to")
    return written(
        chosen.mapInArrow(lambda x: _write(x, folder, file_bytes), "file string, bytes long, records long"), "manifest"
    )


class _Source:
    """Bytes of a file from any place on, fetched piece by piece."""

    def __init__(self, source, size: int) -> None:
        self.source, self.size = source, size
        self.at, self.held = 0, b""

    def from_(self, place: int) -> bytes:
        """Some bytes that begin at ``place``; none at the end."""
        if not self.at <= place < self.at + len(self.held):
            self.at = place
            self.held = self.source.read_at(min(READ_BYTES, self.size - place), place) if place < self.size else b""
        return self.held[place - self.at :]


def _member(source: _Source, place: int) -> tuple[bytes, int] | None:
    """The member that starts at ``place`` and the place behind it; None if none does."""
    unpacker, made, at = zlib.decompressobj(wbits=31), bytearray(), place
    try:
        while not unpacker.eof:
            piece = source.from_(at)
            if not piece:
                return None
            made += unpacker.decompress(piece)
            if len(made) >= len(_VERSION) and not made.startswith(_VERSION):
                return None
            at += len(piece) - len(unpacker.unused_data)
    except zlib.error:
        return None
    return bytes(made), at


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields and block; None unless it is a whole WARC record."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    if not found or not raw.startswith(_VERSION):
        return None
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    size = int(fields.get("Content-Length", "-1"))
    return (fields, rest[:size]) if rest[size:] == b"\r\n\r\n" else None


def range_records(source, size: int, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records that start in [start, end) of a file."""
    reader, place, searching = _Source(source, size), start, True
    while place < end:
        if searching:
            held = reader.from_(place)
            found = held.find(_GZIP)
            if found < 0:
                # The first bytes may be cut by the end of what was fetched.
                place += max(len(held) - len(_GZIP) + 1, 1)
                continue
            place += found
            if place >= end:
                return
        member = _member(reader, place)
        record = parse_record(member[0]) if member else None
        if record is None:
            if not searching:
                raise ValueError(f"a record was expected at byte {place}")
            place += 1
            continue
        yield record
        place, searching = member[1], False


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    files, root = file_system(folder)
    for batch in batches:
        for task in batch.to_pylist():
            rows = []
            with files.open_input_file(f"{root}/{task['file']}") as source:
                for fields, block in range_records(source, task["bytes"], task["start"], task["end"]):
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if fields["WARC-Type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
                    number = lambda name: int(fields[name]) if fields.get(name) else None  # noqa: B023, E731
                    rows.append(
                        (
                            number("X-Page-Id"),
                            number("X-Payload-Length"),
                            digest,
                            fields["WARC-Type"],
                            number("X-Refers-To-Page-Id"),
                            fields["WARC-Target-URI"],
                        )
                    )
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, f.type) for x, f in zip(zip(*rows), _RECORDS)], schema=_RECORDS
                )


def read_warc(manifest: DataFrame, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row a record: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``,
    ``refers_to``, ``url``."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long")))
    ranges = manifest.where("bytes > 0").select("file", "bytes", starts.alias("start"))
    ranges = ranges.withColumn("end", F.least(F.col("start") + range_bytes, "bytes"))
    return spread(ranges, "file", "start").mapInArrow(
        lambda x: _read(x, folder),
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string",
    )
