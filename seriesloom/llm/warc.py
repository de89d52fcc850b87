"""WARC archives: a writer with revisit records, and a reader that splits files by byte range.

Every record is a gzip member of its own. The reader cuts files into byte ranges. A task looks in its
range for the gzip magic, takes a place as a member only if its first bytes decode to a WARC header,
and then follows members from one to the next. It owns the records that start inside its range and
reads past the end of the range to finish the last one.

Writers stream: a task holds one record. A file gets its final name when it is complete, and only the
files that the finished tasks name are read, so a rerun task leaves no doubled records. Files lie in
the shared folder and are reached through ``pyarrow.fs``, which knows local and remote stores.

Archives of other writers are read too. Every record comes back, whatever its type, with its own id and the id
it refers to; ``page_id`` and ``refers_to`` are only known where an id has this writer's form. Length and digest of a
payload are computed, but for revisits: their digest is that of the header if it is SHA-1, and their length is NULL
unless the header has it. The payload of an HTTP response or request is what stands behind the HTTP head, as stored;
that of another record is its block. Lines that are no header field are passed over, and a record without a length
ends with its member. Only this writer's records are held against their digest. An archive stored in another one
without compression cannot be told from records where a range starts inside it: such files need one range.

Defined results: NULL html is an empty payload. Of equal payloads of at least ``revisit_bytes`` the
record with the largest id is a response and others revisit it; rows that repeat the largest id are
all responses, and a NULL id is never the largest unless all are NULL. A NULL url is left out of the
header. Control characters of a url are percent-encoded in the header. No rows: no files, no records.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.shared import partitions, salted_lookup, stage
from seriesloom.session import scratch_path

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 8 << 20
READ_BYTES = 1 << 20
REVISIT_BYTES = 1000
VERSION = b"WARC/1.1\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
DIGITS, PAGE = re.compile(r"[0-9]+"), re.compile(r"<urn:page:(-?[0-9]+)>")
HEX_DIGEST, BASE32_DIGEST = re.compile(r"[0-9A-Fa-f]{40}"), re.compile(r"[A-Za-z2-7]{32}")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FILES = "path string, size long"
RECORDS = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
    "payload binary, path string, at long, record_id string, refers_to_id string"
)
RECORD_SCHEMA = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
        ("path", pa.string()),
        ("at", pa.int64()),
        ("record_id", pa.string()),
        ("refers_to_id", pa.string()),
    ]
)


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else os.path.abspath(uri))


# --- writing --------------------------------------------------------------------------------


def _safe(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    block = b"" if kind == "revisit" else HTTP % len(payload) + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:page:{page_id}>",
        "WARC-Target-URI": None if url is None else _safe(url),
        "WARC-Date": "2024-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Payload-Length": str(len(payload)),
        "WARC-Refers-To": f"<urn:page:{refers_to}>" if kind == "revisit" else None,
        "WARC-Profile": PROFILE if kind == "revisit" else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None).encode()
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(VERSION + lines + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def _writer(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = _open(folder)
        name = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        size, out = 0, None
        try:
            for batch in batches:
                rest = [batch.column(c).to_pylist() for c in ("page_id", "url", "record_type", "refers_to")]
                for page, url, kind, refers, html in zip(*rest, batch.column("html"), strict=True):
                    if out is None:
                        store.create_dir(base, recursive=True)
                        out = store.open_output_stream(f"{name}.open", compression=None)
                    content = html.as_buffer().to_pybytes() if html.is_valid else b""
                    data = record(page, url, content, kind, refers)
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        if size:
            store.move(f"{name}.open", name)
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{os.path.basename(name)}"], "size": [size]})

    return run


def with_record_types(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html and what record each page gets: record_type, refers_to."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    big = F.octet_length(body) >= revisit_bytes
    keyed = rows.withColumn("content_", F.when(big, F.concat(F.sha1(body), F.octet_length(body).cast("string"))))
    groups = keyed.where("content_ is not null").groupBy("content_").agg(F.max("page_id").alias("last_"), F.count("*").alias("n_"))
    groups = stage(groups.where("n_ > 1").select("content_", "last_"), "payloads")
    found = salted_lookup(keyed, groups, "content_", ["page_id", "url"])
    again = F.col("last_").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last_"))
    return found.select(
        "page_id",
        "url",
        "html",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("last_")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write page_id, url, html as archives in ``folder``; the files as (path, size)."""
    typed = with_record_types(pages, revisit_bytes)
    return stage(typed.mapInArrow(_writer(folder), FILES), "archives")


# --- reading --------------------------------------------------------------------------------


class _Window:
    """Bytes of a file from a place on, read as they are wanted."""

    def __init__(self, stream: pa.NativeFile, at: int, size: int) -> None:
        self.stream, self.size, self.start, self.data = stream, size, at, b""
        stream.seek(at)

    def more(self) -> bool:
        got = self.stream.read(READ_BYTES)
        self.data += got
        return bool(got)

    def forget(self, at: int) -> None:
        self.data, self.start = self.data[at - self.start :], at


def _member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The decoded member at a place and where it ends; None if no WARC record starts there."""
    unpacker, decoded, checked = zlib.decompressobj(31), [], False
    place, head = at, b""
    while not unpacker.eof:
        while place >= window.start + len(window.data):
            if not window.more():
                return None
        chunk = window.data[place - window.start :][: 1 << 16]
        try:
            got = unpacker.decompress(chunk)
        except zlib.error:
            return None
        place += len(chunk) - len(unpacker.unused_data)
        decoded.append(got)
        if not checked:
            head += got
            if not head.startswith(b"WARC/1."[: len(head)]):
                return None
            checked = len(head) >= 7
    return (b"".join(decoded), place) if checked else None


def members(stream: pa.NativeFile, size: int, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, decoded record) of the records that start in [begin, end)."""
    window, at = _Window(stream, begin, size), begin
    while at < end:
        k = window.data.find(MAGIC, at - window.start)
        if k < 0:
            at = max(at, window.start + len(window.data) - 2)  # the magic may lie across two reads
            window.forget(at)
            if not window.more():
                return
            continue
        at = window.start + k
        if at >= end:
            return
        if (found := _member(window, at)) is None:
            at += 1
            continue
        yield at, found[0]
        at = found[1]
        window.forget(at)


class Record(NamedTuple):
    head: dict[str, str]
    payload: bytes


def parse(data: bytes) -> Record:
    """A decoded record: header by lower-case name, and the payload, which stands behind the HTTP head if there is one."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = (line.partition(":") for line in head.decode(errors="replace").split("\r\n")[1:])
    named = {k.strip().lower(): v.strip() for k, colon, v in fields if colon}
    length = named.get("content-length", "")
    block = rest[: int(length)] if DIGITS.fullmatch(length) else rest.removesuffix(b"\r\n\r\n")
    if named.get("warc-type") == "revisit":
        return Record(named, b"")
    http = named.get("content-type", "").lower().startswith("application/http")
    return Record(named, block.partition(b"\r\n\r\n")[2] if http else block)


def _page(text: str | None) -> int | None:
    found = PAGE.fullmatch(text or "")
    return int(found[1]) if found else None


def _stated_digest(text: str) -> str | None:
    """A stated SHA-1, in base 32 or hex, as hex; None for any other."""
    name, _, value = text.partition(":")
    if name.lower() != "sha1":
        return None
    if HEX_DIGEST.fullmatch(value):
        return value.lower()
    return base64.b32decode(value.upper()).hex() if BASE32_DIGEST.fullmatch(value) else None


def _row(path: str, at: int, data: bytes) -> tuple:
    head, payload = parse(data)
    stated = head.get("x-payload-length", "")
    length = int(stated) if DIGITS.fullmatch(stated) else None
    digest, kind = _stated_digest(head.get("warc-payload-digest", "")), head.get("warc-type")
    if kind != "revisit":
        known = len(payload), hashlib.sha1(payload).hexdigest()
        if length is not None and known != (length, digest):
            raise ValueError(f"damaged record in {path} at {at}")
        length, digest = known
    name, refers = head.get("warc-record-id"), head.get("warc-refers-to")
    page, url = _page(name), head.get("warc-target-uri")
    return page, url, kind, _page(refers), length, digest, payload, path, at, name, refers


def _reader(payloads: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                store, name = _open(part["path"])
                rows, held = [], 0
                with store.open_input_file(name) as stream:
                    for at, data in members(stream, part["size"], part["begin"], part["end"]):
                        row = _row(part["path"], at, data)
                        rows.append(row if payloads else (*row[:6], None, *row[7:]))
                        held += len(row[6]) * payloads + 200
                        if held > READ_BYTES:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RECORD_SCHEMA, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=RECORD_SCHEMA)


def read_archives(files: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """The records of archives (path, size), read by byte ranges; see RECORDS for the columns."""
    begin = F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(range_bytes)))
    ranges = files.where("size > 0").select("path", "size", begin.alias("begin"))
    ranges = ranges.withColumn("end", F.least("size", F.col("begin") + range_bytes))
    return ranges.repartition(partitions(files), "path", "begin").mapInArrow(_reader(payloads), RECORDS)


def archive_folder(pages: DataFrame) -> str:
    return scratch_path(pages.sparkSession, "warc")
