"""Operator 2: WARC archives, written per page and read back in byte ranges.

*Writer.*  Every page becomes one record, each record one gzip member.  Of the
pages with equal payloads the one with the smallest page_id is written as
``response``, the others as ``revisit`` that refer to it (payloads below
``min_revisit`` bytes are always responses).  Which payloads repeat is found on
digests alone; only digests that do repeat are joined back.

*Reader.*  A file is cut into byte ranges without looking into it.  A task
scans its range for the gzip magic number, takes a hit for a member only if it
decodes to a WARC header, and owns every record that starts inside its range,
reading past the end to finish the last one.  So ranges of any size give every
record once.

Damage stops the job and never costs a record silently: a file begins with a
record; behind every record the next one must begin at once, or the file end
(the owner of a record looks, even past its range, so each record's head is
vouched for by the one before); a record that is cut short or whose data or
digest is wrong is an error; a file must have the size it was written with, and
``verified`` compares the number of records read from each file with the number
written.

Cases: a null html is an empty payload.  A null page_id is written without an
id and nothing refers to it; it refers to others.  Rows that repeat both page_id and payload
are records of their own and all take the same part.  An empty table gives no
file and an empty result.  Other columns are not read; a null url is empty.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np  # noqa: F401  (task code is shipped with this module)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcards.llm import ship, storage

SPLIT_BYTES = 8 << 20
FILE_BYTES = 256 << 20
BLOCK = 1 << 20
LEVEL = 4
TASKS_PER_CORE = 32
MAGIC = b"\x1f\x8b\x08"
MAX_BROADCAST = 200_000       # repeated digests sent to every executor
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = ("page_id long, url string, record_id string, record_type string, payload_bytes long, "
          "payload_digest string, refers_to_id string, path string, offset long")


def record_id(page_id) -> str:
    h = hashlib.md5(f"page {page_id}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, refers_to) -> bytes:
    """One gzip member with one WARC record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + b"Content-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 2024-01-01T00:00:00Z",
            f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def write_files(base: str, file_bytes: int):
    """Task code: pages -> archive files, a row (path, size, records) per file."""
    def run(batches):
        import os
        import uuid
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext
        files, root = fs.FileSystem.from_uri(base)
        files.create_dir(root, recursive=True)
        part, out, n, size, done = TaskContext.get().partitionId(), None, 0, 0, []
        held = 0

        def close():
            out.close()
            path = f"pages-{part:07d}-{n:04d}.warc.gz"
            files.move(tmp, f"{root}/{path}")      # replaces the file of an earlier attempt
            done.append((path, size, held))

        for batch in batches:
            for page_id, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if out is None:
                    tmp = f"{root}/.pages-{part}-{os.getpid()}-{uuid.uuid4().hex}"
                    out, size, held = files.open_output_stream(tmp), 0, 0
                raw = record(page_id, url, (html or "").encode(), refers)
                out.write(raw)
                size += len(raw)
                held += 1
                if size >= file_bytes:
                    close()
                    out, n = None, n + 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()),
                                          pa.array([d[1] for d in done], pa.int64()),
                                           pa.array([d[2] for d in done], pa.int64())], names=["path", "size", "records"])
    return run


def write_pages(pages: DataFrame, out_dir: str, min_revisit: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages (page_id, url, html)`` and return the files ``(path, size, records)``."""
    ship(__name__)
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html",
                        F.when(F.octet_length(payload) >= min_revisit, F.sha1(payload.cast("binary"))).alias("sha"))
    first = (rows.where("sha is not null").groupBy("sha").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
             .where("n > 1 and first is not null").select("sha", "first"))
    first = storage.cut(first, "repeated")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    return storage.cut(rows.join(storage.bounded(first, MAX_BROADCAST), "sha", "left")
                       .select("page_id", "url", "html", refers.alias("refers_to"))
                       .mapInArrow(write_files(out_dir, file_bytes), "path string, size long, records long"), "files")


class Window:
    """Random reads of a file through one block that is kept."""

    def __init__(self, f, size: int):
        self.f, self.size, self.at, self.held = f, size, 0, b""

    def read(self, at: int, n: int) -> bytes:
        if at < self.at or at + min(n, self.size - at) > self.at + len(self.held):
            self.at = at
            self.held = self.f.read_at(min(max(n, BLOCK), max(0, self.size - at)), at)
        return self.held[at - self.at:at - self.at + n]


def decode(window: Window, at: int):
    """(record bytes, length of the member) if a WARC member starts at ``at``."""
    unpack = zlib.decompressobj(31)
    out, pos, checked = [], at, False
    seen = b""
    while not unpack.eof:
        raw = window.read(pos, 1 << 14)
        if not raw:
            if checked:
                raise ValueError(f"record at {at} ends too early")
            return None
        try:
            part = unpack.decompress(raw)
        except zlib.error:
            if checked:
                raise
            return None
        pos += len(raw)
        out.append(part)
        if not checked:
            seen += part
            if len(seen) >= 7 or unpack.eof:
                if not seen.startswith(b"WARC/1."):
                    return None
                checked = True
    return b"".join(out), pos - len(unpack.unused_data) - at


def members(window: Window, start: int, end: int):
    """(offset, record bytes) of the records that start in [start, end)."""
    at, found = start, None
    if start == 0 and end > 0 and not begins(window, 0):
        raise ValueError("the file does not begin with a record")
    while at < end:                     # the first record of the range
        buf = window.read(at, 1 << 16)
        i = buf.find(MAGIC)
        if i < 0:
            if len(buf) < 3:
                break
            at += len(buf) - 2
            continue
        at += i
        if at >= end:
            return
        found = decode(window, at)
        if found is not None:
            break
        at += 1
    if found is None:
        return
    while True:                         # the others follow without a gap
        yield at, found[0]
        at += found[1]
        if at >= window.size:
            return
        if at >= end:
            if not begins(window, at):
                raise ValueError(f"no record begins at {at}, where the one before ends")
            return
        found = decode(window, at)
        if found is None:
            raise ValueError(f"no record begins at {at}, where the one before ends")


def begins(window: Window, at: int) -> bool:
    """Whether a gzip member with a WARC header begins at ``at``."""
    unpack, out, pos = zlib.decompressobj(31), b"", at
    while len(out) < 7 and not unpack.eof:
        raw = window.read(pos, 1 << 12)
        if not raw:
            return False
        try:
            out += unpack.decompress(raw, 64)
        except zlib.error:
            return False
        pos += len(raw)
    return out.startswith(b"WARC/1.")


def parse(raw: bytes):
    """(page_id, url, id, type, payload length, digest, refers to) of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    field = {}
    for line in head.decode().split("\r\n")[1:]:
        k, _, v = line.partition(":")
        field[k.strip().lower()] = v.strip()
    block = rest[:int(field["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    want = field.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = field["warc-type"]
    if kind == "response" and digest(payload) != want:
        raise ValueError(f"payload of {field['warc-record-id']} does not match its digest")
    page = field.get("warc-page-id")
    return (int(page) if page is not None else None, field.get("warc-target-uri"), field["warc-record-id"], kind,
            len(payload) if kind == "response" else None, want, field.get("warc-refers-to"))


def read_ranges(base: str):
    """Task code: (path, size, start, end) -> the records that start there."""
    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        files, root = fs.FileSystem.from_uri(base)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "url", "record_id", "record_type", "payload_bytes", "payload_digest", "refers_to_id", "path", "offset"]

        def pack(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for batch in batches:
            for path, size, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with files.open_input_file(f"{root}/{path}") as f:
                    if f.size() != size:
                        raise ValueError(f"{path} has {f.size()} bytes, {size} were written")
                    rows = []
                    for at, raw in members(Window(f, size), start, end):
                        rows.append((*parse(raw), path, at))
                        if len(rows) >= 5000:
                            yield pack(rows)
                            rows = []
                    yield pack(rows)
    return run


def read_archives(files: DataFrame, base: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of the files ``(path, size, ...)`` below ``base``."""
    ship(__name__)
    ranges = files.select("path", "size", F.explode(F.expr(f"sequence(0L, greatest(0L, size - 1), {split_bytes}L)")).alias("start"))
    ranges = ranges.withColumn("end", F.least(F.col("start") + split_bytes, F.col("size")))
    most = TASKS_PER_CORE * files.sparkSession.sparkContext.defaultParallelism      # a task reads many ranges
    return ranges.repartition(min(max(1, ranges.count()), most)).mapInArrow(read_ranges(base), RECORD)


def verified(records: DataFrame, files: DataFrame) -> DataFrame:
    """``records`` (stored), after the records of each file were counted."""
    read = records.groupBy("path").agg(F.count("*").alias("n"))
    wrong = files.join(read, "path", "full").where("not (records <=> n)").select("path", "records", "n").take(5)
    if wrong:
        raise ValueError(f"records lost or added: {[tuple(r) for r in wrong]}")
    return records


def page_records(records: DataFrame) -> DataFrame:
    """Revisits with the payload length and page_id of the response they name."""
    named = records.where("record_type = 'response' and page_id is not null").select(
        F.col("record_id").alias("refers_to_id"), F.col("payload_bytes").alias("_bytes"), F.col("page_id").alias("_page"),
        F.col("payload_digest")).distinct()
    visits = records.where("record_type = 'revisit'").join(named, ["refers_to_id", "payload_digest"], "left")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "path", "offset"]
    a = records.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(*cols)
    b = visits.select("page_id", F.col("_bytes").alias("payload_bytes"), "payload_digest", "record_type",
                      F.col("_page").alias("refers_to"), "url", "path", "offset")
    return a.unionByName(b)
