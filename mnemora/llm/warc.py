"""WARC archives with a two-level capture index.

Writing: a row becomes one gzip-compressed WARC/1.1 record, a response or, where an earlier row
has the same payload of at least ``min_bytes`` bytes, a revisit without payload. Tasks write
files of at most about ``file_bytes`` to the folder and return a capture a record: URL key
(reversed host), file, offset, length.

Index: captures are sorted by key over the whole table; every ``BLOCK_LINES`` lines are one
compressed block in an index file, and a directory keeps the first key, file, offset and length
of each block.

Lookup: binary search in the directory, range reads of the blocks in question, then range
reads of the records, in file order. The directory is shipped to tasks in slices of at most
``DIRECTORY_SLICE`` rows (20 MB or so), so what is broadcast is bounded.

Archives and index files lie in the folder given, by any path that ``pyarrow.fs`` opens.
A task that is run again writes new files; only those of the attempt that counted are indexed.
"""

from __future__ import annotations

import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

BLOCK_LINES = 3000
DIRECTORY_SLICE = 200_000
CAPTURE = "urlkey string, page_id long, file string, at long, length long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
CRLF = b"\r\n"


def url_key(url: Column, page: Column | None = None) -> Column:
    """``com,example,www)/path?query``: the host reversed, in lower case, before the rest. A URL
    without scheme and host is its own key behind ``)``. A null or empty one has the key of its
    ``page``, if that is given, ``)page:<id>``, so that such rows share no key."""
    u = F.coalesce(url, F.lit(""))
    if page is not None:
        u = F.when(u == "", F.concat(F.lit("page:"), F.coalesce(page.cast("string"), F.lit("")))).otherwise(u)
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    return F.translate(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest), "\n\t\r", "   ")


def _gz(raw: bytes, level: int = 3) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _one_line(text: str) -> str:
    return " ".join(text.split("\n")).replace("\r", " ")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool) -> bytes:
    """One WARC record. Its id names the page; a revisit names the page it refers to. The payload
    is carried as the body of an HTTP response."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_one_line(url or '')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>"]
    return "\r\n".join(lines).encode() + CRLF + CRLF + body + CRLF + CRLF


def parse_record(raw: bytes) -> dict:
    """The fields of a decompressed record; payload is null for a revisit, whose size and digest
    come from its headers."""
    cut = raw.index(CRLF + CRLF)
    lines = raw[:cut].decode().split("\r\n")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = raw[cut + 4 : cut + 4 + int(head["Content-Length"])]
    end = body.index(CRLF + CRLF)
    size = int(next(x for x in body[:end].split(CRLF) if x.startswith(b"Content-Length"))[15:])
    page = lambda x: int(x[10:-1]) if x and x[10:-1] else None  # noqa: E731  <urn:page:N>
    kind, payload = head["WARC-Type"], body[end + 4 :]
    digest = head["WARC-Payload-Digest"][7:]
    if kind == "response":
        digest = hashlib.sha256(payload).hexdigest()
    return {"page_id": page(head["WARC-Record-ID"]), "url": head["WARC-Target-URI"], "record_type": kind, "refers_to": page(head.get("WARC-Refers-To")), "payload_bytes": len(payload) if kind == "response" else size, "payload_digest": digest, "payload": payload if kind == "response" else None}


def _open(folder: str):
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        raise ValueError("name the folder with its scheme, so that all executors mean the same one")
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    return system, path


def mark_revisits(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """Add ``_digest`` and ``_first``, the smallest id with the same payload (null where only one
    row has it, or none with an id). Only digests of payloads that occur twice or more meet the
    rows, and counts are made before the shuffle; the rows move once, by digest, with their payload,
    unless those digests are few enough for Spark to bring them to the rows."""
    body = pages.withColumn(payload_col, F.coalesce(F.col(payload_col), F.lit(""))).withColumn("_digest", F.sha2(F.col(payload_col), 256))
    long_ones = body.filter(F.octet_length(payload_col) >= min_bytes)
    firsts = long_ones.groupBy("_digest").agg(F.min(id_col).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("_digest").alias("_d"), "_first")
    return body.join(firsts, F.col("_digest") == F.col("_d"), "left").drop("_d")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 100, file_bytes: int = 256 << 20) -> DataFrame:
    """Write a record for every row, and return the captures (``CAPTURE``), as a written table.

    Null payloads and URLs are empty. Rows that repeat the smallest id of a payload are all
    responses. A payload in a row without id is a revisit wherever a row with an id has it.
    Extra columns aren't archived.
    """
    rows = mark_revisits(pages.select(id_col, url_col, payload_col), id_col, payload_col, min_bytes)
    rows = rows.select(url_key(F.col(url_col), F.col(id_col)).alias("urlkey"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(payload_col).alias("payload"), F.col("_digest").alias("digest"), F.col("_first").alias("first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        out, name, at = None, "", 0
        try:
            for b in batches:
                cols = [b.column(i) for i in range(b.num_columns)]
                found = []
                for key, page, url, payload, digest, first in zip(*cols, strict=True):
                    page, first = page.as_py(), first.as_py()
                    raw = _gz(record_bytes(page, url.as_py(), payload.as_buffer().to_pybytes() if hasattr(payload, "as_buffer") and payload.is_valid else b"", digest.as_py(), first, first is not None and page != first))
                    if out is None or at + len(raw) > file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"capture-{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{path}/{name}", compression=None)
                    out.write(raw)
                    found.append((key.as_py(), page, name, at, len(raw)))
                    at += len(raw)
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["urlkey", "page_id", "file", "at", "length"])
        finally:
            if out is not None:
                out.close()

    return stash(rows.mapInArrow(write, CAPTURE), "captures")


def write_index(captures: DataFrame, folder: str, parts: int | None = None) -> DataFrame:
    """Write the index files and return the directory: ``first, file, at, length``, a row a block.
    Captures that tie are all written; without captures there is no block."""
    n = parts or int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.repartitionByRange(n, "urlkey", "page_id", "file", "at").sortWithinPartitions("urlkey", "page_id", "file", "at")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        out, name, at, lines = None, f"index-{uuid.uuid4().hex}.gz", 0, []
        rows = []

        def flush() -> None:
            nonlocal out, at
            if out is None:
                out = system.open_output_stream(f"{path}/{name}", compression=None)
            raw = zlib.compress("\n".join("\t".join(map(str, x)) for x in lines).encode(), 6)
            out.write(raw)
            rows.append((lines[0][0], name, at, len(raw)))
            at += len(raw)
            lines.clear()

        for b in batches:
            for key, page, file, start, length in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                lines.append((key, "" if page is None else page, file, start, length))
                if len(lines) == BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["first", "file", "at", "length"])

    return stash(ordered.mapInArrow(write, "first string, file string, at long, length long"), "directory")


def lookup(directory: DataFrame, folder: str, keys: DataFrame) -> DataFrame:
    """The captures of every key in ``keys`` (column urlkey), by way of the two levels. Repeated and
    null keys count once and not at all; keys that no capture has give no rows.

    First a binary search in the directory tells for every key its blocks. Then the blocks are read,
    each by one range read with all keys that need it; so a key that has very many captures is
    spread over as many blocks, and no list of them is ever held."""
    spark = keys.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = keys.select("urlkey").filter("urlkey is not null").distinct()
    order = ["first", "file", "at"]
    found, after = None, None
    while True:
        rest = directory if after is None else directory.filter(F.struct(*order) >= F.struct(*[F.lit(x) for x in after]))
        rows = [tuple(r) for r in rest.orderBy(*order).limit(DIRECTORY_SLICE + 1).collect()]
        if not rows:
            break
        last = len(rows) <= DIRECTORY_SLICE
        held = spark.sparkContext.broadcast((rows[:DIRECTORY_SLICE], None if last else rows[DIRECTORY_SLICE][0], after is None))

        def blocks_of(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            blocks, upper, lowest = held.value
            firsts = [x[0] for x in blocks]
            for b in batches:
                out = []
                for key in b.column(0).to_pylist():
                    if not lowest and key < firsts[0] or upper is not None and key > upper:
                        continue
                    i = max(0, bisect.bisect_left(firsts, key) - 1)
                    while i < len(blocks) and firsts[i] <= key:
                        out.append((key, *blocks[i][1:]))
                        i += 1
                        if len(out) >= 10_000:
                            yield pa.RecordBatch.from_pylist([dict(zip(NEEDED.names, x, strict=True)) for x in out], NEEDED)
                            out = []
                yield pa.RecordBatch.from_pylist([dict(zip(NEEDED.names, x, strict=True)) for x in out], NEEDED)

        part = wanted.mapInArrow(blocks_of, "urlkey string, file string, at long, length long")
        found = part if found is None else found.unionByName(part)
        if last:
            break
        after = rows[DIRECTORY_SLICE][:3]
    if found is None:
        return spark.createDataFrame([], CAPTURE)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        here, names, got = None, [], []
        for b in batches:
            out = []
            for key, file, at, length in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if here != (file, at):
                    here = (file, at)
                    with system.open_input_file(f"{path}/{file}") as f:
                        got = [x.split("\t") for x in zlib.decompress(f.read_at(length, at)).decode().split("\n")]
                    names = [x[0] for x in got]
                i = bisect.bisect_left(names, key)
                while i < len(names) and names[i] == key:
                    out.append(got[i])
                    i += 1
                if len(out) >= 10_000:
                    yield _captures(out)
                    out = []
            yield _captures(out)

    near = found.repartition(n, "file", "at").sortWithinPartitions("file", "at", "urlkey")
    return near.mapInArrow(read, CAPTURE)


NEEDED = pa.schema([("urlkey", pa.string()), ("file", pa.string()), ("at", pa.int64()), ("length", pa.int64())])


def _captures(lines: list[list[str]]) -> pa.RecordBatch:
    """Lines of the index as a batch."""
    return pa.RecordBatch.from_arrays(
        [pa.array([x[0] for x in lines], pa.string()), pa.array([int(x[1]) if x[1] else None for x in lines], pa.int64()), pa.array([x[2] for x in lines], pa.string()), *(pa.array([int(x[j]) for x in lines], pa.int64()) for j in (3, 4))],
        ["urlkey", "page_id", "file", "at", "length"],
    )


def read_records(captures: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Read the records of captures (``RECORD``), each by a range read; records that lie near each
    other are read by the same task, in file order. Repeated captures are read as often; no captures
    give no records."""
    near = captures.repartition("file", F.expr("at div 16777216")).sortWithinPartitions("file", "at")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        name, f = None, None
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        for b in batches:
            for part in (b.slice(i, 500) for i in range(0, b.num_rows, 500)):
                out = []
                for file, at, length in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                    if file != name:
                        if f is not None:
                            f.close()
                        name, f = file, system.open_input_file(f"{path}/{file}")
                    rec = parse_record(zlib.decompress(f.read_at(length, at), 31))
                    if not with_payload:
                        rec["payload"] = None
                    out.append(tuple(rec.values()))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])
        if f is not None:
            f.close()

    return near.mapInArrow(read, RECORD)
