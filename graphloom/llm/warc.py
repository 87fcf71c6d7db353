"""WARC archives: writing with segments and revisits, and reading with reassembly.

Each page becomes a ``response`` record whose block is an HTTP response in chunked transfer
framing. Of pages with equal payloads (of ``least_revisit`` bytes or more) the one with the
smallest id is stored; the others are ``revisit`` records whose ``WARC-Refers-To`` is that record's id. A block longer than
``segment`` bytes is split: the first part stays in the response record, the others go to
``continuation`` records with the origin's id and their number, the last with the total length.

Archives are gzip members, one per record, in files below a folder of the shared file system that
all tasks reach (any that ``pyarrow.fs`` opens by URI). A task that is run again writes files of a
new name; only files in the manifest, which is checkpointed, are ever read.

Reading parses the files once, as a stream. Whole records are decoded at once and kept, with the
segments, as Parquet in the checkpoint folder; segments are dealt by origin id, sorted by number and
decoded as a stream. Wrong lengths, numbers, framing or digests raise.

Null urls count as empty, null payloads too. Null ids are larger than all others and never named by
a revisit unless the payload has no other page (then all its pages are stored). Rows that repeat
the smallest id are each stored; revisits refer to the first of them. Record ids hold the row's place
in the table, which must give the same rows in the same partitions when read again. Pages of any
length are taken whole. An empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.sidecar import filesystem, new_folder

CHUNK = 8192
FILE_BYTES = 64 << 20
#: Payloads that occur more than once: so many of them at most are broadcast.
MOST_BROADCAST = 100_000
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
RECORDS = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(part := payload[i : i + CHUNK]), part) for i in range(0, len(payload), CHUNK)]
    return b"".join(parts) + b"0\r\n\r\n"


class ChunkedReader:
    """Takes an HTTP response's bytes piece by piece and gives the payload without its framing."""

    def __init__(self) -> None:
        self.buffer, self.left, self.state = b"", 0, "head"
        self.payload: list[bytes] = []

    def feed(self, data: bytes) -> None:
        self.buffer += data
        while True:
            if self.state == "head":
                end = self.buffer.find(b"\r\n\r\n")
                if end < 0:
                    return
                if b"transfer-encoding: chunked" not in self.buffer[:end].lower():
                    raise ValueError("the response isn't chunked")
                self.buffer, self.state = self.buffer[end + 4 :], "size"
            elif self.state == "size":
                end = self.buffer.find(b"\r\n")
                if end < 0:
                    return
                self.left = int(self.buffer[:end].split(b";")[0], 16)
                self.buffer = self.buffer[end + 2 :]
                self.state = "data" if self.left else "tail"
            elif self.state == "data":
                if self.left:
                    part = self.buffer[: self.left]
                    if not part:
                        return
                    self.payload.append(part)
                    self.left -= len(part)
                    self.buffer = self.buffer[len(part) :]
                    continue
                if len(self.buffer) < 2:
                    return
                if self.buffer[:2] != b"\r\n":
                    raise ValueError("a chunk doesn't end where its size says")
                self.buffer, self.state = self.buffer[2:], "size"
            elif self.state == "tail":
                if len(self.buffer) < 2:
                    return
                if self.buffer[:2] != b"\r\n":
                    raise ValueError("the last chunk has a trailer")
                self.buffer, self.state = self.buffer[2:], "done"
            else:
                if self.buffer:
                    raise ValueError("bytes follow the last chunk")
                return

    def finish(self) -> bytes:
        if self.state != "done":
            raise ValueError("the response ends early")
        return b"".join(self.payload)


def record(fields: dict[str, object], block: bytes) -> bytes:
    """One WARC record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    raw = b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block)
    return packer.compress(raw) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def record_id(page_id, row: int) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{row}>"


def page_records(page_id, url: str, payload: bytes, refers_to: tuple[int, int] | None, row: int, segment: int, date: str) -> list[bytes]:
    """The records of a page; ``refers_to``: page and row of the stored one."""
    digest = "sha1:" + sha1_base32(payload)
    own = record_id(page_id, row)
    fields = {"WARC-Type": "response", "WARC-Record-ID": own, "WARC-Date": date, "WARC-Target-URI": url.replace("\\", "\\\\").replace("\r", "\\r").replace("\n", "\\n"), "WARC-Payload-Digest": digest, "Content-Type": "application/http;msgtype=response", "Page-Id": page_id}
    if refers_to is not None:
        fields |= {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(*refers_to), "Payload-Length": len(payload)}
        return [record(fields, b"")]
    block = _HTTP + chunked(payload)
    if len(block) <= segment:
        return [record(fields, block)]
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = [record(fields | {"WARC-Segment-Number": 1}, parts[0])]
    for number, part in enumerate(parts[1:], 2):
        more = {"WARC-Type": "continuation", "WARC-Record-ID": f"{own[:-1]}:{number}>", "WARC-Date": date, "WARC-Segment-Origin-ID": own, "WARC-Segment-Number": number}
        if number == len(parts):
            more["WARC-Segment-Total-Length"] = len(block)
        out.append(record(more, part))
    return out


def write(pages: DataFrame, folder: str, least_revisit: int = 0, segment: int = 16384, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archives of ``page_id``, ``url``, ``html`` below ``folder`` (a URI all tasks reach); returns their paths."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    keyed = rows.withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("size", F.octet_length("payload")).withColumn("row", F.monotonically_increasing_id())
    # only payloads that occur more than once matter; ids and digests alone are grouped
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row"))
    copies = keyed.where(F.col("size") >= least_revisit).groupBy("digest").agg(F.min(named).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first").checkpoint()
    few = copies.count() <= MOST_BROADCAST
    joined = keyed.join(F.broadcast(copies) if few else copies, "digest", "left")
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("first.page_id"))
    rows = joined.select("page_id", "url", "payload", "row", *(F.when(other, F.col(f"first.{c}")).alias(f"first_{c}") for c in ("page_id", "row")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = filesystem(folder)
        files.create_dir(root, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex}"
        made: list[tuple[str, int, int]] = []
        stream, size, count = None, 0, 0
        for batch in batches:
            for page_id, url, payload, row, first, first_row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stream is None:
                    path = f"{root}/{name}-{len(made)}.warc.gz"
                    stream, size, count = files.open_output_stream(path, compression=None), 0, 0
                for one in page_records(page_id, url, payload, None if first is None else (first, first_row), row, segment, date):
                    stream.write(one)
                    size, count = size + len(one), count + 1
                if size >= FILE_BYTES:
                    stream.close()
                    made.append((path, size, count))
                    stream = None
        if stream is not None:
            stream.close()
            made.append((path, size, count))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], names=["path", "bytes", "records"])

    return rows.mapInArrow(run, "path string, bytes long, records long").checkpoint()


def parse_records(read, size: int = 1 << 16) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and blocks, from a function that reads bytes of a gzip stream."""
    raw, pending = b"", b""
    unpack = zlib.decompressobj(31)

    def more() -> bool:
        nonlocal raw, pending, unpack
        while True:
            if unpack.eof:
                pending, unpack = unpack.unused_data + pending, zlib.decompressobj(31)
            if not pending:
                pending = read(size)
                if not pending:
                    return False
            got = unpack.decompress(pending)
            pending = b""
            raw += got
            if got:
                return True

    while raw or more():
        while (end := raw.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError("a record's header ends early")
        first, *lines = raw[:end].decode().split("\r\n")
        if not first.startswith("WARC/1."):
            raise ValueError("a record doesn't begin with its version")
        fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
        length = int(fields["content-length"])
        while len(raw) < end + 4 + length + 4:
            if not more():
                raise ValueError("a record's block ends early")
        block = raw[end + 4 : end + 4 + length]
        if raw[end + 4 + length : end + 8 + length] != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        raw = raw[end + 8 + length :]
        yield fields, block


def _row(fields: dict[str, str], payload: bytes | None) -> dict:
    page_id, refers = fields.get("page-id"), fields.get("warc-refers-to")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if payload is not None and sha1_base32(payload) != digest:
        raise ValueError("a payload's digest is wrong")
    return {
        "page_id": None if page_id is None else int(page_id), "url": _plain(fields["warc-target-uri"]), "record_type": fields["warc-type"], "payload": payload,
        "payload_bytes": int(fields["payload-length"]) if payload is None else len(payload), "payload_digest": digest, "refers_to": None if refers is None else int(refers.split(":")[2]),
    }


def _plain(uri: str) -> str:
    out, i = [], 0
    while i < len(uri):
        if uri[i] == "\\":
            out.append({"r": "\r", "n": "\n"}.get(uri[i + 1], uri[i + 1]))
            i += 1
        else:
            out.append(uri[i])
        i += 1
    return "".join(out)


_PAGE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
_PARTS = pa.schema([*_PAGE, ("origin", pa.string()), ("number", pa.int64()), ("total", pa.int64()), ("fields", pa.string()), ("part", pa.binary())])


def _emit(rows: Iterator[dict], schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.get("payload") or b"") + len(row.get("part") or b"") + 200
        if size >= most:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def read_segments(manifest: DataFrame) -> DataFrame:
    """The records of the archives: whole pages, and parts of segmented ones (``origin`` is set)."""

    def records(paths: Iterator[str]) -> Iterator[dict]:
        for path in paths:
            files, local = filesystem(path)
            with files.open_input_stream(local, compression=None) as stream:
                for fields, block in parse_records(stream.read):
                    kind, number = fields["warc-type"], fields.get("warc-segment-number")
                    if kind == "revisit":
                        yield _row(fields, None)
                    elif number is None:
                        reader = ChunkedReader()
                        reader.feed(block)
                        yield _row(fields, reader.finish())
                    else:
                        total = fields.get("warc-segment-total-length")
                        origin = fields["warc-segment-origin-id"] if kind == "continuation" else fields["warc-record-id"]
                        head = "\r\n".join(f"{k}: {v}" for k, v in fields.items()) if kind == "response" else None
                        yield {"origin": origin, "number": int(number), "total": None if total is None else int(total), "fields": head, "part": block}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _emit(records(p for batch in batches for p in batch.column(0).to_pylist()), _PARTS)

    return manifest.select("path").mapInArrow(run, f"{RECORDS}, origin string, number long, total long, fields string, part binary")


def reassemble(parts: DataFrame) -> DataFrame:
    """Pages from segments, which are dealt by their origin's id and read in order."""
    rows = parts.select("origin", "number", "total", "fields", "part").repartition("origin").sortWithinPartitions("origin", "number")

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        origin = reader = fields = total = None
        expected = length = 0

        def finish() -> dict:
            if total is None or total != length:
                raise ValueError(f"{origin}: {length} bytes in segments, {total} by the last one")
            return _row(dict(line.split(": ", 1) for line in fields.split("\r\n")), reader.finish())

        for batch in batches:
            for key, number, of, head, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != origin:
                    if origin is not None:
                        yield finish()
                    origin, reader, fields, total, expected, length = key, ChunkedReader(), head, None, 1, 0
                if number != expected:
                    raise ValueError(f"{origin}: segment {number} where {expected} should be")
                reader.feed(part)
                expected, length, total = expected + 1, length + len(part), of if of is not None else total
        if origin is not None:
            yield finish()

    return rows.mapInArrow(lambda batches: _emit(pages(batches), _PAGE), RECORDS)


def read(manifest: DataFrame) -> DataFrame:
    """One row per page of the archives; a revisit has no payload, but its length and digest."""
    spark, folder = manifest.sparkSession, new_folder(manifest.sparkSession, "warc-records")
    parsed = read_segments(manifest)
    parsed.withColumn("whole", F.col("origin").isNull()).write.partitionBy("whole").parquet(folder)
    records = spark.read.schema(parsed.schema.add("whole", "boolean")).parquet(folder)
    return records.where("whole").select(*_PAGE.names).unionByName(reassemble(records.where("not whole")))
