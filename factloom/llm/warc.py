"""WARC writing and sequential reading.

An archive is a run of gzip members, one per record, held as one binary value of bounded size, so that archives are a
table which any executor can write to and read from any store (``read_archives`` takes files just as well, through
Spark's ``binaryFile`` source, whoever wrote them). The reader walks an archive once: it inflates a member piece by piece,
frames the record by its Content-Length, and verifies the digests of block and payload, whatever algorithm (of hashlib) and
spelling (base 16, 32 or 64) they come in. A record's type says what its block is: of responses, requests and revisits a
message of HTTP, whose payload is what follows its header, chunks joined; of all others the payload itself. The block's
frame counts, not the message's own Content-Length, which may be missing or be that of another coding. A truncated payload
is not held against its digest. Whatever is wrong with a record or its member is a CorruptRecord, or a row of its own.

Defined results: null html is an empty payload; a null url leaves the target out; rows that repeat a page_id are records
of their own, and each row with the smallest page_id of its payload is a response; a null page_id never is the smallest
where there is another. Extra columns are ignored; an empty table gives no archives. A payload of any length is one value
of a row. Records of others have no page_id unless their id has the form of ours; a revisit has no payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from contextlib import suppress
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

#: Payloads of fewer bytes are always responses of their own.
LEAST_REVISIT = 100
ARCHIVE_BYTES = 4 << 20
_CHUNK = 1 << 16
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class CorruptRecord(ValueError):
    """A record whose framing or digest is wrong."""


def _digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def _header(first: bytes, fields: list[tuple[str, str | None]]) -> bytes:
    lines = [first] + [f"{k}: {re.sub(r'[\x00-\x1f\x7f]', lambda m: f'%{ord(m[0]):02X}', v)}".encode() for k, v in fields if v is not None]
    return b"\r\n".join(lines) + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member: a response with its payload, or a revisit that keeps the payload's length and digest only."""
    http = _header(b"HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = _header(
        VERSION,
        [
            ("WARC-Type", "revisit" if revisit else "response"),
            ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
            ("WARC-Date", date),
            ("WARC-Target-URI", url),
            ("WARC-Refers-To", f"<urn:page:{refers_to}>" if revisit else None),
            ("WARC-Profile", PROFILE if revisit else None),
            ("WARC-Payload-Digest", _digest(payload)),
            ("WARC-Block-Digest", _digest(block)),
            ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", str(len(block))),
        ],
    )
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head + block + b"\r\n\r\n") + pack.flush()


def _fields(lines: bytes) -> tuple[str, dict[str, str]]:
    """The first line of a header and its fields; a blank after the colon is optional, and a line that begins with one goes on."""
    first, *rest = re.split(r"\r?\n", lines.decode("utf-8", "replace"))
    fields: list[list[str]] = []
    for line in rest:
        if line[:1] in (" ", "\t") and fields:
            fields[-1][1] += " " + line.strip()
        elif line.strip():
            name, colon, value = line.partition(":")
            if not colon:
                raise CorruptRecord(f"a header line without a colon: {line[:80]!r}")
            fields.append([name.strip().lower(), value.strip()])
    return first, dict(fields)


def _agrees(said: str, data: bytes) -> bool:
    """Whether a digest (algorithm:value) is that of the data; one of an algorithm that isn't known here says nothing."""
    name, _, value = said.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in hashlib.algorithms_available or not value:
        return True
    found = hashlib.new(name, data)
    raw = found.digest() if found.digest_size else found.digest(32)
    value = value.strip().rstrip("=")
    return value.lower() == raw.hex() or value.upper() == base64.b32encode(raw).decode().rstrip("=") or value == base64.b64encode(raw).decode().rstrip("=")


def _unchunked(body: bytes) -> bytes | None:
    """A body in chunks as a whole; None if it isn't one."""
    at, parts = 0, []
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]{1,8}", size):
            return None
        n = int(size, 16)
        if not n:
            return b"".join(parts)
        if body[end + 2 + n : end + 4 + n] != b"\r\n":
            return None
        parts.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def members(archive: bytes) -> Iterator[Iterator[bytes]]:
    """For each gzip member of the archive, its content piece by piece; a member has to be read to its end."""
    at = 0
    while at < len(archive) and archive[at : at + _CHUNK].strip(b"\0"):  # zeros may fill up the end
        state = {"at": at}

        def pieces() -> Iterator[bytes]:
            inflate, i = zlib.decompressobj(31), state["at"]
            while not inflate.eof:
                chunk = archive[i : i + _CHUNK]
                if not chunk:
                    raise CorruptRecord("the archive ends within a record")
                i += len(chunk)
                try:
                    piece = inflate.decompress(chunk)
                except zlib.error as e:
                    raise CorruptRecord(f"not a gzip member: {e}") from e
                yield piece
            state["at"] = i - len(inflate.unused_data)

        yield pieces()
        if state["at"] == at:
            raise CorruptRecord("a record was not read")
        at = state["at"]


#: Types of records whose block is a message of HTTP, where the content type says so or says nothing.
MESSAGES = ("response", "request", "revisit")


def parse(pieces: Iterator[bytes]) -> dict:
    """Frame one record and verify its digests."""
    held = bytearray()
    for piece in pieces:
        held += piece
        if (end := held.find(b"\r\n\r\n")) >= 0:
            break
    else:
        raise CorruptRecord("no end of the record's header")
    first, head = _fields(bytes(held[:end]))
    if not first.startswith("WARC/"):
        raise CorruptRecord("not a WARC record")
    del held[: end + 4]
    kind, length = head.get("warc-type", "").lower(), head.get("content-length", "")
    if not kind or not re.fullmatch(r"\d{1,18}", length, re.A):
        raise CorruptRecord("no WARC-Type or no Content-Length")
    length = int(length)
    for piece in pieces:
        held += piece
    if len(held) != length + 4 or held[length:] != b"\r\n\r\n":
        raise CorruptRecord(f"Content-Length {length} does not frame the record")
    block = bytes(held[:length])
    if not _agrees(head.get("warc-block-digest", ""), block):
        raise CorruptRecord("block digest")
    payload, whole, http, status = block, None, {}, None
    content = head.get("content-type", "application/http")
    if kind in MESSAGES and content.lower().startswith("application/http"):
        message, blank, payload = block.partition(b"\r\n\r\n")
        if not blank and kind != "revisit" and not message.endswith(b"\r\n"):
            raise CorruptRecord("no end of the message's header")
        line, http = _fields(message)
        status = int(m[1]) if (m := re.match(r"HTTP/\S+\s+(\d{3})\b", line)) else None
        if http.get("transfer-encoding", "").lower().endswith("chunked"):
            whole = _unchunked(payload)
    said, revisit = head.get("warc-payload-digest", ""), kind == "revisit"
    if not revisit and "warc-truncated" not in head and not (_agrees(said, payload) or whole is not None and _agrees(said, whole)):
        raise CorruptRecord("payload digest")
    payload = payload if whole is None else whole
    page = lambda x: int(m[1]) if x and (m := re.fullmatch(r"<urn:page:(-?\d{1,18})>", x)) else None
    size = http.get("content-length", "") if revisit else str(len(payload))
    return {
        "page_id": page(head.get("warc-record-id")),
        "url": head.get("warc-target-uri", "").strip("<>") or None,
        "record_type": kind,
        "payload": None if revisit else payload,
        "payload_bytes": int(size) if re.fullmatch(r"\d{1,18}", size, re.A) else None,
        "payload_digest": (said.removeprefix("sha256:") or None) if revisit else hashlib.sha256(payload).hexdigest(),
        "refers_to": page(head.get("warc-refers-to")),
        "record_id": head.get("warc-record-id"),
        "status": status,
        "error": None,
    }


def _write(batches: Iterator[pa.RecordBatch], date: str) -> Iterator[pa.RecordBatch]:
    part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

    def archive() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f"pages-{part:06d}-{n:06d}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], ["name", "content"])

    for batch in batches:
        for i in range(batch.num_rows):
            page_id, url, payload, refers_to = (batch.column(c)[i].as_py() for c in range(4))
            held.append(record(page_id, url, payload, refers_to, date))
            size += len(held[-1])
            if size >= ARCHIVE_BYTES:
                yield archive()
                n, held, size = n + 1, [], 0
    if held:
        yield archive()


def write_archives(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """name, content: archives with a record for every row of pages (page_id, url, html).

    The smallest page_id of each payload comes from an aggregate that is combined before the shuffle, and joins back on the
    digest alone; only that join meets a payload's copies, and AQE splits it where one payload holds much of the table.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    first = p.where(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("of"), "first")
    p = p.join(first, F.col("digest") == F.col("of"), "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return p.select("page_id", "url", "payload", refers.alias("refers_to")).mapInArrow(partial(_write, date=date), "name string, content binary")


SCHEMA = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long, record_id string, status int, error string"
_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("status", pa.int32()), ("error", pa.string())])


def records(archive: bytes, keep_corrupt: bool = False) -> Iterator[dict]:
    """The records of an archive in their order. With keep_corrupt a bad one is a row of type corrupt; the walk goes on
    behind its member, and ends where that has no end."""
    walk, bad = members(archive), False
    while True:
        try:
            pieces = next(walk)
        except StopIteration:
            return
        except CorruptRecord:
            if bad:  # the last one's member has no end, which its row says
                return
            raise
        try:
            bad = False
            yield parse(pieces)
        except CorruptRecord as e:
            if not keep_corrupt:
                raise
            bad = True
            yield {"record_type": "corrupt", "error": str(e)}
            with suppress(CorruptRecord):
                for _ in pieces:
                    pass


def _read(batches: Iterator[pa.RecordBatch], keep_corrupt: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            held, size = [], 0
            for found in records(batch.column(0)[i].as_py() or b"", keep_corrupt):
                held.append(found)
                size += len(found.get("payload") or b"") + 200
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_pylist(held, _ARROW)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, _ARROW)


def read_archives(archives: DataFrame, keep_corrupt: bool = False) -> DataFrame:
    """The records of archives (content): of ``write_archives``, or of .warc.gz files by ``spark.read.format("binaryFile")``.

    A bad record fails the job (CorruptRecord), or with keep_corrupt is a row of type corrupt that says why.
    """
    return archives.select("content").mapInArrow(partial(_read, keep_corrupt=keep_corrupt), SCHEMA)
