"""Archives that others wrote: all types of records, digests in other spellings, messages without lengths, bad records."""

import base64
import gzip
import hashlib

import pytest

from factloom.llm import warc


def made(kind, block, *fields, length=None, end=b"\r\n\r\n"):
    head = [f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1>", f"Content-Length: {len(block) if length is None else length}", *fields]
    return "\r\n".join(["WARC/1.0", *head]).encode() + b"\r\n\r\n" + block + end


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


BODY = b"<html>hello</html>"
OK = b"HTTP/1.1 200 OK\r\nServer:x\r\nX-Long: a\r\n b\r\n\r\n" + BODY
CHUNKED = b"HTTP/1.1 404 Not Found\r\nTransfer-Encoding: chunked\r\n\r\n6;x=1\r\n<html>\r\nc\r\nhello</html>\r\n0\r\n\r\n"
HTTP = "Content-Type: application/http; msgtype=response"
GOOD = {
    "warcinfo": (made("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"), ("warcinfo", b"software: x\r\n", None)),
    "response without a length": (made("response", OK, HTTP, "WARC-Target-URI: <http://a/>", f"WARC-Payload-Digest: {sha1(BODY)}", f"WARC-Block-Digest: {sha1(OK)}"), ("response", BODY, 200)),
    "no blank after the colon": (made("response", OK, "Content-Type:application/http", f"warc-payload-digest:{sha1(BODY).lower().replace('sha1', 'SHA1')}"), ("response", BODY, 200)),
    "sha256 in base 16": (made("response", OK, HTTP, f"WARC-Payload-Digest: sha256:{hashlib.sha256(BODY).hexdigest().upper()}"), ("response", BODY, 200)),
    "sha256 in base 64": (made("response", OK, HTTP, f"WARC-Payload-Digest: sha-256:{base64.b64encode(hashlib.sha256(BODY).digest()).decode()}"), ("response", BODY, 200)),
    "unknown algorithm": (made("response", OK, HTTP, "WARC-Payload-Digest: crc9:zzz"), ("response", BODY, 200)),
    "wrong length of the message": (made("response", OK.replace(b"Server:x", b"Content-Length: 7"), HTTP), ("response", BODY, 200)),
    "chunks, digest of the whole": (made("response", CHUNKED, HTTP, f"WARC-Payload-Digest: {sha1(BODY)}"), ("response", BODY, 404)),
    "chunks, digest as sent": (made("response", CHUNKED, HTTP, f"WARC-Payload-Digest: {sha1(CHUNKED.partition(b'\r\n\r\n')[2])}"), ("response", BODY, 404)),
    "said to be chunked": (made("response", CHUNKED.replace(b"6;x=1", b"zz"), HTTP), ("response", CHUNKED.replace(b"6;x=1", b"zz").partition(b"\r\n\r\n")[2], 404)),
    "request": (made("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "Content-Type: application/http; msgtype=request"), ("request", b"", None)),
    "metadata": (made("metadata", b"via: x\r\n\r\ny", "Content-Type: application/warc-fields"), ("metadata", b"via: x\r\n\r\ny", None)),
    "resource": (made("resource", BODY, "Content-Type: text/html", f"WARC-Payload-Digest: {sha1(BODY)}"), ("resource", BODY, None)),
    "dns": (made("response", b"20240101\r\na. 1 IN A 1.2.3.4\r\n", "Content-Type: text/dns"), ("response", b"20240101\r\na. 1 IN A 1.2.3.4\r\n", None)),
    "revisit": (made("revisit", b"HTTP/1.1 200 OK\r\n\r\n", HTTP, f"WARC-Payload-Digest: {sha1(BODY)}"), ("revisit", None, 200)),
    "empty revisit": (made("revisit", b"", HTTP, "WARC-Payload-Digest: " + sha1(BODY)), ("revisit", None, None)),
    "truncated": (made("response", OK[:-4], HTTP, "WARC-Truncated: length", f"WARC-Payload-Digest: {sha1(BODY)}"), ("response", BODY[:-4], 200)),
    "empty block": (made("resource", b""), ("resource", b"", None)),
}
BAD = [
    made("response", OK, HTTP, length=len(OK) + 1), made("response", OK, HTTP, length="many"), made("response", OK, HTTP, length="-1"), made("response", OK, HTTP, end=b"\r\n"), made("response", OK, HTTP, "no colon here"),
    made("response", OK, HTTP, f"WARC-Payload-Digest: {sha1(b'other')}"), made("response", OK, HTTP, f"WARC-Block-Digest: {sha1(BODY)}"), made("response", b"no message", HTTP), made("response", OK, HTTP).replace(b"WARC-Type: response\r\n", b""),
    b"WARC/1.0\r\nWARC-Type: x", b"", b"HTTP/1.1 200 OK\r\n\r\n", b"WARC/1.0\r\nWARC-Type: \xff\xfe\r\n\r\n\r\n\r\n",
]


@pytest.mark.parametrize("name", GOOD)
def test_records_of_all_types(name):
    raw, (kind, payload, status) = GOOD[name]
    got = warc.parse(iter([raw[:20], raw[20:]]))
    assert (got["record_type"], got["payload"], got["status"], got["page_id"], got["record_id"]) == (kind, payload, status, None, "<urn:uuid:1>")
    if payload is not None:
        assert got["payload_bytes"] == len(payload) and got["payload_digest"] == hashlib.sha256(payload).hexdigest()


@pytest.mark.parametrize("raw", BAD)
def test_bad_records(raw):
    with pytest.raises(warc.CorruptRecord):
        warc.parse(iter([raw]))


def test_an_archive_with_bad_records(spark, tmp_path):
    members = [gzip.compress(raw) for raw, _ in GOOD.values()]
    (tmp_path / "a.warc.gz").write_bytes(members[0] + gzip.compress(BAD[0]) + b"".join(members[1:]) + b"\0" * 100)
    (tmp_path / "b.warc.gz").write_bytes(members[1] + b"not gzip at all" + members[2])
    (tmp_path / "c.warc.gz").write_bytes(members[1][:-12])
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = warc.read_archives(files, keep_corrupt=True).collect()
    assert len(got) == len(members) + 1 + 2 + 1 and sum(r.record_type == "corrupt" for r in got) == 3
    assert all((r.error is not None) == (r.record_type == "corrupt") for r in got)
    with pytest.raises(Exception, match="CorruptRecord"):
        warc.read_archives(files).collect()
