"""Derivative builder for web archives: each response gives a linked metadata and a plain-text conversion record.

``responses`` makes response records of pages; ``derive`` makes, of any table of response records, the two derivatives.
Both keep the response's target, date and digests; ``WARC-Refers-To`` is the response's record id, and the conversion
names its metadata sibling as concurrent. Record ids are name-based UUIDs of what the record holds and refers to, so
reruns and retries give the same ids. ``record_bytes`` has the whole record; ``parse_records`` reads such bytes back.

The metadata keeps what the source said: its HTTP status and every HTTP header in order, and the headers of the source
record where the archive has a column ``source_headers`` (array of name and value). The text is made of the entity that a reader
sees: chunks are joined, gzip, deflate and zstd undone, and the characters decoded by the byte order mark, the charset of the
Content-Type header, that of a meta element, or UTF-8, with U+FFFD for bytes that no character has. HTML and unnamed types lose
their markup, other text types stay as they are, and types that are no text give an empty conversion. A coding that is broken or
unknown gives an empty conversion and ``entityDecoded: false``; a payload that ends early keeps what can be decoded, and
says so too.

A null block or page is an empty payload; a null url leaves the target header out; a null page_id stays null. Repeated pages give
the same records again. Other columns are not read. Payloads of any length are converted whole. An empty table gives none.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESPONSE = "page_id long, record_id string, target_uri string, date string, content_type string, block binary, block_digest string, payload_digest string"
DERIVED = "page_id long, record_type string, record_id string, refers_to string, target_uri string, content_length long, block_digest string, source_payload_digest string, record_bytes binary"

HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|title|body|head)\b[^>]*>", re.I)
TAG = re.compile(r"<[/!?a-zA-Z][^>]*>")
BLANKS = re.compile(r"[ \t\r\f\v ]+")
TITLE = re.compile(r"<title[^>]*>(.*?)</title\s*>", re.S | re.I)
LANGUAGE = re.compile(r"<html[^>]*\blang=[\"']?([A-Za-z-]+)", re.I)
META_CHARSET = re.compile(rb"<meta\b[^>]*?\bcharset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.I)
CHARSET = re.compile(r"\bcharset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.I)
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
MARKUP = {"", "text/html", "application/xhtml+xml", "text/xml", "application/xml"}
LINK = re.compile(r"<a\b[^>]*\bhref=", re.I)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_name(kind: str, *parts: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '\n'.join([kind, *(p or '' for p in parts)]))}>"


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A WARC 1.1 record; headers without a value are left out."""
    lines = ["WARC/1.1", *(f"{k}: {one_line(v)}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def one_line(value: str) -> str:
    return " ".join(value.split())


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines)
        start, size = end + 4, int(headers["Content-Length"])
        yield headers, data[start : start + size]
        at = start + size + 4


def plain_text(page: str) -> str:
    """What a reader sees: a line for each block, without scripts, styles, comments and tags."""
    seen = TAG.sub(" ", BREAK.sub("\n", HIDDEN.sub(" ", page)))
    lines = (BLANKS.sub(" ", x).strip() for x in html.unescape(seen).split("\n"))
    return "\n".join(x for x in lines if x)


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of pages (page_id, url, html)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, url, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (page or "").encode()
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
                mark = digest(payload)
                rows.append((page_id, record_name("response", url, date, mark), url, date, "application/http; msgtype=response", block, digest(block), mark))
            yield batch_of(rows, RESPONSE)

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(made, RESPONSE)


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.strip().split(" ") for x in schema.split(",")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


class Response(NamedTuple):
    """An HTTP response: status (None for a block that is all payload), headers in order, payload as it was sent."""

    status: str | None
    headers: list[tuple[str, str]]
    payload: bytes

    def header(self, name: str) -> str:
        """The values of a header, joined by commas; empty if there is none."""
        return ", ".join(v for k, v in self.headers if k.lower() == name)


def response_of(block: bytes) -> Response:
    """Status line, headers and payload of a block; one without an HTTP status line is all payload."""
    if not block.startswith(b"HTTP/"):
        return Response(None, [], block)
    end = re.search(rb"\r?\n\r?\n", block)
    head, payload = (block[: end.start()], block[end.end() :]) if end else (block, b"")
    first, *lines = re.split(r"\r?\n", re.sub(r"\r?\n[ \t]+", " ", head.decode("latin-1")))
    named = [line.partition(":") for line in lines if ":" in line]
    return Response(first.partition(" ")[2].strip(), [(k.strip(), v.strip()) for k, _, v in named], payload)


def joined_chunks(data: bytes) -> tuple[bytes, bool]:
    """The chunks of a chunked payload in one, and whether it is whole."""
    parts, at = [], 0
    while (end := data.find(b"\n", at)) >= 0:
        size = data[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            break
        n = int(size, 16)
        if n == 0:
            return b"".join(parts), True
        parts.append(data[end + 1 : end + 1 + n])
        at = end + 1 + n
        if at > len(data):
            break
        at += 2 if data[at : at + 2] == b"\r\n" else 1
    return b"".join(parts), False


def unpacked(data: bytes, coding: str) -> tuple[bytes, bool]:
    """``data`` without one content coding, as far as it can be decoded, and whether it was whole."""
    if coding in ("", "identity"):
        return data, True
    try:
        if coding in ("gzip", "x-gzip"):
            out, rest = [], data
            while rest:  # a gzip file may have several members
                one = zlib.decompressobj(31)
                out.append(one.decompress(rest) + one.flush())
                if not one.eof:
                    return b"".join(out), False
                rest = one.unused_data.lstrip(b"\0")
            return b"".join(out), True
        if coding == "deflate":  # with or without the header of zlib
            wrapped = len(data) > 1 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0
            one = zlib.decompressobj(15 if wrapped else -15)
            return one.decompress(data) + one.flush(), one.eof or not data
        if coding == "zstd":
            return zstandard.ZstdDecompressor().decompressobj().decompress(data), True
    except (zlib.error, zstandard.ZstdError):
        pass
    return b"", False


def entity_of(response: Response) -> tuple[bytes, bool]:
    """The entity behind the transfer and content codings, and whether all of them could be undone."""
    data, whole = response.payload, True
    if "chunked" in response.header("transfer-encoding").lower():
        data, whole = joined_chunks(data)
    for coding in reversed(response.header("content-encoding").lower().split(",")):
        data, good = unpacked(data, coding.strip())
        whole &= good
    return data, whole


def characters_of(entity: bytes, content_type: str) -> tuple[str, str]:
    """The entity as text, and the name of the charset that it was read by."""
    for mark, name in MARKS:
        if entity.startswith(mark):
            return entity[len(mark) :].decode(name, "replace"), name
    said, meta = CHARSET.search(content_type), META_CHARSET.search(entity)
    for name in (said[1] if said else None, meta[1].decode() if meta else None, "utf-8"):
        if name:
            if name.lower() in ("iso-8859-1", "latin1", "latin-1", "us-ascii", "ascii"):  # as browsers read these
                name = "windows-1252"
            try:
                return entity.decode(name, "replace"), name.lower()
            except (LookupError, UnicodeError, ValueError):
                continue
    raise AssertionError("UTF-8 decodes all bytes")


def text_of(response: Response) -> tuple[str, str, str | None, bool]:
    """Page, plain text, charset and whether the entity could be decoded; types that are no text have no page."""
    entity, whole = entity_of(response)
    said = response.header("content-type")
    kind = said.partition(";")[0].strip().lower()
    if kind not in MARKUP and not kind.startswith("text/"):
        return "", "", None, whole
    page, charset = characters_of(entity, said)
    return page, plain_text(page) if kind in MARKUP else page.replace("\r\n", "\n"), charset, whole


def derive(archive: DataFrame) -> DataFrame:
    """Two rows for each response: its metadata and its conversion."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                response = response_of(r["block"] or b"")
                page, seen, charset, whole = text_of(response)
                body = seen.encode("utf-8", "replace")
                title, language = TITLE.search(page), LANGUAGE.search(page)
                fields = [
                    ("sourceRecord", r["record_id"]), ("sourceContentType", r["content_type"]), ("sourceBlockDigest", r["block_digest"]), ("sourcePayloadDigest", r["payload_digest"]),
                    ("sourceContentLength", str(len(r["block"] or b""))), ("payloadMatchesDigest", str(digest(response.payload) == r["payload_digest"]).lower()),
                    *(("sourceRecordHeader", f"{h['name']}: {h['value']}") for h in r["source_headers"] or () if h and h["name"] and h["value"] is not None),
                    ("httpStatus", response.status), *(("httpHeader", f"{k}: {v}") for k, v in response.headers),
                    ("charset", charset), ("entityDecoded", str(whole).lower()),
                    ("title", html.unescape(title[1]) if title else None), ("language", language[1] if language else None), ("outlinks", str(len(LINK.findall(page)))),
                ]
                about = "".join(f"{k}: {one_line(v)}\r\n" for k, v in fields if v is not None).encode()
                sibling = record_name("metadata", r["record_id"], digest(about))
                for kind, name, block, form in (("metadata", sibling, about, "application/warc-fields"), ("conversion", record_name("conversion", r["record_id"], digest(body)), body, "text/plain; charset=utf-8")):
                    mark = digest(block)
                    data = record([
                        ("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", r["date"]), ("WARC-Target-URI", r["target_uri"]), ("WARC-Refers-To", r["record_id"]),
                        ("WARC-Concurrent-To", sibling if kind == "conversion" else None), ("WARC-Block-Digest", mark), ("WARC-Source-Payload-Digest", r["payload_digest"]),
                        ("WARC-Source-Block-Digest", r["block_digest"]), ("WARC-Source-Content-Type", r["content_type"]), ("Content-Type", form),
                    ], block)
                    rows.append((r["page_id"], kind, name, r["record_id"], r["target_uri"], len(block), mark, r["payload_digest"], data))
            yield batch_of(rows, DERIVED)

    headers = "source_headers" if "source_headers" in archive.columns else F.lit(None).cast("array<struct<name:string,value:string>>").alias("source_headers")
    return archive.select(headers, "page_id", "record_id", "target_uri", "date", "content_type", "block", "block_digest", "payload_digest").mapInArrow(made, DERIVED)
