"""WARC derivatives: metadata and plain-text conversion records of response records.

A response is a WARC/1.1 record whose block is an HTTP message. Of each, two records are derived. The metadata record
holds, as JSON, the response's WARC headers, its HTTP status and headers, and the page's title, description,
language and links; the conversion record holds the plain text of the payload. Both name the response in WARC-Refers-To
with its target and date, carry digests of their own blocks, and the source's payload and block digests. Record ids are
derived from the response's id, so a task that runs again gives the same records.

Edge cases. A record that isn't a response, or can't be parsed: no derivatives, reported by ``parsed`` as None. Null
payload: empty text. Declared digests are kept as they are; missing ones are computed. Header names are met in any
case, a repeated header keeps all its values in order; folded lines are unfolded. Repeated rows: each gives its records. Empty
table: empty result.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .markup import scan

VERSION = "WARC/1.1"
#: The date of records built from pages, which have none.
DATE = "2024-01-01T00:00:00Z"

_BLOCKS = frozenset("address article aside blockquote body br center dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table td th tr ul".split())
#: Elements whose content no reader sees, and those that a head may hold; any other ends an unclosed head.
_UNSEEN = frozenset("head noscript template svg".split())
_SPACED = _UNSEEN | {"script", "style"}
_IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
_LINKS = frozenset("a link img script iframe".split())
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def serialised(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record with its length, as it stands in a WARC file."""
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def response(url: str | None, payload: str | None, key: str, date: str = DATE) -> bytes:
    """A response record that holds ``payload`` as an HTML message."""
    body = (payload or "").encode("utf-8", "replace")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", target, key, digest(block))), ("WARC-Date", date), ("WARC-Target-URI", target), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block))]
    return serialised(headers, block)


def _headers(lines: list[bytes]) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (b" ", b"\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.decode('utf-8', 'replace').strip()}")
        elif b":" in line:
            name, _, value = line.partition(b":")
            out.append((name.decode("utf-8", "replace").strip(), value.decode("utf-8", "replace").strip()))
    return out


def value(headers: list[tuple[str, str]], name: str, default: str = "") -> str:
    return next((v for k, v in headers if k.lower() == name.lower()), default)


def parsed(record: bytes | None) -> tuple[list[tuple[str, str]], bytes] | None:
    """Headers and block of one record, gzipped or plain; None if it isn't one."""
    if not record:
        return None
    if record[:2] == b"\x1f\x8b":
        try:
            record = zlib.decompress(record, 31)
        except zlib.error:
            return None
    head, found, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not lines[0].startswith(b"WARC/"):
        return None
    headers = _headers(lines[1:])
    length = value(headers, "Content-Length")
    return headers, rest[: int(length)] if length.isdigit() else rest


def message(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP message; the payload is decoded from chunks and gzip."""
    head, found, body = block.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"HTTP/") or not found:
        return "", [], block
    headers = _headers(lines[1:])
    if "chunked" in value(headers, "Transfer-Encoding").lower():
        parts, at = [], 0
        while m := re.compile(rb"([0-9a-fA-F]+)[^\r\n]*\r\n").match(body, at):
            size = int(m[1], 16)
            parts.append(body[m.end() : m.end() + size])
            at = m.end() + size + 2
            if not size:
                break
        body = b"".join(parts)
    if value(headers, "Content-Encoding").lower() in ("gzip", "x-gzip", "deflate"):
        try:
            body = zlib.decompress(body, 47)
        except zlib.error:
            pass
    return lines[0].decode("latin-1"), headers, body


def decoded(headers: list[tuple[str, str]], body: bytes) -> str:
    m = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", value(headers, "Content-Type"), re.I) or re.search(r"<meta[^<>]*charset\s*=\s*[\"']?([\w.:-]+)", body.decode("latin-1"), re.I)
    try:
        return body.decode(m[1] if m else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def plain_text(page: str, marks: list | None = None) -> str:
    """All text a reader sees, title included: a line for each block, white space as one space. marks: from ``scan``."""
    title, parts, at, unseen = "", [], 0, ""
    for what, name, inner, start, end in scan(page) if marks is None else marks:
        if what == "raw":
            if name == "title":
                title = title or inner
            elif name in ("textarea", "xmp") and not unseen:
                parts.append(inner)
        elif not unseen:
            parts.append(page[at:start])
        at = end
        if what == "open":
            if unseen == "head" and name not in _IN_HEAD:
                unseen = ""
            if not unseen and name in _UNSEEN and not inner.endswith("/"):
                unseen = name
        elif what == "close" and name == unseen:
            unseen = ""
        if not unseen:
            if name in _BLOCKS:
                parts.append("\x00")
            elif what == "comment" or name in _SPACED:
                parts.append(" ")
    if not unseen:
        parts.append(page[at:])
    lines = [" ".join(html.unescape(x).split()) for x in [title, *"".join(parts).split("\x00")]]
    return "\n".join(x for x in lines if x)


def attributes(inner: str) -> dict[str, str]:
    """Names in lower case; of repeated ones the first counts."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(inner):
        found.setdefault(m[1].lower(), html.unescape((m[2] or "").strip("\"'")))
    return found


def description(page: str, marks: list | None = None) -> dict:
    """Title, description, language and links in page order. marks: from ``scan``."""
    title = about = language = None
    links = []
    for what, name, inner, _, _ in scan(page) if marks is None else marks:
        if what == "raw" and name == "title" and title is None:
            title = " ".join(html.unescape(inner).split())
        elif what != "open":
            continue
        elif name in _LINKS and inner:
            own = attributes(inner)
            url = next((own[k] for k in own if k in ("href", "src") and own[k]), None)
            if url is not None:
                links.append({"tag": name, "url": url})
        elif name == "meta" and about is None:
            own = attributes(inner)
            if own.get("name", "").lower() == "description" and "content" in own:
                about = " ".join(own["content"].split())
        elif name == "html" and language is None:
            language = attributes(inner).get("lang") or None
    return {"title": title, "description": about, "language": language, "links": links}


def derived(record: bytes | None) -> list[dict]:
    """The metadata and the conversion record of a response; none for anything else."""
    found = parsed(record)
    if not found or value(found[0], "WARC-Type").lower() != "response":
        return []
    headers, block = found
    status, http, payload = message(block)
    source = value(headers, "WARC-Record-ID")
    target, date = value(headers, "WARC-Target-URI"), value(headers, "WARC-Date")
    payload_digest = value(headers, "WARC-Payload-Digest") or digest(block.partition(b"\r\n\r\n")[2] if status else block)
    block_digest = value(headers, "WARC-Block-Digest") or digest(block)
    is_text = not value(http, "Content-Type") or "html" in value(http, "Content-Type").lower() or value(http, "Content-Type").lower().startswith("text/")
    page = decoded(http, payload) if is_text else ""
    marks = list(scan(page))
    text = plain_text(page, marks)
    about = {"refers_to": source, "warc": [list(h) for h in headers], "http": {"status": status, "headers": [list(h) for h in http]}, "payload_digest": payload_digest, "block_digest": block_digest, "payload_length": len(payload), "page": description(page, marks)}
    out = []
    for kind, content_type, body in (("metadata", "application/json", json.dumps(about, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace")), ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace"))):
        own = [("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, source)), ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", date), ("Content-Type", content_type), ("WARC-Block-Digest", digest(body)), ("X-Source-Payload-Digest", payload_digest), ("X-Source-Block-Digest", block_digest)]
        out.append({"type": kind, "record_id": own[1][1], "refers_to": source, "target_uri": target, "date": date, "payload_digest": payload_digest, "source_block_digest": block_digest, "block_digest": own[8][1], "length": len(body), "record": serialised(own, body)})
    return out


KINDS = "type string, record_id string, refers_to string, target_uri string, date string, payload_digest string, source_block_digest string, block_digest string, length long, record binary"
_FIELDS = [x.split()[0] for x in KINDS.split(", ")]


def derivatives(responses: DataFrame, key: str) -> DataFrame:
    """Two rows for each response in ``responses`` (the key, and ``record`` binary): the key and the derived records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = [(i, x) for i, r in enumerate(part.column(1)) for x in derived(r.as_py())]
                at = pa.array([i for i, _ in rows], pa.int64())
                cols = [pa.array([x[f] for _, x in rows], pa.int64() if f == "length" else pa.binary() if f == "record" else pa.string()) for f in _FIELDS]
                yield pa.record_batch([part.column(0).take(at), *cols], names=[key, *_FIELDS])

    return responses.select(key, "record").mapInArrow(run, f"{key} {dict(responses.dtypes)[key]}, {KINDS}")


def responses(pages: DataFrame) -> DataFrame:
    """(page_id, record): every row of ``pages`` as a response record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                made = [response(u.as_py(), h.as_py(), str(i.as_py())) for i, u, h in zip(part.column(0), part.column(1), part.column(2), strict=True)]
                yield pa.record_batch([part.column(0), pa.array(made, pa.binary())], names=["page_id", "record"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, record binary")


def linked(pages: DataFrame) -> DataFrame:
    """Both derivatives of every page: the records themselves, with their linked identifiers and digests as columns."""
    return derivatives(responses(pages), "page_id").select("page_id", *_FIELDS, F.sha2("record", 256).alias("record_sha256"))
