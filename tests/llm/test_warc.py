import re
import base64
import gzip
import hashlib
import json
import time
import uuid

import pytest

from rankloom.llm import warc


def sha(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_derivatives_link_and_digest():
    page = '<html lang="de"><head><title>A &amp; B</title><meta name="description" content="x y"><script>no()</script></head><body><p>One<br>two</p><a href="/l">go</a></body></html>'
    record = warc.response("http://e.x/ä b", page, "1")
    headers, block = warc.parsed(record)
    meta, text = warc.derived(record)
    assert warc.value(headers, "WARC-Block-Digest") == sha(block) and warc.value(headers, "warc-payload-digest") == sha(page.encode())
    for r in (meta, text):
        own, body = warc.parsed(r["record"])
        assert r["refers_to"] == warc.value(own, "WARC-Refers-To") == warc.value(headers, "WARC-Record-ID")
        assert warc.value(own, "WARC-Block-Digest") == sha(body) == r["block_digest"] and int(warc.value(own, "Content-Length")) == len(body) == r["length"]
        assert r["payload_digest"] == sha(page.encode()) and r["date"] == warc.value(headers, "WARC-Date") and r["target_uri"] == warc.value(headers, "WARC-Target-URI")
    assert warc.parsed(text["record"])[1].decode() == "A & B\nOne\ntwo\ngo"
    about = json.loads(warc.parsed(meta["record"])[1])
    assert [tuple(h) for h in about["warc"]] == headers and about["page"]["title"] == "A & B" and about["page"]["language"] == "de" and about["page"]["description"] == "x y"
    assert about["page"]["links"] == [{"tag": "a", "url": "/l"}]
    assert len({meta["record_id"], text["record_id"], meta["refers_to"]}) == 3 and warc.derived(record) == [meta, text]


def test_declared_digests_folded_headers_chunks_and_gzip():
    body = gzip.compress("<p>é</p>".encode("latin-1"))
    chunks = b"%x\r\n%s\r\n0\r\n\r\n" % (len(body), body)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html;\r\n charset=iso-8859-1\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\nX-A: 1\r\nX-A: 2\r\n\r\n" + chunks
    record = warc.serialised([("warc-type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Payload-Digest", "md5:abc")], block)
    meta, text = warc.derived(gzip.compress(record))
    assert warc.parsed(text["record"])[1].decode() == "é" and text["payload_digest"] == "md5:abc" and text["source_block_digest"] == sha(block)
    assert [h for h in json.loads(warc.parsed(meta["record"])[1])["http"]["headers"] if h[0] == "X-A"] == [["X-A", "1"], ["X-A", "2"]]


def test_records_written_by_hand():
    """Every byte of both records of a small response."""
    page = "<html lang=en><title>T</title><p>One&amp;<b>two</b><!-- no --><p>x<a href='/l'>go</a></html>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + page.encode()
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Date: 2020-02-02T00:00:00Z\r\nWARC-Target-URI: http://a/\r\nContent-Length: %d\r\n\r\n" % len(http) + http + b"\r\n\r\n"
    meta, text = warc.derived(record)
    payload, block = sha(page.encode()), sha(http)
    body = b"T\nOne&two\nxgo"

    def whole(kind, content_type, body):
        own = uuid.uuid5(uuid.NAMESPACE_URL, f"{kind}\n<urn:uuid:1>")
        lines = f"""WARC/1.1
WARC-Type: {kind}
WARC-Record-ID: <urn:uuid:{own}>
WARC-Date: 2020-02-02T00:00:00Z
WARC-Target-URI: http://a/
WARC-Refers-To: <urn:uuid:1>
WARC-Refers-To-Target-URI: http://a/
WARC-Refers-To-Date: 2020-02-02T00:00:00Z
Content-Type: {content_type}
WARC-Block-Digest: {sha(body)}
X-Source-Payload-Digest: {payload}
X-Source-Block-Digest: {block}
Content-Length: {len(body)}"""
        return lines.replace("\n", "\r\n").encode() + b"\r\n\r\n" + body + b"\r\n\r\n"

    assert text["record"] == whole("conversion", "text/plain; charset=utf-8", body)
    about = f"""{{"block_digest": "{block}", "http": {{"headers": [["Content-Type", "text/html"]], "status": "HTTP/1.1 200 OK"}}, "page": {{"description": null, "language": "en", "links": [{{"tag": "a", "url": "/l"}}], "title": "T"}}, "payload_digest": "{payload}", "payload_length": {len(page)}, "refers_to": "<urn:uuid:1>", "warc": [["WARC-Type", "response"], ["WARC-Record-ID", "<urn:uuid:1>"], ["WARC-Date", "2020-02-02T00:00:00Z"], ["WARC-Target-URI", "http://a/"], ["Content-Length", "{len(http)}"]]}}"""
    assert meta["record"] == whole("metadata", "application/json", about.encode())


@pytest.mark.parametrize("part", ["<a ", "<b>x ", '<a b="', "<head>x ", "<meta ", "<svg>", "<!--", "<title>", "<a href= "])
def test_hostile_pages_take_linear_time(part):
    took = []
    for n in (10_000, 80_000):
        start = time.process_time()
        warc.derived(warc.response("u", part * n, "1"))
        took.append(time.process_time() - start)
    assert took[1] < 24 * max(took[0], 0.02)


def test_others_have_no_derivatives():
    for record in (None, b"", b"junk", b"\x1f\x8bjunk", warc.serialised([("WARC-Type", "request")], b"GET /")):
        assert warc.derived(record) == []


def test_pages(spark):
    rows = [(1, "http://a/", "<p>x</p>", 5), (1, "http://a/", "<p>x</p>", 5), (2, None, None, 5), (None, "u", "", 5), (3, "http://b/", "<p>" + "long " * 60_000, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, length int")
    got = warc.linked(pages).collect()
    assert len(got) == 10 and {r.type for r in got} == {"metadata", "conversion"}
    want = sorted((str(i), x["record_id"], hashlib.sha256(x["record"]).hexdigest()) for i, u, h, _ in rows for x in warc.derived(warc.response(u, h, str(i))))
    assert sorted((str(r.page_id), r.record_id, r.record_sha256) for r in got) == want
    assert all(hashlib.sha256(r.record).hexdigest() == r.record_sha256 for r in got)
    assert warc.linked(pages.limit(0)).count() == 0


def test_unlike_pages_of_one_id_have_records_of_their_own():
    a, b, again = (warc.response("http://a.b/", t, "7") for t in ("<p>one", "<p>two", "<p>one"))
    ids = [re.search(rb"WARC-Record-ID: (\S+)", x)[1] for x in (a, b, again)]
    assert ids[0] != ids[1] and ids[0] == ids[2]


def test_a_charset_far_into_the_page_is_found():
    body = (b"<!-- " + b"x" * 5000 + b" -->" + '<meta charset="iso-8859-1"><p>é'.encode("latin-1"))
    assert "é" in warc.decoded([("Content-Type", "text/html")], body)
    warc.decoded([], b"<meta" * 200_000)
    warc.decoded([], b"<meta charset " * 100_000)
