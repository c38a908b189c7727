import base64
import hashlib
from html.parser import HTMLParser

from chunkloom.llm import warc

PAGE = (b"<!DOCTYPE html><html><head><title>T &amp; <b>x</b></title><style>p{}</style><script>var t=\"</p>\";</script></head><body><!-- c <p> -->"
        b"<p class='a>b'>One&nbsp;<b>two</b>three</p><div>Caf\xc3\xa9 &#233; &lt;i&gt;</div>a<br>b  c\n\n d</body></html>")


class Plain(HTMLParser):
    BLOCKS = set("p div br hr li ul ol dl dt dd table tr td th h1 h2 h3 h4 h5 h6 nav article section header footer main aside pre blockquote form figure title body html".split())
    SKIP = {"script", "style", "head", "noscript", "template", "textarea", "svg"}

    def __init__(self):
        super().__init__()
        self.out, self.deep = [], []

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.deep.append(tag)
        elif tag in self.BLOCKS and not self.deep:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if self.deep and self.deep[-1] == tag:
            self.deep.pop()
        elif tag in self.BLOCKS and not self.deep:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.deep:
            self.out.append(data)


def plain(markup):
    p = Plain()
    p.feed(markup)
    p.close()
    return [" ".join(x.split()) for x in "".join(p.out).split("\n") if x.split()]


def response(i, kind="text/html; charset=utf-8", payload=PAGE, **more):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: " + kind.encode() + b"\r\nX-A: b: c\r\n\r\n" + payload
    return {"record_id": f"<urn:uuid:{i}>", "target_uri": f"http://x/{i}", "date": "2024-01-01T00:00:00Z", "payload_digest": None, "block_digest": None, "block": block, **more}


SCHEMA = "record_id string, target_uri string, date string, payload_digest string, block_digest string, block binary, warc_type int"


def test_records_link_to_their_response(spark):
    rows = [response(1), response(2, "image/png", b"\x89\x00"), response(3, "text/plain; charset=latin-1", b"caf\xe9"), response(4, block=None), response(5, block=b""),
            response(6, record_id=None), response(1), response(7, payload_digest="sha1:KEEP"), response(8, payload=PAGE * 3000)]
    got = [r.asDict() for r in warc.derivatives(spark.createDataFrame([(*r.values(), 1) for r in rows], SCHEMA)).collect()]
    assert len(got) == 9 + 6
    by = {(r["refers_to"], r["warc_type"]): r for r in got}
    meta, text = by["<urn:uuid:1>", "metadata"], by["<urn:uuid:1>", "conversion"]
    assert text["concurrent_to"] == meta["record_id"] and text["target_uri"] == "http://x/1" and text["date"] == rows[0]["date"]
    assert bytes(text["block"]).decode() == "One twothree\nCafé é <i>\na\nb c\nd"
    lines = bytes(meta["block"]).decode().split("\r\n")
    assert f"conversion: {text['record_id']}" in lines and "title: T & <b>x</b>" in lines and "http-x-a: b: c" in lines
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    assert text["source_payload_digest"] == sha(PAGE) and text["source_block_digest"] == sha(rows[0]["block"]) and text["block_digest"] == sha(bytes(text["block"]))
    assert bytes(by["<urn:uuid:3>", "conversion"]["block"]).decode() == "café" and by["<urn:uuid:7>", "metadata"]["source_payload_digest"] == "sha1:KEEP"
    assert ("<urn:uuid:2>", "conversion") not in by and (None, "conversion") in by
    assert sum(r["record_id"] == meta["record_id"] for r in got) == 2
    assert warc.derivatives(spark.createDataFrame([], SCHEMA)).collect() == []


def test_text_of_pages_equals_a_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    texts = {r["page_id"]: bytes(r["block"]).decode() for r in warc.derivatives(warc.responses_of(pages), ["page_id"]).filter("warc_type = 'conversion'").collect()}
    for r in pages.collect():
        assert texts[r["page_id"]].split("\n") == plain(r["html"]), r["page_id"]


def test_pages_with_nulls(spark):
    pages = spark.createDataFrame([(1, None, None, "t"), (None, "http://a", "<p>x", "t")], "page_id long, url string, html string, block string")
    got = warc.derivatives(warc.responses_of(pages), ["page_id"]).collect()
    assert sorted((r["page_id"] or 0, bytes(r["block"])) for r in got if r["warc_type"] == "conversion") == [(0, b"x"), (1, b"")]


def test_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(*r.values(), 1) for r in (response(1), response(3, "text/plain", "a\r\n\r\nb é".encode()))], SCHEMA)
    made = warc.derivatives(rows)
    warc.write_warc(made, str(tmp_path / "out"))
    read = warc.read_warc(spark, str(tmp_path / "out"))
    key = lambda df: sorted(map(repr, (tuple(r) for r in df.select(warc.READ).collect())))
    assert key(read) == key(made) and read.filter("NOT whole").isEmpty()
    # What was written can be converted again as responses of their own.
    assert warc.derivatives(read).count() == 4


def test_text_after_elements_left_open():
    cases = {
        "<html><head><title>t</title><body><p>text": "text",
        "<head><meta charset='a'><title>t</title><script>var a = '</head>';</script><p>text": "text",
        "<head><title>t</title>plain <b>text</b>": "plain text",
        '<p>a</p><svg width="1"/><p>rest': "a\nrest",
        "<p>a</p><svg width='1'><path d='M0'/></svg><p>rest": "a\nrest",
        "<p>a<noscript>b<p>c": "a b\nc",
        "a<textarea>b": "a b",
        "a<template>b<svg>c": "a b c",
        "a<svg-icon>b</svg-icon>": "ab",
        "a<script>b": "a",
        "a<style>b<p>c": "a",
        "a<!-- b<p>c": "a",
        "<head><style>p{}</style><title>t</title></head>x": "x",
    }
    assert {k: warc.plain_text(k) for k in cases} == cases


def test_pages_left_open_take_linear_time():
    """About 1 MB each of what makes a scanner start again and again."""
    assert warc.plain_text("<svg>a " * 200_000).count("a") == 200_000
    for part in ("<p ", "<![CDATA[ ", "<a", "<p \"x\" ", "<p '", "<!", "<!--", "</", "<title ", "<title>", "&#9", "<script", "<p \">\" "):
        many = part * (1_000_000 // len(part))
        for tail in ("", ">", "'", "\"", "\"x\" '", "]]>", "'>x"):
            warc.plain_text(many + tail)
            warc.title_of(many + tail)
    assert warc.plain_text("a <p " * 3 + "b") == "a <p a <p a <p b"
    assert warc.plain_text("<p a=\">\" b='x>c") == "<p a=\">\" b='x>c"


def test_character_sets_of_pages():
    cafe = "<p>caf\u00e9"
    assert warc.charset_of("text/html; charset=latin-1", b"") == "latin-1"
    for payload in (cafe.encode(), cafe.encode("utf-8-sig"), cafe.encode("utf-16"), b"<meta charset='latin-1'>" + cafe.encode("latin-1"),
                    b"<META http-equiv=Content-Type content=\"text/html; charset = iso-8859-1\">" + cafe.encode("latin-1"),
                    b"<meta charset=no-such-set>" + cafe.encode()):
        record = warc._derive({**response(1), "block": b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + payload})[1]
        assert record["block"].decode() == "caf\u00e9"


def test_references_to_no_character():
    assert warc.plain_text("a&#" + "9" * 6000 + ";b&#x" + "f" * 9000 + ";c&#65;") == "a\ufffdb\ufffdcA"
