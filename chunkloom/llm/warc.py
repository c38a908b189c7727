"""WARC derivatives: metadata and plain-text conversion records of response records.

Each response gives one ``metadata`` record and, when its payload is text, one ``conversion`` record. Both refer to
the response by its id, keep its target and date, and carry its digests; the metadata record lists the source's HTTP
headers and links the conversion, which names the metadata record as concurrent. Ids of derived records are computed
from the response id, so a rerun makes the same records. One response is one row; nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

RECORD = ("warc_type string, record_id string, refers_to string, concurrent_to string, target_uri string, date string, content_type string, "
          "payload_digest string, block_digest string, source_payload_digest string, source_block_digest string, http_headers string, block binary")
FIELDS = [part.split()[0] for part in RECORD.split(", ")]
ARROW = pa.schema([(n, pa.binary() if n == "block" else pa.string()) for n in FIELDS])
TEXT_TYPES = ("text/html", "application/xhtml+xml", "text/plain")
VERSION = b"WARC/1.1\r\n"

NAME = re.compile(r"[A-Za-z][A-Za-z0-9:-]*")
MARK = re.compile(r"[>\"']")
# Only comments, scripts and styles run to the end of a page when they aren't closed.
RUN = {"script", "style"}
RAW = {"noscript", "template", "textarea", "svg", "head"}
BLOCKS = set(
    "p div br hr li ul ol dl dt dd table tr td th h1 h2 h3 h4 h5 h6 nav article section header footer main aside pre blockquote form figure title body html".split()
)
ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in (*RUN, "noscript", "template", "textarea", "svg", "title")}
# Tags that leave a head open; any other one, and text, ends it as </head> does.
IN_HEAD = {"noscript", "template", "title", "meta", "link", "base", "basefont", "bgsound", "html", "head"}
TITLE = re.compile(r"<title\b", re.I)
META_CHARSET = re.compile(rb"<meta[^>]{0,512}?charset\s{0,8}=\s{0,8}[\"']?([\w.:-]{1,40})", re.I)
# References to numbers that are no code points, which are too long to be read as numbers.
TOO_LONG = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{7,});?")
BLANKS = re.compile(r"[^\S\n]+")
SNIFFED = 1024          # bytes at the start of a page that may name its character set


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(record_id: str, role: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record_id}#{role}')}>"


class _TagEnds:
    """Where the tags of a page end, in time linear in the page over all calls.

    A quoted ``>`` ends no tag, and a tag with a quote that is never closed is none. Every opening quote that a failed
    search passed is remembered: a later search that comes to one fails there too.
    """

    def __init__(self, markup: str):
        self.markup, self.last = markup, markup.rfind(">")
        self.since = self.first = -1
        self.failed: set[int] = set()

    def of(self, at: int) -> int:
        """Position after the ``>`` of the tag whose name ends at ``at``, or -1."""
        if at > self.last:
            return -1
        # Tags are asked for from left to right, so the first mark after a position is looked for once.
        if not self.since <= at <= self.first:
            self.since, self.first = at, MARK.search(self.markup, at).start()
        mark, passed = self.first, []
        while mark not in self.failed:
            if self.markup[mark] == ">":
                return mark + 1
            passed.append(mark)
            close = self.markup.find(self.markup[mark], mark + 1)
            found = MARK.search(self.markup, close + 1) if close >= 0 else None
            if not found:
                break
            mark = found.start()
        self.failed.update(passed)
        return -1


def plain_text(markup: str) -> str:
    """Text of an HTML page: no markup, scripts, styles or head; blocks on lines of their own, white space joined.

    A head without end tag ends at the first text or tag that can't be in it; an element left out that has no end tag
    loses its tag only, and ``<svg .../>`` is closed. Each part of the page is read a bounded number of times, whatever
    is left open in it.
    """
    out, copied, at, in_head, unclosed = [], 0, 0, False, set()
    ends, last, last_cdata = _TagEnds(markup), markup.rfind(">"), markup.rfind("]]>")
    while (at := markup.find("<", at)) >= 0:
        start, name, slash = at, "", markup.startswith("</", at)
        if markup.startswith("<!--", at):
            end = markup.find("-->", at + 4) + 3
            end = end if end > 2 else len(markup)
        elif markup.startswith("<![CDATA[", at) and last_cdata > at:
            end = markup.find("]]>", at) + 3
        elif markup.startswith(("<!", "<?"), at):
            end = markup.find(">", at) + 1 if last > at else 0
        else:
            tag = NAME.match(markup, at + 1 + slash)
            end = ends.of(tag.end()) if tag else 0
            name = tag[0].lower() if tag else ""
            after = markup[tag.end(): tag.end() + 1] if tag else ""
            if name in RUN and not slash and (after in "/>" or after.isspace()):
                close = ENDS[name].search(markup, tag.end())
                end = close.end() if close else len(markup)
            elif name in RAW and not (after in ("/", ">") or after.isspace()):
                name = f"{name}{after}"         # some other element
        if end <= 0:
            at += 1
            continue
        text, at = markup[copied:start], end
        in_head = in_head and not text.strip()
        out.append(text)
        run, raw = name in RUN and not slash, name in RAW and not slash
        if in_head and name and not run and (name not in IN_HEAD if not slash else name in ("head", "body", "html", "br")):
            in_head = False
        if raw and name == "head":
            in_head = True
        elif (raw or (in_head and name == "title" and not slash)) and name not in unclosed and not (name == "svg" and markup.endswith("/>", start, end)):
            close = ENDS[name].search(markup, at)
            if close:
                at = close.end()
            else:
                unclosed.add(name)
        out.append(" " if raw or run or in_head else "\n" if name in BLOCKS else "")
        copied = at
    out.append(markup[copied:])
    text = html.unescape(TOO_LONG.sub("\ufffd", "".join(out)))
    lines = (BLANKS.sub(" ", line).strip() for line in text.replace("\r", "\n").split("\n"))
    return "\n".join(line for line in lines if line)


def title_of(markup: str) -> str | None:
    """Text of the first title element."""
    found = TITLE.search(markup)
    start = markup.find(">", found.end()) + 1 if found else 0
    end = ENDS["title"].search(markup, start) if start else None
    return " ".join(html.unescape(TOO_LONG.sub("\ufffd", markup[start:end.start()])).split()) if end else None


def charset_of(kind: str, payload: bytes) -> str:
    """Character set that the header names, else a byte order mark or the page itself, else UTF-8."""
    named = re.search(r"charset=[\"']?([\w.:-]+)", kind, re.I)
    if named:
        return named[1]
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if payload.startswith(mark):
            return name
    meta = META_CHARSET.search(payload, 0, SNIFFED)
    return meta[1].decode() if meta else "utf-8"


def split_http(block: bytes) -> tuple[str, bytes]:
    """Head (status line and headers) and payload of an HTTP message; without a head all of it is payload."""
    if not block.startswith(b"HTTP/"):
        return "", block
    head, _, payload = block.partition(b"\r\n\r\n")
    return head.decode("utf-8", "replace"), payload


def header(head: str, name: str) -> str | None:
    for line in head.split("\r\n")[1:]:
        key, _, value = line.partition(":")
        if key.strip().lower() == name:
            return value.strip()
    return None


def _derive(record: dict) -> list[dict]:
    block = record["block"] or b""
    head, payload = split_http(block)
    kind = header(head, "content-type") or "application/octet-stream"
    source_payload = record["payload_digest"] or digest(payload)
    source_block = record["block_digest"] or digest(block)
    source_id = record["record_id"]
    base = {
        "refers_to": source_id, "target_uri": record["target_uri"], "date": record["date"], "http_headers": head,
        "source_payload_digest": source_payload, "source_block_digest": source_block,
    }
    # Without an id there is nothing to refer to; the content names the source instead.
    seed = source_id or f"{record['target_uri']}#{source_block}"
    meta_id, text_id = derived_id(seed, "metadata"), derived_id(seed, "conversion")
    converted = kind.split(";")[0].strip().lower() in TEXT_TYPES
    out, fields = [], [("source-content-type", kind), ("source-payload-digest", source_payload), ("source-block-digest", source_block)]
    if converted:
        plain = kind.lower().startswith("text/plain")
        try:
            markup = payload.decode(charset_of(kind, payload), "replace")
        except (LookupError, UnicodeError):
            markup = payload.decode("utf-8", "replace")
        text = (markup if plain else plain_text(markup)).encode("utf-8", "replace")
        title = None if plain else title_of(markup)
        fields += [("title", title)] if title is not None else []
        fields.append(("conversion", text_id))
        out.append(base | {
            "warc_type": "conversion", "record_id": text_id, "concurrent_to": meta_id, "content_type": "text/plain; charset=utf-8",
            "payload_digest": digest(text), "block_digest": digest(text), "block": text,
        })
    fields += [(f"http-{k.strip().lower()}", v.strip()) for k, c, v in (line.partition(":") for line in head.split("\r\n")[1:]) if c]
    data = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "replace")
    out.insert(0, base | {
        "warc_type": "metadata", "record_id": meta_id, "concurrent_to": None, "content_type": "application/warc-fields",
        "payload_digest": digest(data), "block_digest": digest(data), "block": data,
    })
    return out


def derivatives(responses: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Derived records of ``responses``, with the ``keep`` columns of their response.

    ``responses``: record_id, target_uri, date, payload_digest, block_digest, block (the HTTP message). Missing digests
    are computed. A null or empty block gives a metadata record only. A response without id gives records whose
    ``refers_to`` is null. Repeated responses give repeated records. Other columns are not read.
    """
    keep = keep or []
    names = ["record_id", "target_uri", "date", "payload_digest", "block_digest", "block"]
    source = responses.select(*[responses[n] for n in names], *[responses[f"`{c}`"].alias(f"_keep{i}") for i, c in enumerate(keep)])
    kept = source.schema.fields[len(names):]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows, at = [], []
                for i, record in enumerate(part.select(names).to_pylist()):
                    found = _derive(record)
                    rows += found
                    at += [i] * len(found)
                made = pa.RecordBatch.from_pylist(rows, ARROW)
                extra = [part.column(len(names) + i).take(pa.array(at, pa.int32())) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays(extra + made.columns, [f.name for f in kept] + FIELDS)

    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in kept) + RECORD
    return source.mapInArrow(run, schema).select(*[F.col(f.name).alias(c) for f, c in zip(kept, keep)], *FIELDS)


def responses_of(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of crawled ``pages`` (page_id, url, html), which carry no time of their own."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    name = F.sha2(F.concat_ws("\x1f", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.sha2(body, 256)), 256)
    shape = F.concat_ws("-", *[F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return pages.select(
        "page_id", F.concat(F.lit("<urn:uuid:"), shape, F.lit(">")).alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"),
        F.lit(None).cast("string").alias("payload_digest"), F.lit(None).cast("string").alias("block_digest"),
        F.concat(head.cast("binary"), body).alias("block"),
    )


def write_warc(records: DataFrame, path: str) -> None:
    """Store derived records as WARC 1.1 files, one for each task."""
    fields = [
        ("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Concurrent-To", "concurrent_to"),
        ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Payload-Digest", "payload_digest"), ("WARC-Block-Digest", "block_digest"),
        ("Content-Type", "content_type"),
    ]
    lines = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{n}: "), F.col(c), F.lit("\r\n"))) for n, c in fields]
    head = F.concat(F.lit(VERSION.decode()), F.concat_ws("", *lines), F.lit("Content-Length: "), F.octet_length("block").cast("string"), F.lit("\r\n\r\n"))
    records.select(F.concat(head, F.decode("block", "UTF-8")).alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def _parsed(batches):
    for batch in batches:
        rows = []
        for data in batch.column(0).to_pylist():
            if not data:
                continue
            head, _, rest = bytes(data).partition(b"\r\n\r\n")
            named = dict(
                (k.strip().lower(), v.strip()) for k, c, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")) if c
            )
            size = int(named.get("content-length", len(rest)))
            rows.append({
                "warc_type": named.get("warc-type"), "record_id": named.get("warc-record-id"), "refers_to": named.get("warc-refers-to"),
                "concurrent_to": named.get("warc-concurrent-to"), "target_uri": named.get("warc-target-uri"), "date": named.get("warc-date"),
                "content_type": named.get("content-type"), "payload_digest": named.get("warc-payload-digest"),
                "block_digest": named.get("warc-block-digest"), "block": rest[:size], "whole": len(rest) >= size,
            })
        schema = pa.schema([ARROW.field(n) for n in READ] + [("whole", pa.bool_())])
        yield pa.RecordBatch.from_pylist(rows, schema)


READ = ["warc_type", "record_id", "refers_to", "concurrent_to", "target_uri", "date", "content_type", "payload_digest", "block_digest", "block"]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC 1.1 files. Files are split at the version line, so plain ones are read by many tasks.

    A block that itself holds the version line is cut there: ``whole`` is false for it and for nothing else.
    """
    raw = spark.read.option("lineSep", VERSION.decode()).text(path).select(F.col("value").cast("binary").alias("value"))
    schema = ", ".join(f"{n} {'binary' if n == 'block' else 'string'}" for n in READ) + ", whole boolean"
    return raw.mapInArrow(_parsed, schema)
