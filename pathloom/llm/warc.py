"""WARC derivatives: responses become linked metadata and plain-text conversion records.

A response keeps its identifier, date, target, HTTP headers and digests. Its two derivatives refer to it by
that identifier: a *metadata* record (JSON: the source's WARC and HTTP headers, title, language, description, links)
and a *conversion* record (the page's text). Both carry the source's target, date and payload digest and
digests of their own blocks, and are concurrent with each other by the metadata record's reference.

Defined results: a null page body is an empty payload; a null target has no header; equal rows make equal
records, identifiers included, as those are made from content; an empty table makes none. Text keeps block
boundaries as line ends; comments, scripts, styles and templates are no text; unclosed ones, and unclosed tags, run to
the end. A page of any kind takes time in proportion to its length.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
NO_DATE = "1970-01-01T00:00:00Z"

# Elements whose content is no text, and those that break lines.
SILENT = ("script", "style", "noscript", "template", "svg")
BREAKS = "address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr li main nav ol p pre section table tbody td tfoot th thead title tr ul".split()
_BREAKS = frozenset(BREAKS)

# A page is read once, from left to right; what isn't closed runs to the end, so no part is looked at again and again.
_INSIDE = r"""(?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|))*+(?:>|\Z)"""
_MARK = re.compile(
    r"<!--(?:.*?-->|.*)"
    r"|<(?P<silent>" + "|".join(SILENT) + r")(?=[\s/>])" + _INSIDE + r"(?:.*?</(?P=silent)(?=[\s/>])[^>]*+(?:>|\Z)|.*)"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*+)(?P<inside>" + _INSIDE + ")"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s=>/"']++)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>"']++)))?""")
_TITLE_END = re.compile(r"</title(?=[\s/>])", re.I)
_SPACE = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def identifier(*parts: str | None) -> str:
    """A record's identifier, made from what it holds."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(parts))}>"


def text_of(page: str) -> str:
    """The text: tags that break lines as line ends, comments and silent elements as a space, other tags as nothing."""
    parts, at = [], 0
    for m in _MARK.finditer(page):
        name = m["name"]
        parts += (page[at : m.start()], " " if name is None else "\n" if name.lower() in _BREAKS else "")
        at = m.end()
    parts.append(page[at:])
    return _LINES.sub("\n", _SPACE.sub(" ", html.unescape("".join(parts)).replace("\r", "\n").replace("\x00", " "))).strip()


def _attributes(inside: str) -> dict[str, str]:
    """A tag's attributes, the first of a name."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(inside):
        out.setdefault(name.lower(), html.unescape(next(filter(None, values), "")))
    return out


def page_metadata(page: str) -> dict:
    out: dict = {"title": None, "lang": None, "description": None, "links": []}
    titled = False
    for m in _MARK.finditer(page):
        name = (m["name"] or "").lower()
        if m["close"] or name not in ("title", "html", "meta", "a"):
            continue
        if name == "title":
            end = None if titled else _TITLE_END.search(page, m.end())
            titled = True
            if end:
                out["title"] = " ".join(html.unescape(page[m.end() : end.start()]).split())
            continue
        has = _attributes(m["inside"])
        if name == "html" and out["lang"] is None and "lang" in has:
            out["lang"] = has["lang"].strip() or None
        elif name == "meta" and out["description"] is None and has.get("name", "").lower() == "description" and "content" in has:
            out["description"] = " ".join(has["content"].split())
        elif name == "a" and "href" in has:
            out["links"].append(has["href"])
    return out


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: Column | None = None) -> DataFrame:
    """Response records of a table of pages: ``id, record_id, target_uri, date, http_headers, payload, payload_digest``."""
    kind = pages.schema[id_col].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for url, page, day in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                payload = (page or "").encode()
                d = digest(payload)
                headers = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
                rows.append((identifier("response", url, day, d), url, day, headers, payload, d))
            types = [("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("http_headers", pa.string()), ("payload", pa.binary()), ("payload_digest", pa.string())]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, type=t) for c, (_, t) in zip(cols, types, strict=True))], names=[id_col, *(n for n, _ in types)])

    day = F.coalesce(date.cast("string"), F.lit(NO_DATE)) if date is not None else F.lit(NO_DATE)
    source = pages.select(id_col, F.col(url_col).alias("_u"), F.col(html_col).alias("_h"), day.alias("_d"))
    return source.mapInArrow(task, f"`{id_col}` {kind}, record_id string, target_uri string, date string, http_headers string, payload binary, payload_digest string")


_OUT = [("warc_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("concurrent_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("content_type", pa.string()), ("content_length", pa.int64()), ("block_digest", pa.string()), ("source_digest", pa.string()), ("block", pa.string())]


def derive_one(record_id: str, target: str | None, date: str, http_headers: str, payload: bytes, payload_digest: str) -> list[tuple]:
    """The metadata and the conversion record of one response."""
    page = payload.decode("utf-8", "replace")
    text = text_of(page).encode()
    conversion = identifier("conversion", record_id, digest(text))
    status, *lines = http_headers.split("\r\n")
    envelope = {
        "source": {"WARC-Type": "response", "WARC-Record-ID": record_id, "WARC-Target-URI": target, "WARC-Date": date, "WARC-Payload-Digest": payload_digest},
        "http": {"status": status, "headers": [[k, v.strip()] for k, _, v in (x.partition(":") for x in lines if x)]},
        "html": page_metadata(page),
    }
    meta = json.dumps(envelope, ensure_ascii=False, sort_keys=True).encode()
    out = []
    for kind, own, other, content, block in (("metadata", identifier("metadata", record_id, digest(meta)), conversion, "application/json", meta), ("conversion", conversion, None, "text/plain; charset=utf-8", text)):
        out.append((kind, own, record_id, other, target, date, content, len(block), digest(block), payload_digest, block.decode()))
    return out


def derivatives(records: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Two rows for each response: its metadata and its conversion record."""
    kind = records.schema[id_col].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                rows = [(i, *r) for i, x in enumerate(zip(*(part.column(k).to_pylist() for k in range(1, 7)), strict=True)) for r in derive_one(*x)]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(cols[0])), *(pa.array(c, type=t) for c, (_, t) in zip(cols[1:], _OUT, strict=True))], names=[id_col, *(n for n, _ in _OUT)])

    ddl = ", ".join(f"{n} {'long' if t == pa.int64() else 'string'}" for n, t in _OUT)
    source = records.select(id_col, "record_id", "target_uri", "date", "http_headers", "payload", "payload_digest")
    return source.mapInArrow(task, f"`{id_col}` {kind}, {ddl}")


def serialised(records: DataFrame) -> DataFrame:
    """Derivatives as WARC records, each a gzip member of its own: ``record_id, member``. Members may be
    concatenated to files in any number and order."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([r["record_id"] for r in rows], type=pa.string()), pa.array([gzip.compress(record_bytes(r), mtime=0) for r in rows], type=pa.binary())], names=["record_id", "member"])

    return records.select(*[n for n, _ in _OUT]).mapInArrow(task, "record_id string, member binary")


_NAMES = (("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Concurrent-To", "concurrent_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("Content-Type", "content_type"), ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Payload-Digest", "source_digest"))


def record_bytes(r: dict) -> bytes:
    block = (r["block"] or "").encode()
    # a header's value can hold no line end
    head = [VERSION, *(f"{name}: {' '.join(str(r[col]).split())}" for name, col in _NAMES if r[col] is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(stream: bytes) -> Iterator[dict]:
    """Records of a WARC file's bytes, compressed or not."""
    if stream[:2] == b"\x1f\x8b":
        stream = gzip.decompress(stream)
    at = 0
    while at < len(stream):
        end = stream.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in stream[at:end].decode().split("\r\n")[1:])
        n = int(head["Content-Length"])
        yield {**{col: head.get(name) for name, col in _NAMES}, "content_length": n, "block": stream[end + 4 : end + 4 + n].decode("utf-8", "replace")}
        at = end + 8 + n


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, one file at a time in a task."""
    ddl = ", ".join(f"{n} {'long' if t == pa.int64() else 'string'}" for n, t in _OUT)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0).to_pylist():
                rows = list(parse(content))
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], type=t) for n, t in _OUT], names=[n for n, _ in _OUT])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(task, ddl)
