"""WARC derivatives: responses to linked metadata and plain-text conversion records.

Method.  Every response record gives one ``metadata`` record (status, media type, title,
links, in ``application/warc-fields``, followed by the source's HTTP header lines)
and one ``conversion`` record (its page as plain text).  Both name the
response in WARC-Refers-To, its target and date, and keep its payload digest as
WARC-Source-Payload-Digest; each has its own block digest.  Record ids are functions of
the source's id, so a repeated or restarted job writes the same records.

Records are rows; each is derived from one response alone, in place.  ``write``
makes WARC files with Spark's own text writer (and so its commit protocol), as
derivative blocks are UTF-8 text; ``read_records`` reads them back in splits.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.llm.common import query, read

VERSION, CRLF = "WARC/1.1", "\r\n"
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:flowlake:warc")
RECORD = ("record_id string, type string, target_uri string, date string, refers_to string, "
          "header string, block binary")
_HIDDEN = re.compile(r"<!--|<(script|style|noscript|template)\b", re.I)
_HEAD, _HEAD_END = re.compile(r"<head\b", re.I), re.compile(r"</head\s*>", re.I)
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|"
                    r"header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)")
_SPACES = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")
_TITLE, _TITLE_END = re.compile(r"<title\b", re.I), re.compile(r"</title\s*>", re.I)
_A = re.compile(r"<a\b", re.I)
_HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CHARSET = re.compile(r"charset=[\"']?([\w.:-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def without_hidden(page: str) -> str:
    """The page without comments, scripts, styles and templates; what is never closed is hidden to the end.

    Each place is looked at a bounded number of times: a search for an end either
    consumes what it passes or, if it fails, isn't made again.
    """
    out, at, done = [], 0, 0
    last = page.rfind(">")
    while m := _HIDDEN.search(page, at):
        at = m.end()
        if m[1] is None:
            end = page.find("-->", at)
            end = len(page) if end < 0 else end + 3
        elif at > last:                         # its tag has no end
            continue
        else:
            close = re.compile(rf"</{m[1]}\s*>", re.I).search(page, page.find(">", at) + 1)
            end = close.end() if close else len(page)
        out.append(page[done:m.start()])
        at = done = end
    return "".join([*out, page[done:]])


def _element(page: str, start: re.Pattern, end: re.Pattern, at: int = 0) -> tuple[int, int, int, int] | None:
    """Places of the first whole element from ``at``: start, inner start, inner end, end.

    If the first start has no end behind its tag, no later one has.
    """
    m = start.search(page, at)
    inner = page.find(">", m.end()) + 1 if m else 0
    close = end.search(page, inner) if inner else None
    return (m.start(), inner, close.start(), close.end()) if close else None


def without_head(page: str) -> str:
    out, done = [], 0
    while e := _element(page, _HEAD, _HEAD_END, done):
        out.append(page[done:e[0]])
        done = e[3]
    return "".join([*out, page[done:]])


def title_of(page: str) -> str:
    e = _element(page, _TITLE, _TITLE_END)
    return " ".join(entities.unescape(_TAG.sub("", page[e[1]:e[2]])).split()) if e else ""


def links(page: str) -> list[str]:
    """Targets of the links, in order.  A link is an ``a`` with an ``href`` before the tag's end."""
    page = without_hidden(page)
    out, at, h = [], 0, None
    while m := _A.search(page, at):
        if h is None or h.start() < m.end():
            h = _HREF.search(page, m.end())
            if h is None:
                break
        end = page.find(">", m.end(), h.start())
        if end < 0:
            out.append(entities.unescape(h[1] or h[2] or h[3] or ""))
            at = h.end()
        else:                                   # the tag ends before the next href, for all starts before that end
            at = end + 1
    return out


def page_text(page: str) -> str:
    """Visible text, one line per block element; no scripts, styles, comments or head."""
    t = without_head(without_hidden(page))
    closed = t.rfind(">") + 1                   # behind it no tag ends
    t = _TAG.sub("", _BREAK.sub("\n", t[:closed]) + t[closed:])
    return _LINES.sub("\n", _SPACES.sub(" ", entities.unescape(t).replace("\r", "\n"))).strip()


def header_lines(fields: list[tuple[str, str]]) -> str:
    return VERSION + CRLF + "".join(f"{k}: {_line(v)}{CRLF}" for k, v in fields)


def _line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def fields_of(header: str) -> dict[str, str]:
    """Header names (lower case) and values; of a repeated name the first."""
    out: dict[str, str] = {}
    for line in header.split("\n"):
        k, colon, v = line.strip().partition(":")
        if colon:
            out.setdefault(k.strip().lower(), v.strip())
    return out


def responses(pages: DataFrame, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """Response records of fetched pages (page_id, url, html).  A null html is an empty body, a null url ''.
    The date is a parameter, as the pages carry none."""
    def run(batches):
        for batch in batches:
            rows = []
            for pid, url, page in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                body, url = (page or "").encode(), url or ""
                block = (f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"
                         f"Content-Length: {len(body)}{CRLF}{CRLF}").encode() + body
                rid = f"<urn:uuid:{uuid.uuid5(SPACE, f'{pid} {url} {digest(body)}')}>"
                head = header_lines([("WARC-Type", "response"), ("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", url),
                                     ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block)),
                                     ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))])
                rows.append((rid, "response", url, date, None, head, block))
            yield _batch(rows, _RECORD_TYPES)
    return pages.select("page_id", "url", "html").mapInArrow(run, RECORD)


_RECORD_TYPES = pa.schema([(n, pa.binary() if n == "block" else pa.string()) for n in
                           ("record_id", "type", "target_uri", "date", "refers_to", "header", "block")])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def split_http(block: bytes) -> tuple[str, bytes]:
    """Header lines and payload; a block without an HTTP header is all payload."""
    m = re.search(rb"\r?\n\r?\n", block) if block.startswith(b"HTTP/") else None
    return (block[:m.start()].decode("latin-1"), block[m.end():]) if m else ("", block)


def decode(payload: bytes, media: str) -> str:
    m = _CHARSET.search(media) or _CHARSET.search(payload[:2048].decode("latin-1"))
    try:
        return payload.decode(m[1] if m else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def _derived(kind: str, src: tuple, media: str, payload_digest: str, block: bytes) -> tuple:
    rid, uri, date = src
    own = f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind} {rid}')}>"
    head = header_lines([("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", rid), ("WARC-Date", date),
                         ("WARC-Target-URI", uri), ("WARC-Source-Payload-Digest", payload_digest),
                         ("WARC-Block-Digest", digest(block)), ("Content-Type", media), ("Content-Length", str(len(block)))])
    return own, kind, uri, date, rid, head, block


def derive(records: DataFrame) -> DataFrame:
    """Two records for each response; other records give none.

    A source digest that is missing is computed; one that doesn't fit its payload is kept, as the source says it,
    and told in the metadata (``digest-mismatch: true``).  A null block is
    empty.  Repeated responses give repeated, equal records.  Time is linear in the page, also for tags, titles,
    heads and scripts that are never closed.
    """
    def run(batches):
        for batch in batches:
            rows = []
            cols = [batch.column(i).to_pylist() for i in range(5)]
            for rid, uri, date, header, block in zip(*cols, strict=True):
                src = (rid or "", uri or "", date or "")
                http, payload = split_http(block or b"")
                fields, real = fields_of(http), digest(payload)
                said = fields_of(header or "").get("warc-payload-digest", real)
                media = fields.get("content-type", "")
                page = decode(payload, media)
                meta = [("status", http.split("\n", 1)[0].strip()), ("media-type", media), ("payload-length", str(len(payload))),
                        ("title", title_of(page))]
                if said != real:
                    meta.append(("digest-mismatch", "true"))
                meta += [("outlink", x) for x in links(page)]
                meta += [("source-header", line.strip()) for line in http.split("\n") if line.strip()]
                body = "".join(f"{k}: {_line(v)}{CRLF}" for k, v in meta).encode()
                rows.append(_derived("metadata", src, "application/warc-fields", said, body))
                rows.append(_derived("conversion", src, "text/plain; charset=utf-8", said, page_text(page).encode()))
            yield _batch(rows, _RECORD_TYPES)
    return records.filter("type = 'response'").select("record_id", "target_uri", "date", "header", "block").mapInArrow(run, RECORD)


def write(derived: DataFrame, path: str, compression: str = "none") -> None:
    """WARC files, one per task; a derivative's block is UTF-8 text."""
    record = F.concat("header", F.lit(CRLF), F.col("block").cast("string"))
    derived.select(record).write.option("lineSep", CRLF * 2).option("compression", compression).text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files of text: header, block, whole (false: its length differs from Content-Length)."""
    raw = spark.read.option("lineSep", CRLF * 2 + VERSION + CRLF).text(path)
    head = F.substring_index("value", CRLF * 2, 1)
    raw = raw.withColumn("head", F.regexp_replace(head, "^" + re.escape(VERSION + CRLF), ""))
    block = F.expr(f"substring(value, length(substring_index(value, '{CRLF * 2}', 1)) + 5)")
    block = F.regexp_replace(block, r"\r\n\r\n\z", "")       # the last record of a file ends with the separator's first half
    field = lambda n: F.regexp_extract("head", rf"(?im)^{n}:\s*(.*?)\s*$", 1)
    return raw.select(field("WARC-Record-ID").alias("record_id"), field("WARC-Type").alias("type"),
                      field("WARC-Refers-To").alias("refers_to"), "head", block.alias("block")).withColumn(
        "whole", F.octet_length("block") == F.regexp_extract("head", r"(?im)^Content-Length:\s*(\d+)", 1).cast("int"))


@query("op6_warc_derivatives")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both derivative records of every page."""
    out = derive(responses(read(spark, sf_dir, "pages")))
    source = F.regexp_extract("header", r"(?m)^WARC-Source-Payload-Digest: (\S*)", 1)
    own = F.regexp_extract("header", r"(?m)^WARC-Block-Digest: (\S*)", 1)
    return out.select("record_id", "type", "refers_to", "target_uri", source.alias("source_digest"), own.alias("block_digest"),
                      F.octet_length("block").cast("long").alias("n_bytes"), F.sha2("block", 256).alias("block_sha256"))
