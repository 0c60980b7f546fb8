import base64
import hashlib
import html
import random
import re
import time
from html.parser import HTMLParser

from pyspark.sql import functions as F

from flowlake.llm import warc as W

PAGES = [
    (1, "http://a.example/x?y=1&z=2", "<html><head><title>T &amp; t</title><style>p{}</style></head><body><nav><a href='/one'>one</a></nav>"
        "<!-- <p>no</p> --><script>var t='</p>';</script><p>Hé <b>bold</b>&nbsp;x &lt;y&gt;<br>next  line</p><a class=c href=\"/two?a=1&amp;b=2\">two</a></body></html>"),
    (2, None, None), (3, "u\r\nInjected: 1", "<p>unclosed <b>text"), (4, "http://b.example", ""), (1, "http://a.example/x?y=1&z=2", "plain\r\n\r\ntext"),
    (5, "http://c.example", "<script>never closed <p>x"), (None, "http://d.example", "<p>" + "long word " * 30_000 + "</p>"),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("block", F.lit(1)).withColumn("header", F.lit("x"))


class Brute(HTMLParser):
    def __init__(self):
        super().__init__()
        self.hide, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.hide += tag in ("script", "style", "head")

    def handle_endtag(self, tag):
        self.hide -= tag in ("script", "style", "head")

    def handle_data(self, data):
        if not self.hide:
            self.out.append(data)


def test_records_are_linked_and_digested(ready_spark):
    src = {r["record_id"]: r for r in W.responses(pages(ready_spark)).collect()}
    out = W.derive(W.responses(pages(ready_spark))).collect()
    assert len(src) == len(PAGES) and len(out) == 2 * len(PAGES)
    for r in out:
        s, f = src[r["refers_to"]], W.fields_of(r["header"])
        body = s["block"].split(b"\r\n\r\n", 1)[1]
        sha = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert f["warc-refers-to"] == s["record_id"] and f["warc-source-payload-digest"] == sha == W.fields_of(s["header"])["warc-payload-digest"]
        assert f["warc-block-digest"] == W.digest(bytes(r["block"])) and int(f["content-length"]) == len(r["block"])
        assert f["warc-date"] == "2026-01-01T00:00:00Z" and f["warc-target-uri"] == s["target_uri"].replace("\r\n", " ")
        assert "injected" not in f
    assert len({r["record_id"] for r in out}) == len(out)


def test_text_and_metadata(ready_spark):
    one = ready_spark.createDataFrame(PAGES[:1], "page_id long, url string, html string")
    out = {r["type"]: bytes(r["block"]).decode() for r in W.derive(W.responses(one)).collect()}
    assert out["conversion"] == "one\nHé bold x <y>\nnext line\ntwo"
    lines = out["metadata"].split("\r\n")
    assert "title: T & t" in lines and "outlink: /one" in lines and "outlink: /two?a=1&b=2" in lines
    assert "source-header: Content-Type: text/html; charset=utf-8" in lines and "status: HTTP/1.1 200 OK" in lines


def test_text_against_a_parser(ready_spark, sf_small):
    for r in ready_spark.read.parquet(f"{sf_small}/pages.parquet").limit(50).collect():
        b = Brute()
        b.feed(r["html"])
        b.close()
        assert W.page_text(r["html"]).split() == " ".join(b.out).split() or \
            "".join(W.page_text(r["html"]).split()) == "".join("".join(b.out).split())


def test_damaged_digest_is_kept_and_told(ready_spark):
    r = W.responses(pages(ready_spark, PAGES[:1])).withColumn("header", F.regexp_replace("header", "sha1:[A-Z2-7]+", "sha1:WRONG"))
    out = {x["type"]: x for x in W.derive(r).collect()}
    assert W.fields_of(out["conversion"]["header"])["warc-source-payload-digest"] == "sha1:WRONG"
    assert b"digest-mismatch: true" in bytes(out["metadata"]["block"])
    assert W.derive(r.withColumn("type", F.lit("request"))).count() == 0


def test_files_round_trip(ready_spark, tmp_path):
    d = W.derive(W.responses(pages(ready_spark)))
    W.write(d, f"{tmp_path}/w", "gzip")
    back = {r["record_id"]: r for r in W.read_records(ready_spark, f"{tmp_path}/w").collect()}
    want = {r["record_id"]: bytes(r["block"]).decode() for r in d.collect()}
    assert {k: r["block"] for k, r in back.items()} == want
    assert all(r["whole"] for r in back.values())
    assert W.derive(W.responses(pages(ready_spark, []))).count() == 0


#: the rules as plain patterns, quadratic on tags without an end
DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
HEAD = re.compile(r"<head\b[^>]*>.*?</head\s*>", re.S | re.I)
TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def plain_text(page):
    t = W._TAG.sub("", W._BREAK.sub("\n", HEAD.sub("", DROP.sub("", page))))
    return W._LINES.sub("\n", W._SPACES.sub(" ", html.unescape(t).replace("\r", "\n"))).strip()


def test_scanners_equal_the_plain_patterns():
    rng = random.Random(21)
    bits = ["<a ", "<a", "<A href='/x'", "href=", 'href = "/y"', "href='", '"', "'", ">", " ", "</a>", "<title>", "<title x", "</title>", "</TITLE >",
            "<head>", "<head ", "</head>", "<header>", "<script>", "<script ", "</script>", "</style>", "<style>", "<!--", "-->", "<!-->", "<p", "<br>",
            "text", "&amp;", "\n", "é", "<template>", "</template\n>", "<>", "</", "x=1"]
    for _ in range(30_000):
        page = "".join(rng.choice(bits) for _ in range(rng.randint(0, 24)))
        assert W.without_hidden(page) == DROP.sub("", page), page
        assert W.page_text(page) == plain_text(page), page
        assert W.links(page) == [html.unescape(a or b or c) for a, b, c in LINK.findall(DROP.sub("", page))], page
        m = TITLE.search(page)
        assert W.title_of(page) == (" ".join(html.unescape(W._TAG.sub("", m[1])).split()) if m else ""), page


def test_pages_of_unclosed_tags_take_linear_time():
    for bit in ("<a ", "<a x", "<title>", "<title ", "<head>", "<head ", "<script ", "<script>", "<!-", "<!--", "<p ", "<a>", "<a href=", "<a href='",
                "</script ", "<", "&", "\n "):
        for tail in ("", ">", "<a href=/x>", "</p>"):
            page = bit * (1_000_000 // len(bit)) + tail
            began = time.time()
            W.page_text(page), W.title_of(page), W.links(page)
            assert time.time() - began < 10, (bit, tail)


class Facts(HTMLParser):
    def __init__(self):
        super().__init__()
        self.title, self.links, self.inside = "", [], False

    def handle_starttag(self, tag, attrs):
        self.inside = tag == "title"
        self.links += [v for k, v in attrs if tag == "a" and k == "href"]

    def handle_endtag(self, tag):
        self.inside = False

    def handle_data(self, data):
        self.title += data if self.inside else ""


def test_metadata_against_a_parser(ready_spark, sf_small):
    src = ready_spark.read.parquet(f"{sf_small}/pages.parquet")
    res = W.responses(src)
    pages_of = {r["record_id"]: bytes(r["block"]).split(b"\r\n\r\n", 1)[1].decode() for r in res.collect()}
    for r in W.derive(res).filter("type = 'metadata'").collect():
        b = Facts()
        b.feed(pages_of[r["refers_to"]])
        b.close()
        lines = bytes(r["block"]).decode().split("\r\n")
        assert [x[9:] for x in lines if x.startswith("outlink: ")] == b.links
        assert f"title: {' '.join(b.title.split())}" in lines and "status: HTTP/1.1 200 OK" in lines
        assert f"payload-length: {len(pages_of[r['refers_to']].encode())}" in lines and "media-type: text/html; charset=utf-8" in lines
