"""Pages through the ingest chain: each parser, each gate, and every page accounted for once."""

import pytest
from pyspark.sql import functions as F

from tesserae.operators import ingest

LONG = "Some words of a text that is long enough to be kept. " * 8
DOCS = f"<html><head><title>T</title><script>var x;</script></head><body><nav>menu</nav><h1>H</h1><p>{LONG}</p><pre><code>print('hello world')</code></pre><pre>short</pre><footer>foot</footer></body></html>"
WIKI = f'<div id="top">menu</div><div class="a" id="mw-content-text"><div><p>{LONG}</p></div> tail </div><div>after</div>'

PAGES = [
    ("https://a.org/x.json", '{"a": 1}', "raw file", "kept", ""),
    ("https://github.com/o/r/blob/main/f.py", "def f(): pass\n" + LONG, "plain text", "kept", ""),
    ("https://github.com/o/r", "<html></html>", "repository", "skipped", "repository"),
    ("https://en.wikipedia.org/wiki/X", WIKI, "wikipedia", "kept", ""),
    ("https://a.org/docs", DOCS, "docs", "kept", ""),
    ("https://a.org/post", f"<header>h</header><article><nav>n</nav><p>{LONG}</p></article><aside>side</aside>", "article", "kept", ""),
    ("https://a.org/long", f"<p>{LONG}</p>" * 3, "generic", "kept", ""),
    ("https://a.org/thin", "<p>little</p>", "thin", "skipped", "low quality"),
    ("https://a.org/wait", f"<main>{LONG} please wait {LONG}</main>", "article", "skipped", "low quality"),
    ("ftp://a.org/", DOCS, "docs", "skipped", "unsafe: scheme"),
    ("http://10.1.2.3/", DOCS, "docs", "skipped", "unsafe: private address"),
    ("https://a.org/none", None, "generic", "skipped", "not fetched"),
    ("https://a.org/empty", "", "thin", "skipped", "timeout"),
    (None, DOCS, "docs", "skipped", "unsafe: scheme"),
    ("https://a.org/stored", DOCS, "docs", "cached", "cached"),
    ("https://a.org/stored", DOCS, "docs", "cached", "cached"),
]


@pytest.fixture(scope="module")
def judged(spark):
    pages = spark.createDataFrame([(k, u, h) for k, (u, h, *_) in enumerate(PAGES)], "page_id long, url string, html string").withColumn("content_", F.lit("extra"))
    stored = spark.createDataFrame([("https://a.org/stored",), ("https://a.org/stored",), (None,)], "url string")
    return ingest.ingest(pages, stored).cache()


def test_every_page_once(judged):
    got = {r["page_id"]: (r["route"], r["status"], r["reason"] or "") for r in judged.collect()}
    assert got == {k: tuple(p[2:]) for k, p in enumerate(PAGES)} and judged.count() == len(PAGES)
    assert sum(r["n"] for r in ingest.reasons(judged).collect()) == len(PAGES)
    assert ingest.summary(judged).first().asDict() == {"total": 16, "successful": 8, "cached": 2, "fresh": 6, "skipped": 8}
    assert "content_" in judged.columns


def test_parsers(judged):
    rows = {r["url"]: r for r in judged.filter("status = 'kept'").collect()}
    text = LONG.strip()
    assert rows["https://a.org/x.json"]["code_blocks"][0]["language"] == "json" and rows["https://a.org/x.json"]["content"] == '{"a": 1}'
    assert rows["https://github.com/o/r/blob/main/f.py"]["address"] == "https://raw.githubusercontent.com/o/r/main/f.py"
    assert rows["https://en.wikipedia.org/wiki/X"]["content"] == f"{text} tail"
    docs = rows["https://a.org/docs"]
    assert docs["title"] == "T" and [b["snippet"] for b in docs["code_blocks"]] == ["print('hello world')"]
    assert docs["content"] == f"T H {text} print('hello world') short"
    assert rows["https://a.org/post"]["content"] == text


def test_content_types(spark):
    pages = spark.createDataFrame([("https://a.org/a", DOCS, "text/html; charset=utf-8"), ("https://a.org/b", LONG, "text/plain"), ("https://a.org/c", LONG, "image/png"), ("https://a.org/d", DOCS, None)], "url string, html string, content_type string")
    got = {r["url"]: (r["route"], r["status"], r["reason"]) for r in ingest.ingest(pages).collect()}
    assert got["https://a.org/a"] == got["https://a.org/d"] == ("docs", "kept", None)
    assert got["https://a.org/b"] == ("plain text", "kept", None) and got["https://a.org/c"][1:] == ("skipped", "content type")


def test_nothing(spark):
    nothing = spark.createDataFrame([], "url string, html string")
    assert ingest.ingest(nothing).count() == 0 and ingest.summary(ingest.ingest(nothing)).first()["total"] == 0


def test_nested_elements(spark):
    page = spark.createDataFrame([('<div id="x"><div>a</div><DIV>b<div>c</div></DIV>d</div><div>e</div>',), ("<p>none</p>",), ('<div id="x">open <div>end',)], "h string")
    got = [r[0] for r in page.select(ingest.element(F.col("h"), r'<div\b[^>]*\bid="x"[^>]*>', "div")).collect()]
    assert got == ["<div>a</div><DIV>b<div>c</div></DIV>d", None, "open <div>end"]
