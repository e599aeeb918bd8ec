"""HTML columns by regular expressions, and a DOM-order parser in an Arrow UDF for what needs the order of elements."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions import fixed

ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def unescape(text: Column) -> Column:
    """The common character references."""
    for name, value in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(value))
    return text


def title(html: Column) -> Column:
    """Title, else og:title, else the first h1 or h2; at most 200 characters."""
    tidy = lambda x: F.nullif(F.trim(F.regexp_replace(unescape(F.regexp_replace(x, "<[^>]*>", "")), r"\s+", " ")), F.lit(""))
    found = F.coalesce(
        tidy(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)),
        tidy(F.regexp_extract(html, r'(?is)<meta[^>]+property="og:title"[^>]+content="([^"]*)"', 1)),
        tidy(F.regexp_extract(html, r"(?is)<h[12][^>]*>(.*?)</h[12]>", 1)),
        F.lit(""),
    )
    return F.substring(found, 1, 200)


def description(html: Column) -> Column:
    """The meta description."""
    return F.trim(unescape(F.regexp_extract(html, r'(?is)<meta[^>]+name="description"[^>]+content="([^"]*)"', 1)))


def language(html: Column) -> Column:
    return F.lower(F.regexp_extract(html, r'(?is)<html[^>]*\blang="([^"]*)"', 1))


def text(html: Column, most: int = 1_000_000) -> Column:
    """Lower-case text without scripts, styles and page furniture, in single spaces."""
    bare = html
    for name in ("script", "style", "nav", "footer", "header"):
        bare = F.regexp_replace(bare, rf"(?is)<{name}\b.*?</{name}>", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), "<[^>]*>", " ")
    return F.substring(F.lower(F.trim(F.regexp_replace(unescape(bare), r"\s+", " "))), 1, most)


def article(html: Column) -> Column:
    """The article's markup, else main's, else the whole page."""
    part = lambda name: F.nullif(F.regexp_extract(html, rf"(?is)<{name}\b[^>]*>(.*)</{name}>", 1), F.lit(""))
    return F.coalesce(part("article"), part("main"), html)


def paragraphs(html: Column, least: int = 20) -> Column:
    """Texts that begin at a <p>, unclosed ones too."""
    pieces = F.slice(F.split(html, r"(?i)<p[ >]"), 2, 100_000)
    tidy = lambda x: F.trim(F.regexp_replace(unescape(F.regexp_replace(F.regexp_replace(x, r"(?is)</p>.*$", ""), "<[^>]*>", " ")), r"\s+", " "))
    return F.filter(F.transform(pieces, tidy), lambda x: F.length(x) > least)


def headings(html: Column) -> Column:
    """Texts of h1 to h6 of more than two characters, at most 200 each."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.substring(F.trim(F.regexp_replace(unescape(F.regexp_replace(x, "<[^>]*>", "")), r"\s+", " ")), 1, 200)), lambda x: F.length(x) > 2)


def hrefs(html: Column) -> Column:
    """Link targets in order, without script, mail and phone ones and without fragments, each once."""
    found = F.regexp_extract_all(html, F.lit(r"""(?is)<a\b[^>]*?\bhref=["']([^"']*)["']"""), F.lit(1))
    kept = F.filter(found, lambda x: ~F.lower(x).rlike("^(javascript|mailto|tel):") & (x != "") & ~x.startswith("#"))
    return F.array_distinct(F.transform(kept, lambda x: F.regexp_replace(x, "#.*$", "")))


def resolve(base: Column, link: Column) -> Column:
    """A link against its page: absolute, protocol-relative, rooted or relative."""
    root = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    folder = F.regexp_replace(F.regexp_extract(base, r"^[^?#]*", 0), "[^/]*$", "")
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*:", 0), link))
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(folder, link))
    )


def needs_browser(html: Column) -> Column:
    """Pages whose content comes by script."""
    scripts = F.regexp_count(html, F.lit("(?i)<script"))
    return (F.length(html) < 1500) | html.rlike(r"""(?i)<div id=["']root["']>\s*</div>""") | ((scripts > 15) & (F.regexp_count(html, F.lit("(?i)<p")) < 3))


def page_type(url: Column, html: Column) -> Column:
    """C18."""
    return (
        F.when(url.contains("github.com"), "github")
        .when(F.lower(url).rlike(r"\.(json|ya?ml|toml|ini|xml|cfg|conf)$"), "config")
        .when(url.contains("wikipedia.org"), "wikipedia")
        .when(html.contains("<pre") & html.contains("<code"), "docs")
        .when(html.contains("<table") & (html.contains("<code") | html.contains("<h")), "docs")
        .when(html.contains("<article") | html.contains("<main"), "article")
        .when(F.length(html) < 500, "thin")
        .otherwise("generic")
    )


def content_type(content: Column, url: Column) -> Column:
    """C19."""
    start = F.trim(content)
    return (
        F.when(F.coalesce(start, F.lit("")) == "", "plaintext")
        .when(start.rlike(r"^[{\[]") & F.try_parse_json(start).isNotNull(), "json")
        .when(start.startswith("<?xml"), "xml")
        .when(F.lower(start).rlike("<(html|body|div)"), "html")
        .when(F.lower(url).rlike(r"\.(xml|pom)$"), "xml")
        .when(F.lower(url).rlike(r"\.(json|ya?ml)$"), "json")
        .when(F.lower(url).rlike(r"\.(md|txt|rst)$"), "plaintext")
        .otherwise("html")
    )


def config_kind(code: Column) -> Column:
    """The first that fits, by substring."""
    low = F.lower(code)
    return F.when(low.contains("yaml") | low.contains("yml"), "yaml").when(low.contains("json"), "json").when(low.contains("ini"), "ini").when(low.contains("env"), "env").when(low.contains("docker"), "docker")


def schema_kind(code: Column) -> Column:
    """An HTTP endpoint, a JSON schema, or null."""
    return F.when(code.rlike(r"\b(GET|POST|PUT|DELETE|PATCH)\b"), "http_endpoint").when(code.contains("{") & (code.contains(":") | code.contains("}")), "json_schema")


def junk(text_: Column) -> Column:
    """Text of page furniture."""
    low = F.lower(F.trim(text_))
    return F.coalesce(low.rlike("|".join(re.escape(k) for k in fixed.JUNK_KEYWORDS)), F.lit(False))


def literal_of(pattern: str) -> str:
    """The longest run of fixed characters of a language's pattern, in lower case: what the pattern finds holds it, in any case."""
    fixed_runs = re.sub(r"\\[bsw][*+]?|\[\^?[^\]]*\][*+]?|\^", "\n", pattern).replace("\\", "").split("\n")
    return max(fixed_runs, key=len).lower()


def detect_language(code: Column) -> Column:
    """The language with the most patterns found, the first of equals, else `unknown`.

    A pattern is looked for only where its longest fixed run occurs, which takes a small part of the time.
    """
    options = []
    low = F.lower(code)
    for k, (name, patterns) in enumerate(fixed.LANGUAGE_PATTERNS.items()):
        score = F.lit(0)
        for p in patterns:
            score = score + (low.contains(literal_of(p)) & code.rlike("(?im)" + p)).cast("int")
        options.append(F.struct(score.alias("score"), F.lit(-k).alias("order"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*options))
    return F.when(best["score"] > 0, best["name"]).otherwise("unknown")


def language_alias(name: Column) -> Column:
    """D21."""
    value = F.coalesce(F.nullif(F.lower(F.trim(name)), F.lit("")), F.lit("unknown"))
    chain = value
    for short, long in fixed.LANGUAGE_ALIASES.items():
        chain = F.when(value == short, F.lit(long)).otherwise(chain)
    return chain


def slug(text_: Column) -> Column:
    """D11."""
    return F.trim(F.regexp_replace(F.lower(text_), "[^a-z0-9]+", "-"), F.lit("-"))


# --- DOM order -------------------------------------------------------------------------------------------------------

PARSED = T.StructType(
    [
        T.StructField("headings", T.ArrayType(T.StructType([T.StructField("level", T.StringType()), T.StructField("text", T.StringType())]))),
        T.StructField("links", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("url", T.StringType())]))),
        T.StructField("code_blocks", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("snippet", "language", "context")]))),
        T.StructField("topics", T.ArrayType(T.StructType([T.StructField("topic", T.StringType()), T.StructField("heading", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("content", T.StringType())]))),
        T.StructField("tables", T.ArrayType(T.ArrayType(T.ArrayType(T.StringType())))),
    ]
)
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_ARROW = pa.struct(
    [
        ("headings", pa.list_(pa.struct([("level", pa.string()), ("text", pa.string())]))),
        ("links", pa.list_(pa.struct([("text", pa.string()), ("url", pa.string())]))),
        ("code_blocks", pa.list_(pa.struct([("snippet", pa.string()), ("language", pa.string()), ("context", pa.string())]))),
        ("topics", pa.list_(pa.struct([("topic", pa.string()), ("heading", pa.string()), ("level", pa.int32()), ("content", pa.string())]))),
        ("tables", pa.list_(pa.list_(pa.list_(pa.string())))),
    ]
)


class _Reader(HTMLParser):
    """Collects headings, links, code, topics and tables in document order."""

    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url = url
        self.out: dict[str, list] = {"headings": [], "links": [], "code_blocks": [], "topics": [], "tables": []}
        self.open: list[tuple[str, dict, list[str]]] = []
        self.skip = 0
        self.heading = self.near = ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in (*_HEADINGS, "a", "pre", "code", "p", "li", "td", "th"):
            if tag in ("p", "li"):
                self._close(tag)
            elif tag in ("td", "th"):
                self._close_cells()
            self.open.append((tag, dict(attrs), []))
        elif tag == "table":
            self._tables().append([])
        elif tag == "tr" and self._tables():
            self._close_cells()
            self._tables()[-1].append([])

    def _close_cells(self) -> None:
        for _ in range(sum(t in ("td", "th") for t, _, _ in self.open)):
            self._close("td")
            self._close("th")

    def _tables(self) -> list:
        return self.out["tables"]

    def handle_data(self, data: str) -> None:
        if not self.skip:
            for _, _, parts in self.open:
                parts.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        else:
            if tag in ("tr", "table"):
                self._close_cells()
            self._close(tag)

    def _close(self, tag: str) -> None:
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] == tag), None)
        if at is None:
            return
        _, attrs, parts = self.open.pop(at)
        raw = "".join(parts)
        value = " ".join(raw.split())
        if tag in _HEADINGS:
            if value:
                self.out["headings"].append({"level": tag, "text": value[:200]})
                self.out["topics"].append({"topic": re.sub("[^a-z0-9]+", "-", value.lower()).strip("-"), "heading": value, "level": int(tag[1]), "content": ""})
                self.heading = value
        elif tag == "a":
            target = attrs.get("href") or ""
            if target and not re.match("(?i)(javascript|mailto|tel):|#", target):
                try:
                    self.out["links"].append({"text": value, "url": urljoin(self.url, target).split("#")[0]})
                except ValueError:
                    pass
        elif tag in ("pre", "code"):
            inside = any(t in ("pre", "code") for t, _, _ in self.open)
            if not inside and len(raw.strip()) >= 10:
                context = " | ".join(x for x in (self.near[:200], self.heading) if x)
                self.out["code_blocks"].append({"snippet": raw.strip()[:5000], "language": _class_language(attrs), "context": context})
        elif tag in ("td", "th"):
            if self._tables() and self._tables()[-1]:
                self._tables()[-1][-1].append(value)
        elif value:
            self.near = value
            if self.out["topics"]:
                topic = self.out["topics"][-1]
                if topic["content"].count("\n") < 4:
                    topic["content"] = (topic["content"] + "\n" + value).strip()[:500]

    def result(self) -> dict:
        while self.open:
            self._close(self.open[-1][0])
        unique = {}
        for c in self.out["code_blocks"]:
            unique.setdefault((c["snippet"], c["language"], c["context"]), c)
        topics = {}
        for t in self.out["topics"]:
            topics.setdefault((t["topic"], t["heading"]), t)
        return self.out | {"code_blocks": [*unique.values()][:200], "topics": [*topics.values()][:200], "tables": [t[:20] for t in self.out["tables"][:10]]}


def _class_language(attrs: dict) -> str:
    """D20, from attributes alone: language-x or lang-x, a bare name, data-language."""
    for name in (attrs.get("class") or "").lower().split():
        if m := re.search(r"(?:language|lang)-(\S+)", name):
            return m[1]
        if name in fixed.LANGUAGE_PATTERNS:
            return name
    return (attrs.get("data-language") or attrs.get("data-lang") or "").lower()


def parse(pages: DataFrame, *, url: str = "url", html: str = "html", into: str = "parsed") -> DataFrame:
    """The pages with one struct of their elements in document order. One narrow pass.

    A block without a language of its own gets one by its patterns (D20) and aliases (D21), in generated code.
    """
    pages = pages.drop(into) if into in pages.columns else pages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for base, value in zip(batch.column(url).to_pylist(), batch.column(html).to_pylist(), strict=True):
                reader = _Reader(base or "")
                reader.feed(value or "")
                rows.append(reader.result())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _ARROW)], names=[*batch.schema.names, into])

    found = pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField(into, PARSED)]))
    coded = F.transform(
        F.col(into)["code_blocks"],
        lambda c: F.struct(c["snippet"].alias("snippet"), language_alias(F.coalesce(F.nullif(c["language"], F.lit("")), detect_language(c["snippet"]))).alias("language"), c["context"].alias("context")),
    )
    return found.withColumn(into, F.col(into).withField("code_blocks", coded))
