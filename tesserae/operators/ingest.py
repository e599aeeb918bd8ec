"""The chain from fetched pages to stored documents: routes, parsers by page type, gates, and what became of each page.

One narrow pass over (url, html, ...) tags every page with a route, a status and a reason; no page is lost on the way:

    kept      content and code blocks, which the merge takes
    cached    the document is stored already, and the page isn't parsed
    skipped   with the reason: an unsafe address, nothing fetched, a repository (which has a source of its own), no content, or an
              error page

Null and empty pages are skipped; of several pages with one url each is judged by itself, and the merge takes the latest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import fixed, html, quality, urls

#: Characters of content by route, of fallback texts, and of code blocks.
MOST, MOST_THIN, MOST_CODE = 100_000, 50_000, 5_000
#: Contents below the first are taken from the whole page, those below the second from its source.
THIN, TINY = 200, 20

CODE = "array<struct<snippet:string,language:string,context:string>>"


def let(value: Column, f) -> Column:
    """f of a value that is made once however often f uses it. What stands in f isn't part of the generated code, which so many expressions would be too long for."""
    return F.element_at(F.transform(F.array(value), f), 1)


def visible(page: Column, without: list[str] | None = None) -> Column:
    """The text between tags, without scripts, styles, comments and the elements named, in single spaces."""
    for name in ["script", "style", *(without or [])]:
        page = F.regexp_replace(page, rf"(?is)<{name}\b.*?</{name}>", " ")
    page = F.regexp_replace(F.regexp_replace(page, r"(?s)<!--.*?-->", " "), "<[^>]*>", " ")
    return F.trim(F.regexp_replace(html.unescape(page), r"\s+", " "))


def element(page: Column, opening: str, name: str) -> Column:
    """The inside of the first element that the pattern opens, to the end tag that closes it; null where there is none."""
    rest = F.regexp_substr(page, F.lit(rf"(?is){opening}.*"))
    pieces = F.split(F.regexp_replace(rest, rf"^(?is){opening}", ""), rf"(?i)(?=</?{name}\b)")
    # How many pieces stand before the end tag at which as many have closed as opened.
    start = F.struct(F.lit(1).alias("open"), F.lit(0).alias("n"))

    def step(a: Column, piece: Column) -> Column:
        low = F.lower(F.substring(piece, 1, len(name) + 2))
        now = a["open"] + F.when(low.startswith(f"</{name}"), -1).when(low.startswith(f"<{name}"), 1).otherwise(0)
        return F.when(a["open"] == 0, a).otherwise(F.struct(now.alias("open"), (a["n"] + (now > 0).cast("int")).alias("n")))

    found = F.aggregate(pieces, start, step)
    return F.array_join(F.slice(pieces, 1, found["n"]), "")


FURNITURE = ["nav", "footer", "header"]


def code_blocks(page: Column, most: int = 5) -> Column:
    """The first `most` code elements of more than ten characters; those inside a pre count with it alone."""
    found = F.regexp_extract_all(page, F.lit(r"(?is)<(pre|code)\b[^>]*>(.*?)</\1>"), F.lit(2))
    plain = F.transform(found, lambda x: html.unescape(F.regexp_replace(x, "<[^>]*>", "")))
    blocks = F.transform(F.filter(plain, lambda x: F.length(x) > 10), lambda x: F.struct(F.substring(x, 1, MOST_CODE).alias("snippet"), F.lit("").alias("language"), F.lit("").alias("context")))
    return F.slice(blocks, 1, most)


def _one_block(page: Column, language: str | Column, context: str) -> Column:
    language = F.lit(language) if isinstance(language, str) else language
    return F.array(F.struct(F.substring(page, 1, MOST_THIN).alias("snippet"), language.alias("language"), F.lit(context).alias("context")))


def raw_kind(url: Column) -> Column:
    """The kind of a configuration file that is taken as it is, null for other addresses."""
    low = F.lower(url)
    ends = lambda *tails: low.rlike("(" + "|".join(t.replace(".", r"\.") for t in tails) + ")$")
    kind = F.when(ends(".xml"), "xml").when(ends(".json"), "json").when(ends(".yaml", ".yml"), "yaml").when(ends(".toml", ".properties"), "toml")
    return kind.when(ends(*fixed.RAW_EXTENSIONS), "config")


def _content(page_type: Column, page: Column) -> Column:
    """The text that a page type's parser gives."""
    inside = html.article(page)
    wikipedia = element(page, r"""<div\b[^>]*\bid=["']?mw-content-text["']?[^>]*>""", "div")
    return (
        F.when(page_type.isin("github", "config"), F.substring(page, 1, MOST))
        .when(page_type == "wikipedia", F.substring(visible(F.coalesce(wikipedia, page)), 1, MOST))
        .when(page_type == "docs", F.substring(visible(page, FURNITURE), 1, MOST))
        .when(page_type == "article", F.substring(visible(inside, FURNITURE), 1, MOST))
        .when(page_type == "thin", F.substring(visible(page), 1, MOST_THIN))
        .otherwise(html.text(page))
    )


def routed(pages: DataFrame) -> DataFrame:
    """Pages with `address` (where the file itself is), `route` and, where they go no further, `reason`. A23: content types that aren't text are skipped."""
    kind = F.lower(F.col("content_type")) if "content_type" in pages.columns else F.lit(None).cast("string")
    named = pages.withColumn("address", urls.raw_file(F.col("url"))).withColumn("raw", raw_kind(F.col("address"))).withColumn("_kind", kind)
    plain = F.coalesce(F.col("_kind").rlike("application/json|application/xml|text/xml|text/plain") | F.lower("address").rlike(r"\.(xml|json|txt|py|js|sh)$"), F.lower("address").rlike(r"\.(xml|json|txt|py|js|sh)$"), F.lit(False))

    def route(x: Column) -> Column:
        found = (
            F.when(x["raw"].isNotNull(), "raw file")
            .when(x["address"].rlike(r"^https?://[^/]*github\.com/[^/]+/[^/]+$"), "repository")
            .when(x["plain"], "plain text")
            .otherwise(html.page_type(F.coalesce(x["address"], F.lit("")), x["html"]))
        )
        return F.coalesce(found, F.lit("thin"))

    verdict = F.coalesce(let(F.coalesce("address", F.lit("")), lambda u: urls.safety(u)), F.lit("scheme"))
    reason = (
        F.when(F.col("_verdict") != "ok", F.concat(F.lit("unsafe: "), "_verdict"))
        .when(F.col("html").isNull(), "not fetched")
        .when(F.col("html") == "", "timeout")
        .when(F.col("route") == "repository", "repository")
        .when(F.col("_kind").isNotNull() & ~F.col("_plain") & ~F.col("_kind").contains("text/html") & F.col("raw").isNull(), "content type")
    )
    tagged = named.withColumn("_plain", plain).withColumn("_verdict", verdict)
    tagged = tagged.withColumn("route", let(F.struct("raw", "address", F.col("_plain").alias("plain"), "html"), route))
    return tagged.withColumn("reason", reason).drop("_kind", "_plain", "_verdict")


def parsed(pages: DataFrame) -> DataFrame:
    """Routed pages with title, content and code blocks; what has a reason already isn't parsed."""
    as_is = ("raw file", "plain text")

    def content(x: Column) -> Column:
        page, route = x["html"], x["route"]
        raw = F.when(route == "raw file", F.substring(page, 1, MOST_THIN)).when(route == "plain text", F.substring(page, 1, 5000))
        full = lambda c: F.when(route.isin(*as_is) | (F.length(c) >= THIN), c).otherwise(F.substring(visible(page), 1, MOST_THIN))
        some = lambda c: F.when(F.length(F.trim(c)) >= TINY, F.trim(c)).otherwise(F.trim(F.substring(page, 1, MOST_THIN)))
        return let(let(F.coalesce(raw, _content(route, page)), full), some)

    def blocks(x: Column) -> Column:
        page, route = x["html"], x["route"]
        return (
            F.when(route == "raw file", _one_block(page, x["raw"], "configuration file"))
            .when(route == "github", _one_block(page, "code", "github file"))
            .when(route == "config", _one_block(page, "config", "configuration file"))
            .when(route == "docs", code_blocks(page))
            .otherwise(F.array().cast(CODE))
        )

    title = lambda x: F.when(x["route"].isin(*as_is), F.regexp_extract(x["address"], "[^/]*$", 0)).otherwise(html.title(x["html"]))
    given = F.struct("html", "route", "raw", "address")
    read = lambda f: F.when(F.col("reason").isNull(), let(given, f))
    return pages.withColumn("content", read(content)).withColumn("code_blocks", F.coalesce(read(blocks), F.array().cast(CODE))).withColumn("title", read(title))


def ingest(pages: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Url, address, route, status, reason, title, content, code_blocks and the pages' other columns.

    stored: the urls that are there already; they meet the pages in a join on the url, before anything is parsed.
    """
    known = routed(pages)
    if stored is not None:
        there = stored.select(F.col("url").alias("_url")).distinct().withColumn("_there", F.lit(True))
        met = known.join(there, F.col("url") == F.col("_url"), "left")
        known = met.withColumn("reason", F.when(F.col("reason").isNull() & F.col("_there"), "cached").otherwise(F.col("reason"))).drop("_url", "_there")
    read = parsed(known)
    raw = F.col("route").isin("raw file", "plain text")
    gate = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.coalesce(F.col("content"), F.lit("")) == "", "no content").when(~raw & ~quality.useful_a(F.col("content")), "low quality")
    judged = read.withColumn("reason", gate)
    status = F.when(F.col("reason").isNull(), "kept").when(F.col("reason") == "cached", "cached").otherwise("skipped")
    kept = lambda c: F.when(F.col("reason").isNull(), F.col(c))
    return judged.withColumn("status", status).withColumn("content", kept("content")).withColumn("title", kept("title")).withColumn("code_blocks", F.coalesce(kept("code_blocks"), F.array().cast(CODE))).drop("raw", "html")


def missing(seeds: DataFrame, stored: DataFrame) -> DataFrame:
    """The seeds (url, ...) that aren't stored yet in any way of writing the same address: with or without a final slash, http or https."""
    form = lambda url: F.regexp_replace(F.regexp_replace(urls.strip_fragment(F.col(url)), "^https?://", ""), "/+$", "")
    there = stored.select(form("url").alias("_form")).distinct()
    return seeds.withColumn("_form", form("url")).join(there, "_form", "left_anti").drop("_form").dropDuplicates(["url"])


def summary(judged: DataFrame) -> DataFrame:
    """One row of counts."""
    of = lambda s: F.count_if(F.col("status") == s)
    return judged.agg(F.count(F.lit(1)).alias("total"), (of("kept") + of("cached")).alias("successful"), of("cached").alias("cached"), of("kept").alias("fresh"), of("skipped").alias("skipped"))


def reasons(judged: DataFrame) -> DataFrame:
    """How many pages of each route ended how, and why."""
    return judged.groupBy("route", "status", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
