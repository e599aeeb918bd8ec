"""Sources: payload files, stored pages, repositories on disk, sitemaps, and a crawl over a table of pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions import html, urls


def payload(spark: SparkSession, glob: str) -> DataFrame:
    """Documents of JSON payload files, one row each."""
    schema = "documents array<struct<url:string,title:string,content:string,code_blocks:array<struct<snippet:string,language:string,context:string,line_number:int>>,topics:array<struct<topic:string,heading:string,level:int,content:string>>>>"
    return spark.read.schema(schema).json(glob, multiLine=True).select(F.explode("documents").alias("d")).select("d.*")


def import_new(docs: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming documents with url and content whose url isn't stored."""
    return incoming.filter((F.trim("url") != "") & (F.trim("content") != "")).join(docs.select("url"), "url", "left_anti")


def repository_files(spark: SparkSession, folder: str, repo: str, most_bytes: int = 64_000) -> DataFrame:
    """Files of a folder as (repo, path, content), each cut at `most_bytes`."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = F.regexp_replace(F.col("path"), "^.*?" + folder.rstrip("/").split("/")[-1] + "/", "")
    return found.select(F.lit(repo).alias("repo"), path.alias("path"), F.decode(F.substring("content", 1, most_bytes), "UTF-8").alias("content"))


def sitemap_urls(maps: DataFrame, docs: DataFrame, most: int = 10) -> DataFrame:
    """A sitemap's pages of its own domain that aren't stored, `most` for each domain in order of the address."""
    found = maps.select(urls.domain(F.col("url")).alias("domain"), F.explode(F.regexp_extract_all("xml", F.lit(r"<loc>(https?://[^<]+)</loc>"), F.lit(1))).alias("url")).distinct()
    own = found.filter(urls.domain(F.col("url")) == F.col("domain")).join(docs.select("url"), "url", "left_anti")
    return own.withColumn("_n", F.row_number().over(Window.partitionBy("domain").orderBy("url"))).filter(F.col("_n") <= most).drop("_n")


def link_graph(pages: DataFrame) -> DataFrame:
    """(src, dst) from the links of pages, resolved and without fragments."""
    found = pages.select(F.col("url").alias("src"), F.explode(html.hrefs(F.col("html"))).alias("_l"))
    return found.select(urls.strip_fragment(F.col("src")).alias("src"), urls.strip_fragment(html.resolve(F.col("src"), F.col("_l"))).alias("dst")).distinct()


def crawl(edges: DataFrame, seeds: DataFrame, *, score: Callable[[Column], Column] | None = None, max_depth: int = 2, max_pages: int = 20, per_host: int = 3, checkpoint: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Rounds from the seeds over a link graph: (url, depth, score).

    A round joins the frontier to the edges, leaves out what was seen, and keeps the best by score: `max_pages` in all, and
    `per_host` of each host other than the seeds'. `checkpoint` writes a round's result so that plans stay short.
    """
    value = score or (lambda u: F.lit(50))
    hosts = seeds.select(urls.host(F.col("url")).alias("h")).distinct().withColumn("_own", F.lit(True))
    seen = checkpoint(seeds.select(urls.strip_fragment(F.col("url")).alias("url"), F.lit(0).alias("depth"), F.lit(100).alias("score")).distinct(), "seen-0")
    frontier = seen
    for depth in range(1, max_depth + 1):
        found = edges.join(frontier.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).distinct().join(seen.select("url"), "url", "left_anti")
        scored = found.withColumn("depth", F.lit(depth)).withColumn("score", value(F.col("url"))).withColumn("h", urls.host(F.col("url"))).filter("score > 0").join(hosts, "h", "left")
        foreign = F.row_number().over(Window.partitionBy("h").orderBy(F.desc("score"), F.asc("url")))
        fair = scored.withColumn("_n", foreign).filter(F.col("_own").isNotNull() | (F.col("_n") <= per_host))
        frontier = checkpoint(fair.orderBy(F.desc("score"), F.asc("url")).limit(max_pages).select("url", "depth", "score"), f"round-{depth}")
        seen = seen.unionByName(frontier)
    return seen.orderBy("depth", F.desc("score"), "url").limit(max_pages)


def url_variants(url: Column) -> Column:
    """A2: a URL as written, without and with a final slash, and under the other scheme."""
    bare = F.regexp_replace(url, r"/+\z", "")
    other = F.when(url.startswith("https://"), F.concat(F.lit("http://"), url.substr(F.lit(9), F.length(url)))).otherwise(F.regexp_replace(url, "^http://", "https://"))
    return F.array(url, bare, F.concat(bare, F.lit("/")), other)


def lookup(docs: DataFrame, wanted: DataFrame, *, key: str = "page_id") -> DataFrame:
    """A1-A4: the stored document of each wanted URL, by its first variant that is stored; of documents under one URL that with the least `key`.

    A variant's place is that in the whole list, also where it is the same as one before it.
    """
    rest = [c for c in docs.columns if c not in ("url", key)]
    stored = docs.filter(F.col("url").isNotNull()).groupBy("url").agg(F.min_by(F.struct(key, *rest), F.struct(F.col(key).isNull(), key, *rest)).alias("_d"))
    tried = wanted.select("query_id", F.posexplode(url_variants(F.col("url"))).alias("pos", "url")).groupBy("query_id", "url").agg(F.min("pos").alias("pos"))
    hit = tried.join(stored, "url").select("query_id", "url", "pos", "_d.*")
    return hit.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("pos", F.asc_nulls_last(key), "url"))).filter("_n = 1").drop("_n", "pos").select("url", "query_id", key, *rest)


def search_links(results: DataFrame, most: int = 8) -> DataFrame:
    """Result links of a search page, without those of junk domains."""
    from tesserae.functions import fixed

    own = F.filter(html.hrefs(F.col("html")), lambda u: u.startswith("http") & ~urls.any_of(urls.domain(u), fixed.JUNK_SEARCH_DOMAINS))
    return results.withColumn("links", F.slice(own, 1, most))
