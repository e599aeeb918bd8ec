"""The document store as functional merges: an operation takes tables and returns the new ones; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions import quality, urls

DOCS = "id long, url string, title string, content string, domain string, language string, scraped_at timestamp, metadata string, score double"
CODE_BLOCKS = "id long, doc_id long, snippet string, language string, context string, line_number int"
TOPICS = "id long, doc_id long, topic string, heading string, level int, content string"
QUERY_SOURCES = "query string, url string, success_count long, failure_count long"
JOBS = "query string, status string, updated_at timestamp, created_at timestamp"
EMBEDDINGS = "doc_id long, vector array<float>, model string, created_at timestamp"


def empty_store(spark: SparkSession) -> dict[str, DataFrame]:
    """Empty tables."""
    return {n: spark.createDataFrame([], s) for n, s in {"docs": DOCS, "code_blocks": CODE_BLOCKS, "doc_topics": TOPICS, "query_source_map": QUERY_SOURCES, "scrape_jobs": JOBS, "doc_embeddings": EMBEDDINGS}.items()}


def merge(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*existing.columns))


def insert_new(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """B2: new rows only where the key is new."""
    return existing.unionByName(new.join(existing.select(*keys), keys, "left_anti").select(*existing.columns))


def distinct_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def without_prefix_copies(docs: DataFrame, *, text: str = "content", chars: int = 500, order: str = "id") -> DataFrame:
    """Of documents whose first `chars` characters are equal, the one that came first.

    Rows are told apart by a hash of the prefix and the least order in it, an aggregate, so that a prefix which many
    documents share makes no hot task.
    """
    prefix = F.sha2(F.substring(F.lower(F.trim(F.col(text))), 1, chars).cast("binary"), 256)
    first = docs.groupBy(prefix.alias("_p")).agg(F.min(order).alias(order))
    return docs.join(first.select(order), order, "left_semi")


def save(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """B1: gate, drop copies of other documents by their prefix, merge by url.

    incoming: id, url, title, content, has_code, scraped_at. A later row of the same url wins.
    """
    gated = incoming.filter(quality.worth_saving(F.col("content"), F.col("has_code"))).withColumn("content", F.lower(F.trim("content"))).withColumn("domain", urls.domain(F.col("url")))
    latest = distinct_first(gated, ["url"], [F.desc("scraped_at"), F.desc("id")])
    unique = without_prefix_copies(latest)
    seen = existing.select(F.sha2(F.substring("content", 1, 500).cast("binary"), 256).alias("_p"), F.col("url").alias("_url"))
    copies = unique.join(seen, (F.sha2(F.substring("content", 1, 500).cast("binary"), 256) == F.col("_p")) & (F.col("url") != F.col("_url")), "left_anti")
    return merge(existing, copies.select(*existing.columns), ["url"])


def delete(docs: DataFrame, children: list[DataFrame], gone: Column) -> tuple[DataFrame, list[DataFrame]]:
    """Documents without those for which `gone` holds, and children without theirs."""
    dead = docs.filter(F.coalesce(gone, F.lit(False))).select(F.col("id").alias("doc_id"))
    return docs.filter(~F.coalesce(gone, F.lit(False))), [c.join(dead, "doc_id", "left_anti") for c in children]


def older_than(now: Column, days: int, at: str = "scraped_at") -> Column:
    """B7, B10, N2."""
    return F.col(at) < now - F.make_dt_interval(F.lit(days))


def of_domain(name: str) -> Column:
    """B8."""
    return (F.col("domain") == name) | F.contains(F.lower("url"), F.lit(name.lower()))


def migrate(docs: DataFrame, children: DataFrame) -> DataFrame:
    """Children by url become children by document id."""
    return children.join(docs.select("url", F.col("id").alias("doc_id")), "url").drop("url")


def jobs(log: DataFrame) -> DataFrame:
    """The state of each query's job from its log (query, status, at)."""
    return log.groupBy("query").agg(F.max_by("status", "at").alias("status"), F.max("at").alias("updated_at"), F.min("at").alias("created_at"))


def domains(docs: DataFrame) -> DataFrame:
    """G1."""
    return docs.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("domain"))


def stats(docs: DataFrame, code: DataFrame) -> DataFrame:
    """One row."""
    a = docs.agg(F.count(F.lit(1)).alias("total_docs"), F.countDistinct("domain").alias("domains"), F.max("scraped_at").alias("last_indexed"), F.floor(F.avg(F.length("content"))).cast("long").alias("avg_length"))
    return a.join(F.broadcast(code.agg(F.count(F.lit(1)).alias("total_code_blocks"))))


def export_json(docs: DataFrame, limit: int = 50) -> DataFrame:
    """The newest documents as JSON lines."""
    return docs.orderBy(F.desc("scraped_at"), F.desc("id")).limit(limit).select(F.to_json(F.struct(*docs.columns)).alias("json"))


def combined(pages: DataFrame, *, at_most: int = 5, chars: int = 3000) -> DataFrame:
    """For each domain with several pages, the beginnings of its first pages as one document."""
    numbered = pages.withColumn("_n", F.row_number().over(Window.partitionBy("domain").orderBy("id")))
    some = numbered.filter(F.col("_n") <= at_most).groupBy("domain").agg(F.sort_array(F.collect_list(F.struct("_n", F.substring("content", 1, chars).alias("c")))).alias("parts"))
    return some.filter(F.size("parts") > 1).select("domain", F.concat(F.lit("https://"), "domain", F.lit("/#combined")).alias("url"), F.array_join(F.transform("parts", lambda p: p["c"]), "\n\n").alias("content"))


def children_of(docs: DataFrame, children: DataFrame, asked: DataFrame, limit: int | None = None) -> DataFrame:
    """The children (doc_id, id, ...) of the documents with the asked urls, in id order; at most `limit` of each."""
    found = children.join(docs.select(F.col("id").alias("doc_id"), "url").join(asked.select("url").distinct(), "url"), "doc_id")
    if limit is None:
        return found.orderBy("url", "id")
    return found.withColumn("_n", F.row_number().over(Window.partitionBy("url").orderBy("id"))).filter(F.col("_n") <= limit).drop("_n").orderBy("url", "id")


def prune(docs: DataFrame, children: list[DataFrame], now: Column, *, days: int | None = None, domain: str | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """Delete by age if an age is given, else by domain."""
    if days is not None:
        return delete(docs, children, older_than(now, days))
    if domain:
        return delete(docs, children, of_domain(domain))
    raise ValueError("an age or a domain is needed")


def in_order(docs: DataFrame, ranked: DataFrame, key: str = "doc_id") -> DataFrame:
    """H5: the documents of a ranked list of ids, in the order of its ranks; ids without a document give no row."""
    return docs.join(ranked.select(key, "rank"), key).orderBy("rank", key)


def alive(status: Column) -> Column:
    """Whether a url that answered with a status is alive; one without an answer isn't."""
    return F.coalesce(status.between(200, 399), F.lit(False))


def cache_get(cache: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """The entries (key, value, expires_at) of the asked keys that haven't expired."""
    return cache.filter(F.col("expires_at") > now).join(keys.select("key").distinct(), "key", "left_semi")


def cache_put(cache: DataFrame, new: DataFrame, now: Column, most: int) -> DataFrame:
    """New entries replace old ones; expired ones go, and where more than `most` are left, those that expire first."""
    live = merge(cache, new, ["key"]).filter(F.col("expires_at") > now)
    return live.orderBy(F.desc("expires_at"), F.asc("key")).limit(most)
