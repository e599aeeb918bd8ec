"""Answer assembly: ranking, diversity, sections and rendering of search results."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import fixed, likeness, text, urls
from tesserae.session import bounded_batches

QUOTAS = {"docs": 2, "github": 2, "community": 1}


def variants(queries: DataFrame) -> DataFrame:
    """A row for each variant of each query, in order."""
    return queries.select("query_id", F.posexplode(text.expansions(F.col("query"))).alias("variant_pos", "query"))


def first_per_url(results: DataFrame) -> DataFrame:
    """Of each query's results for a url, the first by variant and rank."""
    w = Window.partitionBy("query_id", "url").orderBy("variant_pos", "rank")
    return results.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def diversify(results: DataFrame, order: list[Column]) -> DataFrame:
    """At most two documentation, two code-host and one community result for each query."""
    kind = urls.source_type(F.col("url"))
    quota = F.create_map(*(F.lit(x) for kv in QUOTAS.items() for x in kv))
    bucketed = results.withColumn("source_type", kind)
    ranked = bucketed.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "source_type").orderBy(*order)))
    return ranked.filter(F.col("_n") <= quota[F.col("source_type")]).drop("_n")


def section(snippet: Column, intent: Column) -> Column:
    """The section of a snippet under an intent, null if it has none."""
    low = F.lower(F.trim(snippet))
    has = lambda *words: low.rlike("|".join(words))
    code = snippet.contains("def ") | snippet.contains("import ")
    return (
        F.when(intent == "debug", F.when(has("error", "exception", "traceback"), "ERROR").when(has("because", "due to", "cause", "reason"), "CAUSE").otherwise("SOLUTION"))
        .when(intent == "reference", F.when(low.contains("(") & low.contains(")"), "SIGNATURE").when(has("param", "argument"), "PARAMETERS").when(has("example") | code, "EXAMPLES"))
        .when(intent == "concept", F.when(has("is", "defined"), "DEFINITION").when(has("because", "allow", "enable", "why"), "WHY USE").otherwise("WHEN TO USE"))
        .otherwise(F.when(code | snippet.contains("("), "EXAMPLES").when(has("step", "first", "then", "next", "finally"), "STEPS").otherwise("CONCEPT"))
    )


#: Sections of each intent in the order in which they are shown, with how many snippets each takes.
LAYOUT = {
    "debug": [("ERROR", 1), ("CAUSE", 1), ("SOLUTION", 2)],
    "reference": [("SIGNATURE", 1), ("PARAMETERS", 1), ("EXAMPLES", 2)],
    "concept": [("DEFINITION", 1), ("WHY USE", 1), ("WHEN TO USE", 1)],
    "tutorial": [("CONCEPT", 2), ("STEPS", 2), ("EXAMPLES", 2)],
    "general": [("CONCEPT", 2), ("STEPS", 2), ("EXAMPLES", 2)],
}


def render(results: DataFrame, queries: DataFrame) -> DataFrame:
    """One text for each query: its sections in order, `N/A` where one is empty."""
    labelled = results.join(queries.select("query_id", text.intent(F.col("query")).alias("intent")), "query_id").withColumn("section", section(F.col("snippet"), F.col("intent")))
    ranked = labelled.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "section").orderBy("rank"))).filter(F.col("_n") <= 2)
    held = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("section", "_n", F.trim("snippet").alias("s")))).alias("found"))
    base = queries.select("query_id", text.intent(F.col("query")).alias("intent")).join(held, "query_id", "left")

    def part(name: str, most: int) -> Column:
        body = F.array_join(F.transform(F.filter("found", lambda x: (x["section"] == name) & (x["_n"] <= most)), lambda x: x["s"]), "\n")
        return F.concat(F.lit(f"[{name}]\n"), F.coalesce(F.nullif(body, F.lit("")), F.lit("Check documentation" if name == "SOLUTION" else "N/A")))

    chain = F.when(F.lit(False), F.lit(""))
    for intent, sections in LAYOUT.items():
        chain = chain.when(F.col("intent") == intent, F.concat_ws("\n\n", *(part(*x) for x in sections)))
    return base.select("query_id", "intent", F.when(F.col("found").isNull(), "No context available").otherwise(chain).alias("context"))


def boost(url: Column, score: Column) -> Column:
    """E39."""
    docs = urls.any_of(url, ["docs.", "/docs", "/learn", "/reference"])
    return F.round(score + F.when(docs, 2.0).when(url.contains("github.com"), 0.5).otherwise(0.0) + F.when(url.contains("#combined"), 1.0).otherwise(0.0), 4)


def priority(url: Column, title: Column, query: Column) -> Column:
    """E36."""
    return F.when(urls.any_of(F.lower(url), fixed.PRIORITY_DOMAINS), 5).otherwise(0) + F.when(F.contains(F.lower(title), F.lower(query)), 2).otherwise(0)


def relevance_label(rank: Column) -> Column:
    """By position from 1."""
    return F.when(rank == 1, "HIGH").when(rank <= 3, "MEDIUM").otherwise("LOW")


def summary(results: DataFrame, length: str = "medium") -> DataFrame:
    """Each query's snippets in order, cut to 200, 500 or 1000 characters."""
    most = {"short": 200, "medium": 500, "long": 1000}.get(length, 500)
    parts = results.filter(F.trim("snippet") != "").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.substring("snippet", 1, most).alias("s")))).alias("p"))
    return parts.select("query_id", F.substring(F.array_join(F.transform("p", lambda x: x["s"]), " "), 1, most).alias("summary"))


def sites_for(queries: DataFrame, mapping: dict[str, str], most: int | None = None) -> DataFrame:
    """Documentation sites whose keyword stands in a query, in the mapping's order.

    The mapping is a fixed list, so each query is tested against it in its own row.
    """
    pairs = F.array(*(F.struct(F.lit(k).alias("keyword"), F.lit(v).alias("url")) for k, v in mapping.items()))
    hit = F.filter(pairs, lambda p: F.contains(F.lower("query"), p["keyword"]))
    if most:
        hit = F.slice(hit, 1, most)
    return queries.select("query_id", F.posexplode(hit).alias("pos", "s")).select("query_id", "pos", "s.keyword", "s.url")


def neighbours(rows: DataFrame, group: str, order: str, cut: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(order, other): each row's id and that of the next one of its group.

    Ids alone are dealt to ranges of (group, id) and looked ahead in by one row; only what stands last in its range meets the
    ranges' first rows, so no task holds a group.
    """
    ranges = rows.select(F.col(group).alias("_g"), F.col(order).alias("_id")).repartitionByRange("_g", "_id").sortWithinPartitions("_g", "_id")
    at = F.monotonically_increasing_id()
    held = cut(ranges.withColumn("_part", F.shiftright(at, 33)).withColumn("_at", at), "neighbours")
    within = Window.partitionBy("_part").orderBy("_at")
    ahead = held.select("_g", "_id", "_part", F.lead("_g").over(within).alias("_ng"), F.lead("_id").over(within).alias("_nid"), F.lead(F.lit(True)).over(within).alias("_more"))
    inside = ahead.filter(F.col("_more") & F.col("_g").eqNullSafe(F.col("_ng"))).select(F.col("_id").alias(order), F.col("_nid").alias("other"))
    # One row for each range: its last, and the first of the next range that has rows.
    ends = held.groupBy("_part").agg(F.min_by(F.struct("_g", "_id"), "_at").alias("_first"), F.max_by(F.struct("_g", "_id"), "_at").alias("_last"))
    over = ends.select("_last", F.lead("_first").over(Window.orderBy("_part")).alias("_next")).filter(F.col("_next").isNotNull() & F.col("_last._g").eqNullSafe(F.col("_next._g")))
    return inside.unionByName(over.select(F.col("_last._id").alias(order), F.col("_next._id").alias("other")))


def diff(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs with similarity (percent, two digits), up to ten added and removed lines, and `changed`: these as pairs of a removed and an added line."""
    from pyspark.sql import types as T

    bounded_batches(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x, y in zip(batch.column(a).to_pylist(), batch.column(b).to_pylist(), strict=True):
                x, y = x or "", y or ""
                lines = list(difflib.unified_diff(x.split("\n"), y.split("\n"), lineterm="", n=0))[2:]
                added = [t[1:] for t in lines if t.startswith("+")][:10]
                removed = [t[1:] for t in lines if t.startswith("-")][:10]
                rows.append((round(100 * likeness.ratio(x, y), 2), added, removed))
            s, p, m = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array(p, pa.list_(pa.string())), pa.array(m, pa.list_(pa.string()))], names=[*batch.schema.names, "similarity", "added", "removed"])

    more = T.StructType.fromDDL("similarity double, added array<string>, removed array<string>")
    found = pairs.mapInArrow(run, T.StructType([*pairs.schema.fields, *more.fields]))
    most = F.least(F.size("added"), F.size("removed"))
    return found.withColumn("changed", F.zip_with(F.slice("removed", F.lit(1), most), F.slice("added", F.lit(1), most), lambda x, y: F.struct(x.alias("before"), y.alias("after"))))


def early_exit(results: DataFrame, most: int = 5) -> DataFrame:
    """The results of each query's first variant that has any."""
    first = F.min("variant_pos").over(Window.partitionBy("query_id"))
    return results.withColumn("_first", first).filter((F.col("variant_pos") == F.col("_first")) & (F.col("rank") <= most)).drop("_first")


def cascade(tiers: list[DataFrame]) -> DataFrame:
    """Of several result tables of the same columns, each query's rows from the first that has any."""
    every = None
    for k, tier in enumerate(tiers):
        tagged = tier.withColumn("tier", F.lit(k + 1))
        every = tagged if every is None else every.unionByName(tagged)
    return every.withColumn("_best", F.min("tier").over(Window.partitionBy("query_id"))).filter(F.col("tier") == F.col("_best")).drop("_best")


def prompt(queries: DataFrame, docs: DataFrame, code: DataFrame, *, most_docs: int = 3, most_code: int = 3) -> DataFrame:
    """For each query one text of its best documents (query_id, rank, title, snippet) and code (query_id, rank, language, snippet)."""
    part = lambda df, most, line: df.filter(F.col("rank") <= most).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("t")))).alias("p")).select("query_id", F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("t"))
    d = part(docs, most_docs, F.concat(F.lit("### "), "title", F.lit("\n"), "snippet")).withColumnRenamed("t", "d")
    c = part(code, most_code, F.concat(F.lit("```"), "language", F.lit("\n"), "snippet", F.lit("\n```"))).withColumnRenamed("t", "c")
    both = queries.join(d, "query_id", "left").join(c, "query_id", "left")
    return both.select("query_id", F.concat(F.lit("# "), "query", F.lit("\n\n"), F.coalesce("d", F.lit("No documents.")), F.lit("\n\n"), F.coalesce("c", F.lit("No code."))).alias("prompt"))


def with_status(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, query, count, status) of each query: `success` where there are hits, else `learning`, which the miss log and the ingest take up."""
    n = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("count"))
    found = queries.select("query_id", "query").join(n, "query_id", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return found.withColumn("status", F.when(F.col("count") > 0, "success").otherwise("learning"))


def answer(queries: DataFrame, lexical: DataFrame, semantic: DataFrame, *, most: int = 3) -> DataFrame:
    """For each query its intent, a confidence, and the best `most` of lexical results followed by unseen semantic ones, boosted by their urls.

    lexical, semantic: query_id, doc_id, url, score. Queries without a result give one row without a document.
    """
    from tesserae.operators.search import hybrid, top

    merged = hybrid(lexical.select("query_id", "doc_id", "url", "score"), semantic.select("query_id", "doc_id", "url", "score"))
    best = top(merged.withColumn("score", boost(F.col("url"), F.col("score"))), most, [F.desc("score"), F.asc("source"), F.asc("doc_id")]).drop("source")
    asked = queries.select("query_id", text.intent(F.col("query")).alias("intent"))
    return asked.join(best, "query_id", "left").withColumn("confidence", F.when(F.col("doc_id").isNotNull(), 0.95).otherwise(0.3))


def code_examples(results: DataFrame, code: DataFrame, most: int = 2) -> DataFrame:
    """Of each query's documents the first code block, of distinct languages, `most` in order of rank."""
    j = results.select("query_id", "doc_id", "rank").join(code, "doc_id")
    per_doc = j.withColumn("_a", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("code_id"))).filter("_a = 1")
    per_language = per_doc.withColumn("_b", F.row_number().over(Window.partitionBy("query_id", "language").orderBy("rank", "code_id"))).filter("_b = 1")
    return per_language.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "code_id"))).filter(F.col("n") <= most).drop("_a", "_b")
