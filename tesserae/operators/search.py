"""Full-text, fuzzy and vector search as joins and aggregates over index tables.

Full text runs on the stored index of stems (`inverted`), substrings on that of trigrams (`substring`), fuzzy search on one of whole
words: postings (doc_id, term, tf), doc_stats (doc_id, dl) and term_stats (term, df). Queries are rows too, so one plan
answers a batch of them. The query side of a join is small by its nature (terms of the queries); Spark broadcasts it when
its measured size allows.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions import text as tx
from tesserae.operators import inverted, substring
from tesserae.operators.inverted import Stored
from tesserae.session import bounded_batches

#: Edits that a fuzzy match may have.
EDITS = 2

# A stop list for TF-IDF, fixed values.
STOP_WORDS = (
    "a", "about", "above", "after", "again", "against", "all", "also", "am", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before",
    "being", "below", "between", "both", "but", "by", "can", "could", "did", "do", "does", "doing", "down", "during", "each", "few", "for", "from",
    "further", "had", "has", "have", "having", "he", "her", "here", "hers", "him", "his", "how", "i", "if", "in", "into", "is", "it", "its", "itself",
    "just", "me", "more", "most", "my", "no", "nor", "not", "now", "of", "off", "on", "once", "only", "or", "other", "our", "ours", "out", "over",
    "own", "same", "she", "should", "so", "some", "such", "than", "that", "the", "their", "theirs", "them", "then", "there", "these", "they", "this",
    "those", "through", "to", "too", "under", "until", "up", "very", "was", "we", "were", "what", "when", "where", "which", "while", "who", "whom",
    "why", "will", "with", "would", "you", "your", "yours",
)


def code_version() -> str:
    """A digest of the code that stored words and vectors depend on."""
    return hashlib.sha256(b"".join(Path(f).read_bytes() for f in (__file__, tx.__file__))).hexdigest()[:16]


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    doc_stats: DataFrame
    term_stats: DataFrame


def build_index(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> Index:
    """M7: postings and statistics; one shuffle for postings, partial aggregation before it."""
    words = docs.select(F.col(key).alias("doc_id"), F.explode(tx.tokens(F.col(text))).alias("term"))
    postings = words.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    stats = docs.select(F.col(key).alias("doc_id"), F.size(tx.tokens(F.col(text))).cast("long").alias("dl"))
    return Index(postings, stats, postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")))


def write_index(index: Index, folder: str) -> None:
    """Store an index of words: postings and terms sorted by term. The statistics go last and tell that it is whole."""
    index.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{folder}/postings")
    index.doc_stats.write.mode("overwrite").parquet(f"{folder}/doc_stats")
    postings = index.postings.sparkSession.read.parquet(f"{folder}/postings")
    counted = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    counted.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/term_stats")


def read_index(spark: SparkSession, folder: str) -> Index | None:
    """A stored index, or None where none is whole."""
    try:
        term_stats = spark.read.parquet(f"{folder}/term_stats")
        return Index(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/doc_stats"), term_stats)
    except AnalysisException:
        return None


def query_terms(queries: DataFrame, *, key: str = "query_id", query: str = "query") -> DataFrame:
    """Distinct words of each query, unstemmed."""
    return queries.select(F.col(key).alias("query_id"), F.explode(F.array_distinct(tx.tokens(F.col(query)))).alias("q"))


def top(scored: DataFrame, k: int, order: list[Column], per: str = "query_id") -> DataFrame:
    """The first k of each query, ranked from 1."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(per).orderBy(*order))).filter(F.col("rank") <= k)


def final_score(learned: Column, score: Column, affinity: Column) -> Column:
    """Learned score and a monotone share of the text score; half a point for a source that served the query before."""
    return learned + (-score) / (1 - score) + F.when(affinity > 0, 0.5).otherwise(0.0)


def final_score_verbatim(learned: Column, score: Column, affinity: Column) -> Column:
    """E7 as written: it has a pole at -1 and isn't monotone."""
    return learned + F.try_divide(F.lit(1.0), score + 1) + F.when(affinity > 0, 0.5).otherwise(0.0)


def cascade(queries: DataFrame, tiers: list[Callable[[DataFrame], DataFrame]], cut: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Each query's rows from the first tier that has any for it, with `tier` from 1.

    A tier is asked for the queries that those before it have left over, and not run at all where none are: each tier's rows
    and what is left are written before the next one is planned. Queries that no tier answers give no row.
    """
    found: list[DataFrame] = []
    left = cut(queries, "asked")
    for k, tier in enumerate(tiers, 1):
        found.append(cut(tier(left).withColumn("tier", F.lit(k)), f"tier-{k}"))
        if k < len(tiers):
            left = cut(left.join(found[-1].select("query_id").distinct(), "query_id", "left_anti"), f"left-{k}")
            if left.isEmpty():
                break
    return reduce(DataFrame.unionByName, found)


def tiered(docs: DataFrame, index: Stored, grams: substring.Grams, queries: DataFrame, cut: Callable[[DataFrame, str], DataFrame], *, limit: int = 10, prefix: bool = True) -> DataFrame:
    """Full text, else the whole phrase, else the newest; the first tier with a hit wins.

    docs: doc_id, url, title, content, scraped_at, learned, affinity. Returns query_id, doc_id, tier, rank, final_score.
    """
    bonus = F.when(F.col("affinity") > 0, 0.5).otherwise(0.0)
    best = [F.desc("final_score"), F.asc("doc_id")]

    def full_text(left: DataFrame) -> DataFrame:
        score = final_score(F.col("learned"), F.col("bm25"), F.col("affinity"))
        hits = inverted.bm25(index, left, cut, prefix=prefix).join(docs.select("doc_id", "learned", "affinity"), "doc_id")
        return top(hits.select("query_id", "doc_id", F.round(score, 9).alias("final_score")), limit, best)

    def phrase(left: DataFrame) -> DataFrame:
        hits = substring.containing(docs.select("doc_id", "content", "learned", "affinity"), grams, left, cut)
        return top(hits.select("query_id", "doc_id", (F.col("learned") + bonus).alias("final_score")), limit, best)

    def newest(left: DataFrame) -> DataFrame:
        first = [F.desc("scraped_at"), F.desc("doc_id")]
        rows = docs.orderBy(*first).limit(limit).select("doc_id", "scraped_at")  # `limit` rows
        return top(left.select("query_id").join(F.broadcast(rows)).select("query_id", "doc_id", F.lit(0.0).alias("final_score"), "scraped_at"), limit, first).drop("scraped_at")

    return cascade(queries, [full_text, phrase, newest], cut)


_WORD = re.compile(r"[^\W_]+")


def best_window(hits: list[tuple[int, int]], length: int, words: int) -> int:
    """Where the window of `words` tokens begins that covers most different terms, then most matches, then stands first.

    hits: (position, number of the term) in order. Windows that cover something best begin at a match or end at one or at the
    text's ends; it is enough to look at those that begin at a match. The window is then moved to have its matches in the middle.
    """
    best, inside, right = (0, 0, 0), Counter(), 0
    chosen = (0, 0)
    for left, (begin, term) in enumerate(hits):
        while right < len(hits) and hits[right][0] < begin + words:
            inside[hits[right][1]] += 1
            right += 1
        if (found := (len(inside), right - left, -begin)) > best:
            best, chosen = found, (begin, hits[right - 1][0])
        inside[term] -= 1
        if not inside[term]:
            del inside[term]
    first, last = chosen
    return max(0, min(first - (words - (last - first + 1)) // 2, length - words))


def snippet_of(text: str, stems: list[str], words: int, prefix: bool) -> str:
    tokens = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    known: dict[str, int] = {}

    def term(word: str) -> int:
        if word not in known:
            stem = tx.porter(word)
            known[word] = next((k for k, q in enumerate(stems) if (stem.startswith(q) if prefix else stem == q)), -1)
        return known[word]

    hits = [(k, t) for k, (a, b) in enumerate(tokens) if (t := term(text[a:b].lower())) >= 0]
    if not tokens:
        return ""
    begin = best_window(hits, len(tokens), words)
    end = min(len(tokens), begin + words)
    marked = {k for k, _ in hits}
    out, at = [], tokens[begin][0] if begin else 0
    for k in range(begin, end):
        a, b = tokens[k]
        out += [text[at:a], f"[{text[a:b]}]" if k in marked else text[a:b]]
        at = b
    return "".join([*(["..."] if begin else []), *out, text[at:] if end == len(tokens) else "..."])


def weighted(index: Stored, titles: DataFrame, queries: DataFrame, cut: Callable[[DataFrame, str], DataFrame], *, limit: int = 5, weights: tuple[float, ...] = (5.0, 1.0), bonus: float = 20.0, penalty: float = 0.7, threshold: float = 1.0) -> DataFrame:
    """BM25 with a weight for each field, a bonus where a word of the query stands in the title, and a second pass for thin results.

    Queries that keep fewer than `limit` documents at the threshold or above are asked again word by word, at `penalty` times the
    score; of a document's scores the best counts. titles: doc_id, title. Returns query_id, doc_id, relevance, rank.
    """
    def scored(asked: DataFrame, words: DataFrame, key: str, factor: float) -> DataFrame:
        hits = inverted.bm25(index, asked, cut, weights=list(weights)).withColumnRenamed("query_id", key).join(titles.select("doc_id", F.lower("title").alias("_title")), "doc_id")
        # Words without a character beyond white space aren't there, so an empty one can't match every title.
        named = hits.join(words, key).withColumn("_named", F.exists("words", lambda w: F.contains(F.coalesce(F.col("_title"), F.lit("")), w)))
        rank = (-F.col("bm25") + F.when(F.col("_named"), bonus).otherwise(0.0)) * factor
        return named.select(key, "doc_id", rank.alias("relevance")).filter(F.col("relevance") >= threshold)

    split = F.array_distinct(F.filter(F.split(F.lower("query"), r"\s+"), lambda w: w != ""))
    queries = cut(queries.select("query_id", "query", split.alias("words")), "weighted-queries")
    best = [F.desc(F.round("relevance", 9)), F.asc("doc_id")]
    whole = cut(scored(queries, queries.select("query_id", "words"), "query_id", 1.0), "weighted-whole")
    enough = whole.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= limit)
    thin = queries.filter(F.size("words") > 1).join(enough, "query_id", "left_anti")
    single = cut(thin.select("query_id", F.posexplode("words").alias("_pos", "query")).select(F.struct("query_id", "_pos").alias("single_id"), "query", F.array("query").alias("words")), "weighted-single")
    if single.isEmpty():
        return top(whole, limit, best)
    more = scored(single.select(F.col("single_id").alias("query_id"), "query"), single.select("single_id", "words"), "single_id", penalty)
    every = whole.unionByName(more.select("single_id.query_id", "doc_id", "relevance"))
    return top(every.groupBy("query_id", "doc_id").agg(F.max("relevance").alias("relevance")), limit, best)


def strict(index: Stored, learned: DataFrame, queries: DataFrame, cut: Callable[[DataFrame, str], DataFrame], *, limit: int = 5) -> DataFrame:
    """Documents that have all of a query's words (stemmed, whole), by learned score, then by BM25.

    learned: doc_id and score; documents without one have 1. Returns query_id, doc_id, learned_score, bm25, rank.
    """
    hits = inverted.bm25(index, queries, cut, prefix=False, every=True)
    scored = hits.join(learned.select("doc_id", F.col("score").alias("learned_score")), "doc_id", "left").fillna(1.0, ["learned_score"])
    return top(scored.select("query_id", "doc_id", "learned_score", "bm25"), limit, [F.desc("learned_score"), F.asc(F.round("bm25", 9)), F.asc("doc_id")])


def snippets(hits: DataFrame, terms: DataFrame, *, text: str = "content", words: int = 32, prefix: bool = True) -> DataFrame:
    """Results (query_id, the text, ...) with a `snippet` in place of the text: the best window of tokens, matches in brackets, cut ends marked by dots.

    terms: (query_id, q) the queries' stems, as `inverted.asked` gives them. Meant for the best hits of each query. A text
    without tokens has an empty snippet, one without matches its beginning.
    """
    from pyspark.sql import types as T

    bounded_batches(hits.sparkSession)
    stems = terms.groupBy("query_id").agg(F.sort_array(F.collect_list("q")).alias("_stems"))
    rows = hits.join(stems, "query_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: k for k, n in enumerate(batch.schema.names)}
            found = [snippet_of(x or "", s or [], words, prefix) for x, s in zip(batch.column(at[text]).to_pylist(), batch.column(at["_stems"]).to_pylist(), strict=True)]
            kept = [n for n in at if n not in (text, "_stems")]
            yield pa.RecordBatch.from_arrays([*(batch.column(at[n]) for n in kept), pa.array(found, pa.string())], names=[*kept, "snippet"])

    fields = [f for f in rows.schema.fields if f.name not in (text, "_stems")]
    return rows.mapInArrow(run, T.StructType([*fields, T.StructField("snippet", T.StringType())]))


def fuzzy(index: Index, queries: DataFrame, *, limit: int = 10, cut: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Query terms against the dictionary by edit distance, then documents by their mean similarity.

    EDITS edits leave one of a term's EDITS + 1 parts as it is, at most EDITS places away. So candidates come from an equality
    join of terms' parts, three rows for a term, on what stands near there in a query's words; the distance is then verified.
    With `cut` the near terms are written before postings meet them, so few of them don't make all postings be shuffled.
    """
    asked = query_terms(queries)
    bounds = asked.agg((F.min(F.length("q")) - EDITS).alias("_least"), (F.max(F.length("q")) + EDITS).alias("_most"))
    size = F.length("term")
    terms = index.term_stats.select("term").join(F.broadcast(bounds), size.between(F.col("_least"), F.col("_most")))
    made = terms.select("term", size.alias("length"), F.inline(parts_of(size))).withColumn("letters", F.substring("term", F.col("start") + 1, F.col("size"))).select("term", "length", "part", "letters")
    near = made.join(places(asked), ["length", "part", "letters"]).select("query_id", "q", "term")
    near = near.withColumn("d", F.levenshtein("term", "q", EDITS)).filter(F.col("d") >= 0).distinct()
    like = near.withColumn("similarity", 1 - F.col("d") / F.greatest(F.length("term"), F.length("q")))
    like = cut(like, "like") if cut else like
    best = index.postings.join(like, "term").groupBy("query_id", "doc_id", "q").agg(F.max("similarity").alias("s"))
    size = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    scored = best.groupBy("query_id", "doc_id").agg(F.sum("s").alias("total")).join(size, "query_id").select("query_id", "doc_id", (F.col("total") / F.col("n")).alias("similarity"))
    return top(scored, limit, [F.desc(F.round("similarity", 9)), F.asc("doc_id")])


def parts_of(length: Column) -> Column:
    """The EDITS + 1 parts (part, start, size) of a word of some length; those of short words may be empty."""
    cuts = [F.floor(length * k / (EDITS + 1)).cast("int") for k in range(EDITS + 2)]
    return F.array(*(F.struct(F.lit(k).alias("part"), cuts[k].alias("start"), (cuts[k + 1] - cuts[k]).alias("size")) for k in range(EDITS + 1)))


def places(asked: DataFrame) -> DataFrame:
    """(query_id, q, length, part, letters): what a part of a term of some length is in each query's word, if no edit meets it."""
    m = F.length("q")
    sizes = asked.select("query_id", "q", F.explode(F.sequence(F.greatest(m - EDITS, F.lit(1)), m + EDITS)).alias("length"))
    parts = sizes.select("query_id", "q", "length", F.inline(parts_of(F.col("length"))))
    first, last = F.greatest(F.col("start") - EDITS, F.lit(0)), F.least(F.col("start") + EDITS, m - F.col("size"))
    shifted = parts.filter(first <= last).select("query_id", "q", "length", "part", "size", F.explode(F.sequence(first, last)).alias("at"))
    return shifted.select("query_id", "q", "length", "part", F.substring("q", F.col("at") + 1, F.col("size")).alias("letters")).distinct()


def deletions(word: Column, most: int) -> Column:
    """A word and all that at most `most` deletions make of it."""
    out = F.array(word)
    last = out
    for _ in range(most):
        last = F.array_distinct(F.flatten(F.transform(last, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w)))))))
        out = F.array_union(out, last)
    return out


@dataclass(frozen=True)
class Vectors:
    """TF-IDF vectors of unit length: what is stored of them (doc_id, term, tf, norm), and the terms (term, idf) that they are made of, which have a bound."""

    frequencies: DataFrame
    terms: DataFrame
    sublinear: bool
    bigrams: bool
    stop_words: tuple[str, ...] = STOP_WORDS

    @property
    def weights(self) -> DataFrame:
        """(doc_id, term, weight), made of what is stored when it is read: a norm is one for all rows of a document, a weight isn't."""
        each = self.frequencies.join(F.broadcast(self.terms), "term")
        return each.select("doc_id", "term", (_raw(F.col("tf"), self.sublinear) * F.col("idf") / F.col("norm")).alias("weight"))


def _words(text: Column, stop_words: tuple[str, ...]) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)), lambda w: ~w.isin(*stop_words))


def _with_pairs(words: Column) -> Column:
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))
    return F.concat(words, F.array_compact(pairs))


def grams(text: Column, bigrams: bool = True, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """The words of two letters or more that aren't stop words, and the pairs of those that follow each other."""
    words = _words(text, stop_words)
    return _with_pairs(words) if bigrams else words


def _terms(rows: DataFrame, key: str, text: str, bigrams: bool, stop_words: tuple[str, ...]) -> DataFrame:
    # The words as a column, so that a text is split once and not for each place in which they stand.
    words = rows.select(F.col(key), _words(F.col(text), stop_words).alias("_words"))
    return words.select(F.col(key), F.explode(_with_pairs(F.col("_words")) if bigrams else F.col("_words")).alias("term"))


def _raw(tf: Column, sublinear: bool) -> Column:
    return (1 + F.log(tf)) if sublinear else tf.cast("double")


def _weighed(tf: DataFrame, terms: DataFrame, key: str, sublinear: bool) -> DataFrame:
    """Weights of unit length of a batch of queries."""
    x = tf.join(terms, "term").groupBy(key).agg(F.collect_list(F.struct("term", (_raw(F.col("tf"), sublinear) * F.col("idf")).alias("x"))).alias("t"))
    normed = x.withColumn("norm", F.sqrt(F.aggregate("t", F.lit(0.0), lambda a, t: a + t["x"] * t["x"])))
    return normed.select(key, "norm", F.explode("t").alias("t")).select(key, "t.term", (F.col("t.x") / F.col("norm")).alias("weight"))


#: Counters of hashed terms, and how many stand in a row.
COUNTERS, COUNTERS_ROW = 1 << 20, 1 << 10


@dataclass(frozen=True)
class Grams:
    """The terms of an Arrow batch as numbers: the row of each, its first word and its second one (-1: none) in `words`."""

    words: pa.Array
    row: np.ndarray
    first: np.ndarray
    second: np.ndarray

    def counters(self, n: int) -> np.ndarray:
        """Which of n counters (a power of two) is each term's, the same in all batches."""
        h = pd.util.hash_array(np.append(self.words.to_numpy(zero_copy_only=False), "").astype(object), categorize=False)
        pair = h[self.first] * np.uint64(0x9E3779B97F4A7C15) + h[self.second]
        return (np.where(self.second < 0, h[self.first], pair) >> np.uint64(65 - n.bit_length())).astype(np.int64)

    def only(self, which: np.ndarray) -> Grams:
        return Grams(self.words, self.row[which], self.first[which], self.second[which])

    def numbered(self) -> tuple[pa.Array, np.ndarray]:
        """The different terms, and the number of each one among them."""
        many = len(self.words) + 1
        held, number = np.unique(self.first * many + self.second + 1, return_inverse=True)
        first, second = np.divmod(held, many)
        pair = second > 0
        both = pc.binary_join_element_wise(self.words.take(pa.array(first[pair])), self.words.take(pa.array(second[pair] - 1)), " ")
        at = np.where(pair, np.cumsum(pair) - 1 + len(self.words), first)
        return pa.concat_arrays([self.words, both]).take(pa.array(at)), number


def _each_term(column: pa.Array) -> Grams:
    """Each row as a term."""
    coded = pc.dictionary_encode(column.cast(pa.string()))
    row = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    first = coded.indices.drop_null().to_numpy().astype(np.int64)
    return Grams(coded.dictionary, row, first, np.full(len(first), -1))


def _each_gram(bigrams: bool, stop_words: tuple[str, ...]) -> Callable[[pa.Array], Grams]:
    """What `grams` gives for the texts that `_spaced` makes."""

    def read(column: pa.Array) -> Grams:
        split = pc.split_pattern(column.cast(pa.large_string()), " ")
        row = np.repeat(np.arange(len(column)), np.diff(split.offsets.to_numpy()))
        coded = pc.dictionary_encode(pc.list_flatten(split))
        words, code = coded.dictionary.cast(pa.string()), coded.indices.to_numpy().astype(np.int64)
        ends = pc.equal(words, ROW_END).to_numpy(zero_copy_only=False)
        term = pc.greater(pc.utf8_length(words), 1).to_numpy(zero_copy_only=False) & ~pc.is_in(words, value_set=pa.array(stop_words, pa.string())).to_numpy(zero_copy_only=False)
        kept = (term | ends)[code]
        row, code = row[kept], code[kept]
        single = term[code]
        follows = (row[1:] == row[:-1]) & single[1:] & single[:-1] if bigrams else np.zeros(max(0, len(row) - 1), bool)
        none = np.full(np.count_nonzero(single), -1)
        of = lambda one, two: np.concatenate([one[single], two[follows]])
        return Grams(words, of(row, row[:-1]), of(code, code[:-1]), np.concatenate([none, code[1:][follows]]))

    return read


#: Stands where a row of a document ends that has several; no text holds it after `_spaced`.
ROW_END = "\n"


def _spaced(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, words): a document's words with a space between them, in one row also where several have its id."""
    words = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}_]+", " ")
    slim = docs.select(F.col(key).alias("doc_id"), words.alias("words"))
    twice = docs.groupBy(F.col(key).alias("_id")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select("_id")
    if twice.isEmpty():
        return slim
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    merged = slim.join(twice, same, "left_semi").groupBy("doc_id").agg(F.array_join(F.collect_list("words"), f" {ROW_END} ").alias("words"))
    return slim.join(twice, same, "left_anti").unionByName(merged)


def most_frequent(rows: DataFrame, most: int, cut: Callable[[DataFrame, str], DataFrame], read: Callable[[pa.Array], Grams] = _each_term, *, size: int = COUNTERS) -> DataFrame:
    """(term, cf, df): the `most` most frequent terms of the rows of one column, exactly, ties by term, and in how many rows each stands.

    `read` gives the terms of a batch of rows. A task counts them in `size` counters by hash, so that what is shuffled is a
    share of the counters and not of the terms; a counter is at least each of its terms' count. The terms of the `2 * most`
    largest counters are then counted themselves. The `most`-th of these counts is a bound that the wanted terms reach;
    should a counter that was left out reach it too, the terms of all that do are counted once more.
    """
    bounded_batches(rows.sparkSession)
    bits = COUNTERS_ROW

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held = np.zeros(size, np.int64), 0

        def told() -> pa.RecordBatch:
            some = counts.reshape(-1, bits)
            parts = np.flatnonzero(some.any(axis=1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(parts) + 1) * bits, pa.int32()), pa.array(some[parts].ravel().astype(np.int32)))
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), lists], names=["part", "n"])

        for batch in batches:
            found = read(batch.column(0)).counters(size)
            if held + len(found) >= 1 << 31:  # a counter is 32 bits wide
                yield told()
                counts[:], held = 0, 0
            counts += np.bincount(found, minlength=size)
            held += len(found)
        yield told()

    def added(part: pa.Table) -> pa.Table:
        n = part.column("n").combine_chunks()
        whole = n.values.to_numpy()[n.offsets[0].as_py() : n.offsets[-1].as_py()].reshape(-1, bits).sum(axis=0, dtype=np.int64)
        return pa.table({"part": part.column("part")[:1], "n": pa.array([whole])})

    summed = rows.mapInArrow(tally, "part int, n array<int>").groupBy("part").applyInArrow(added, "part int, n array<long>").toArrow()  # `size` numbers
    counters = np.zeros((size // bits, bits), np.int64)
    if summed.num_rows:
        counters[summed.column("part").to_numpy()] = np.stack([np.asarray(x) for x in summed.column("n").to_pylist()])
    counters = counters.ravel()

    def counted(least: int) -> DataFrame:
        likely = counters >= least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = read(batch.column(0))
                found = found.only(likely[found.counters(size)])
                terms, number = found.numbered()
                cf = np.bincount(number, minlength=len(terms))
                df = np.bincount(np.unique(found.row * max(1, len(terms)) + number) % max(1, len(terms)), minlength=len(terms))
                yield pa.RecordBatch.from_arrays([terms, pa.array(cf, pa.int64()), pa.array(df, pa.int64())], names=["term", "cf", "df"])

        each = rows.mapInArrow(run, "term string, cf long, df long").groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))
        return cut(each.orderBy(F.desc("cf"), F.asc("term")).limit(most), f"frequent-{least}")

    least = max(1, int(np.partition(counters, -2 * most)[-2 * most])) if 2 * most < size else 1
    found = counted(least)
    last = found.agg(F.count(F.lit(1)).alias("n"), F.min("cf").alias("cf")).first()
    reached = last["cf"] if last["n"] == most else 1
    return found if reached >= least else counted(reached)


def tfidf(docs: DataFrame, cut: Callable[[DataFrame, str], DataFrame], *, key: str = "doc_id", text: str = "text", most: int = 10_000, sublinear: bool = True, bigrams: bool = True, stop_words: tuple[str, ...] = STOP_WORDS) -> Vectors:
    """Vectors over the `most` most frequent 1- and 2-grams without stop words, which are a parameter: pass a library's list to get its vectors.

    `cut` writes a table and reads it again. Which terms are used is settled before documents and terms meet; a document's
    vector is then made where its text is, so neither texts nor vectors are shuffled. What is stored are the terms, and of
    the documents their terms' numbers of occurrences and the vectors' lengths, which queries share.
    """
    spaced, read = _spaced(docs, key, text), _each_gram(bigrams, stop_words)
    n = docs.count()
    chosen = most_frequent(spaced.select("words"), most, cut, read)
    terms = cut(chosen.select("term", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf")), "terms")
    held = terms.orderBy("term").toArrow()  # `most` terms at most
    names, idf = held.column("term").combine_chunks().cast(pa.string()), held.column("idf").to_numpy()
    # A term as the numbers of its words: its first one's times the number of words, and its second one's.
    parts = [x.split(" ") for x in names.to_pylist()]
    known = {w: k for k, w in enumerate(sorted({w for x in parts for w in x}))}
    wide = len(known) + 1
    codes = np.array([known[x[0]] * wide + (known[x[1]] + 1 if len(x) > 1 else 0) for x in parts], np.int64)
    order = np.argsort(codes)
    codes, vocabulary = codes[order], pa.array(list(known), pa.string())
    kind = spaced.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = read(batch.column(1))
            if not len(codes) or not len(found.row):
                continue
            of = np.append(pc.fill_null(pc.index_in(found.words, value_set=vocabulary), -1).to_numpy().astype(np.int64), -1)
            first, second = of[found.first], of[found.second]
            code = first * wide + second + 1
            at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            # A second word that isn't known has the number of none.
            hit = (codes[at] == code) & (first >= 0) & ((found.second < 0) | (second >= 0))
            each, tf = np.unique(found.row[hit] * len(codes) + order[at[hit]], return_counts=True)
            row, term = np.divmod(each, len(codes))
            x = ((1 + np.log(tf)) if sublinear else tf) * idf[term]
            norm = np.sqrt(np.bincount(row, x * x, minlength=batch.num_rows))[row]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), names.take(pa.array(term)), pa.array(tf, pa.int64()), pa.array(norm)], names=["doc_id", "term", "tf", "norm"])

    frequencies = cut(spaced.mapInArrow(run, f"doc_id {kind}, term string, tf long, norm double"), "frequencies")
    return Vectors(frequencies, terms, sublinear, bigrams, stop_words)


def semantic(vectors: Vectors, queries: DataFrame, *, limit: int = 5, least: float = 0.05) -> DataFrame:
    """Cosine of the vectors of queries and documents by a join on terms; below `least` nothing is returned. Queries are split as documents are."""
    asked = _weighed(_terms(queries, "query_id", "query", vectors.bigrams, vectors.stop_words).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("tf")), vectors.terms, "query_id", vectors.sublinear).withColumnRenamed("weight", "qw")
    wanted = F.broadcast(asked.select("term").distinct())  # no more than the vectors have
    met = vectors.weights.filter(F.col("doc_id").isNotNull()).join(wanted, "term", "left_semi")
    scored = met.join(asked, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("weight") * F.col("qw")), 4).alias("score"))
    return top(scored.filter(F.col("score") >= least), limit, [F.desc("score"), F.asc("doc_id")])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def best_of(scores: np.ndarray, ids: np.ndarray, limit: int) -> np.ndarray:
    """Columns of the `limit` highest scores of each row, best first, ties by least id; ids ascend. One selection for each row, no sort of it."""
    ranks = np.where(np.isnan(scores), np.inf, scores) if np.isnan(scores).any() else scores
    n = ranks.shape[1]
    if n > limit:
        least = np.partition(ranks, n - limit, axis=1)[:, n - limit, None]
        columns = np.nonzero(ranks >= least)[1]
        if len(columns) > limit * len(ranks):
            above, equal = ranks > least, ranks == least
            equal &= np.cumsum(equal, axis=1, dtype=np.int32) <= limit - np.count_nonzero(above, axis=1)[:, None]
            columns = np.nonzero(above | equal)[1]
        columns = columns.reshape(-1, limit)
    else:
        columns = np.broadcast_to(np.arange(n), ranks.shape)
    order = np.argsort(-np.take_along_axis(ranks, columns, 1), axis=1, kind="stable")
    return np.take_along_axis(columns, order, 1)


def nearest(vectors: DataFrame, queries: DataFrame, *, key: str = "vec_id", vector: str = "embedding", limit: int = 5, block: int = 4096, query_block: int = 1024) -> DataFrame:
    """The best dot products (to six digits, ties by least key) for each query vector (query_id, qv).

    Both sides stand in blocks, one row each, so that vectors and queries never meet one by one: a pair of blocks is one matrix
    product, of which the best `limit` of each query are selected, and these are ranked over all blocks. The vectors' blocks are
    dealt to two shares a block, as many as the session has shuffle partitions at most, each a task however few bytes it holds, and
    each share gets the queries' blocks, so a large table of queries is searched for as well. Vectors of another length than the query's, null
    vectors and such with null elements give no row.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    shares = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(8, 2 * -(-vectors.count() // block)))

    def blocks(rows: DataFrame, name: str, of: str, n: int, side: str) -> DataFrame:
        kept = "array<float>" if rows.schema[of].dataType.simpleString() == "array<float>" else "array<double>"
        whole = rows.filter(F.col(of).isNotNull() & (F.size(of) > 0) & ~F.exists(of, F.isnull))
        # Blocks are runs of n rows of an input partition.
        slim = whole.select(F.col(name).alias("id"), F.col(of).cast(kept).alias("x"), F.size(of).alias("dim"), F.expr(f"monotonically_increasing_id() div {n}").alias("part"))
        return slim.groupBy("dim", "part").agg(F.collect_list("id").alias(f"{side}_ids"), F.flatten(F.collect_list("x")).alias(f"{side}_x"))

    left = blocks(vectors, key, vector, block, "v").withColumn("share", F.pmod(F.xxhash64("part"), F.lit(shares)).cast("int")).drop("part")
    right = blocks(queries, "query_id", "qv", query_block, "q").withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).drop("part")
    # By number, as shares of few bytes would be put together into few tasks.
    pairs = left.repartition(shares, "share").join(right.repartition(shares, "share"), ["dim", "share"]).select("dim", "v_ids", "v_x", "q_ids", "q_x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                dim, (ids, x, asked, qx) = batch.column(0)[k].as_py(), (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in range(1, 5))
                by_id = np.argsort(ids, kind="stable")
                ids, x = ids[by_id], x.reshape(-1, dim).astype(np.float64)[by_id]
                scores = np.round(qx.reshape(-1, dim).astype(np.float64) @ x.T, 6)
                order = best_of(scores, ids, limit)
                yield pa.RecordBatch.from_pydict({"query_id": np.repeat(asked, order.shape[1]), "doc_id": ids[order].ravel(), "score": np.take_along_axis(scores, order, 1).ravel()})

    kinds = [rows.schema[name].dataType.simpleString() for rows, name in ((queries, "query_id"), (vectors, key))]
    found = pairs.mapInArrow(run, f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")
    return top(found, limit, [F.desc("score"), F.asc("doc_id")])


def hybrid(lexical: DataFrame, other: DataFrame, key: str = "url") -> DataFrame:
    """Lexical results, then others with unseen keys."""
    return lexical.withColumn("source", F.lit(0)).unionByName(other.join(lexical.select("query_id", key), ["query_id", key], "left_anti").withColumn("source", F.lit(1)))


def search_code(index: Stored, grams: substring.Grams, code: DataFrame, queries: DataFrame, cut: Callable[[DataFrame, str], DataFrame], *, language: str | None = None, limit: int = 10) -> DataFrame:
    """Ranked code blocks, and where they are fewer than `limit`, those that hold the query as a substring and weren't ranked.

    code: code_id, body (what the indexes were built over), language. Only queries that are left short are looked up in the
    index of trigrams.
    """
    if language:
        code = code.filter(F.lower("language") == language.lower())
    of = code.select(F.col("code_id").alias("doc_id"))
    hits = inverted.bm25(index, queries, cut).join(of, "doc_id").select("query_id", F.col("doc_id").alias("code_id"), F.round("bm25", 9).alias("bm25"), F.lit(0).alias("src"))
    order = [F.asc("src"), F.asc("bm25"), F.asc("code_id")]
    ranked = cut(top(hits, limit, order).drop("rank"), "ranked-code")
    enough = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= limit)
    short = cut(queries.join(enough, "query_id", "left_anti"), "short-code")
    if short.isEmpty():
        return top(ranked, limit, order)
    like = substring.containing(code, grams, short, cut, key="code_id", text="body").select("query_id", "code_id", F.lit(0.0).alias("bm25"), F.lit(1).alias("src"))
    return top(ranked.unionByName(like.join(ranked.select("query_id", "code_id"), ["query_id", "code_id"], "left_anti")), limit, order)


def filtered(docs: DataFrame, *, domain: str | None = None, after=None, with_code: bool | None = None, language: str | None = None, code: DataFrame | None = None) -> DataFrame:
    """The documents that a filtered search runs on. A language, and with_code, ask for documents with such code blocks (doc_id, language) if `code` is given."""
    if domain:
        docs = docs.filter(F.contains(F.lower("url"), F.lit(domain.lower())))
    if after is not None:
        docs = docs.filter(F.col("scraped_at") >= F.lit(after).cast(docs.schema["scraped_at"].dataType))
    if code is not None and (with_code or language):
        blocks = code.filter(F.lower("language") == language.lower()) if language else code
        return docs.join(blocks.select("doc_id").distinct(), "doc_id", "left_semi")
    if with_code:
        docs = docs.filter(F.col("has_code"))
    return docs


def filtered_search(index: Stored, docs: DataFrame, queries: DataFrame, cut: Callable[[DataFrame, str], DataFrame], *, limit: int = 10, **filters) -> DataFrame:
    """The best documents of each query among those that pass the filters; term statistics are those of the whole index."""
    hits = inverted.bm25(index, queries, cut).join(filtered(docs, **filters).select("doc_id"), "doc_id", "left_semi")
    return top(hits.select("query_id", "doc_id", F.round("bm25", 9).alias("bm25")), limit, [F.asc("bm25"), F.asc("doc_id")])


def formatted(results: DataFrame, chars: int = 400) -> DataFrame:
    """Results with their snippet cut to `chars` characters, marked by dots, and the url where there is no title."""
    cut = F.concat(F.rtrim(F.substring("content", 1, chars)), F.lit("..."))
    snippet = F.when(F.length("content") > chars, cut).otherwise(F.coalesce("content", F.lit("")))
    return results.withColumn("snippet", snippet).withColumn("title", F.coalesce(F.when(F.trim("title") != "", F.col("title")), F.col("url"))).drop("content")


def formatted_vectors(results: DataFrame, chars: int = 1500) -> DataFrame:
    """Scores to three digits, the beginning of the content and its whole length."""
    return results.select("query_id", "doc_id", F.round("score", 3).alias("score"), F.substring("content", 1, chars).alias("snippet"), F.length("content").alias("length"))
