"""A stored full-text index: stemmed, in hash buckets of the stem, in versions, kept up to date by delta segments.

A folder holds the tables of all versions and a manifest of each, which is written last; readers take the newest manifest,
so they never see half a change, and those that read an older one keep what it names.

    docs/v=N/bucket=B        doc_id, dl (tokens of each field), terms (stem, tf of each field): a forward index by bucket of the id
    postings/v=N/bucket=B    stem, ids, sizes (tokens of these documents), tfs (of each field, theirs): by bucket of the stem, sorted; a
                             stem has a row for each run of documents that were inverted together
    terms/v=N/lead=L         stem, df: signed changes of the number of documents; by bucket of the first character
    gone/v=N                 ids whose rows of versions before N are dead
    manifests/v=N            which versions make up each bucket, and the totals over all documents

A row is live unless a later version says that its document is gone. A change writes just its own rows: postings of the
new documents, ids of the replaced ones, and the difference that both make to the term statistics, which the replaced
documents' stored terms give without a look at any text. `compacted` folds deltas into the buckets that they touch; the
others stay as they are. A query reads the buckets of its stems alone: prefixes are resolved on the dictionary first.

Tokens are lower-case runs of letters and digits; stems are Porter's. Null texts have no tokens; rows with a null id aren't
indexed; of several rows with one id, all count as rows of that document.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import count
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions import text as tx
from tesserae.session import bounded_batches, dropped_shuffles

K1 = 1.2
B = 0.75
#: Text bytes for each bucket of stems, about, and bounds of the number of buckets, which an index keeps. A bucket's rows stand in as
#: many files as they need.
BUCKET_BYTES = 16 << 20
FEWEST, MOST = 8, 4096
#: Buckets of the dictionary's first characters.
LEADS = 16
#: Postings that are inverted together, about, and documents of an index for each share that its buckets are written in.
RUN = 500_000
SHARE = 1_000_000

_TERM = "struct<stem:string,tf:array<int>>"
_DOCS = f"doc_id long, dl array<int>, terms array<{_TERM}>, v int, bucket int"
_BLOCK = "stem string, ids array<long>, sizes array<int>, tfs array<array<int>>"
_POSTINGS = _BLOCK + ", v int, bucket int"
_TERMS = "stem string, df long, v int, lead int"
_GONE = "doc_id long, v int"

Cut = Callable[[DataFrame, str], DataFrame]


def code_version() -> str:
    """A digest of the code that an index depends on: what older code has built isn't read."""
    return hashlib.sha256(b"".join(Path(f).read_bytes() for f in (__file__, tx.__file__))).hexdigest()[:16]


def bucket_of(column: str | Column, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def lead_of(stem: str | Column) -> Column:
    return bucket_of(F.substring(stem, 1, 1), LEADS)


def analysed(docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(doc_id, dl, terms): the tokens of each field counted by stem. Texts are split by Spark; stems are kept by word in each worker."""
    n = len(fields)
    words = lambda f: F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(f), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    bounded_batches(docs.sparkSession)
    slim = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), *(words(f).alias(f"f{k}") for k, f in enumerate(fields)))
    schema = pa.schema([("doc_id", pa.int64()), ("dl", pa.list_(pa.int32())), ("terms", pa.list_(pa.struct([("stem", pa.string()), ("tf", pa.list_(pa.int32()))])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}

        def stemmed(word: str) -> str:
            stem = known.get(word)
            if stem is None:
                if len(known) > 500_000:
                    known.clear()
                stem = known[word] = tx.porter(word)
            return stem

        for batch in batches:
            rows = batch.num_rows
            dl = np.zeros((rows, n), np.int32)
            words, places, columns = [], [], []
            for k in range(n):
                text = batch.column(k + 1).cast(pa.large_string())
                split = pc.split_pattern(text, " ")  # words are parted by one space; an empty text has none
                kept = pc.list_flatten(split)
                place = np.repeat(np.arange(rows), np.diff(split.offsets.to_numpy()))
                whole = pc.not_equal(kept, "")
                words.append(kept.filter(whole))
                places.append(place[whole.to_numpy(zero_copy_only=False)])
                columns.append(np.full(len(places[-1]), k))
                dl[:, k] = np.bincount(places[-1], minlength=rows)
            coded = pc.dictionary_encode(pa.concat_arrays(words))
            stems = pc.dictionary_encode(pa.array([stemmed(w) for w in coded.dictionary.to_pylist()], pa.string()))
            # Words become numbers of stems, and (document, stem) a number of its own, which is counted by field.
            of = stems.indices.to_numpy()[coded.indices.to_numpy()].astype(np.int64)
            held, at = np.unique(np.concatenate(places) * max(1, len(stems.dictionary)) + of, return_inverse=True)
            tf = np.bincount(at * n + np.concatenate(columns), minlength=len(held) * n).astype(np.int32)
            place, stem = np.divmod(held, max(1, len(stems.dictionary)))
            each = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * n, pa.int32()), pa.array(tf))
            terms = pa.StructArray.from_arrays([stems.dictionary.take(pa.array(stem)), each], fields=list(schema.field(2).type.value_type))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(place, np.arange(rows + 1)), pa.int32()), terms)
            sizes = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * n, pa.int32()), pa.array(dl.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, lists], schema=schema)

    return slim.mapInArrow(run, f"doc_id long, dl array<int>, terms array<{_TERM}>")


@dataclass(frozen=True)
class Stored:
    """One version of an index."""

    spark: SparkSession
    folder: str
    manifest: dict = field(repr=False)

    @property
    def version(self) -> int:
        return self.manifest["version"]

    @property
    def total(self) -> int:
        return self.manifest["total"]

    @property
    def buckets(self) -> int:
        return self.manifest["buckets"]

    @property
    def average(self) -> float:
        return sum(self.manifest["lengths"]) / max(1, self.total)

    def _read(self, name: str, schema: str, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(*paths)

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows (with doc_id and v) that no later version has taken back."""
        if not self.manifest["gone"]:
            return rows
        gone = self._read("gone", _GONE, [f"{self.folder}/gone/v={v}" for v in self.manifest["gone"]]).groupBy("doc_id").agg(F.max("v").alias("_until"))
        return rows.join(gone, "doc_id", "left").filter(F.col("_until").isNull() | (F.col("v") >= F.col("_until"))).select(*rows.columns)

    def _bucketed(self, name: str, schema: str, buckets: list[int] | None) -> DataFrame:
        """The live rows of some buckets: a filter on the folders of the versions that make them up."""
        wanted: dict[int, list[int]] = {}
        for bucket, versions in self.manifest[name].items():
            if buckets is None or int(bucket) in buckets:
                for v in versions:
                    wanted.setdefault(v, []).append(int(bucket))
        rows = self._read(name, schema, [f"{self.folder}/{name}/v={v}" for v in sorted(wanted)])
        some = [(F.col("v") == v) & F.col("bucket").isin(sorted(parts)) for v, parts in sorted(wanted.items())]
        rows = rows.filter(reduce(Column.__or__, some)) if some else rows
        return self._live(_single(rows, len(self.manifest["fields"])) if name == "postings" else rows)

    def docs(self, buckets: list[int] | None = None) -> DataFrame:
        return self._bucketed("docs", _DOCS, buckets)

    def postings(self, buckets: list[int] | None = None) -> DataFrame:
        """stem, doc_id, tf, size of the live documents, from the buckets of stems that are asked for."""
        return self._bucketed("postings", _POSTINGS, buckets).select("stem", "doc_id", "tf", "size", "bucket")

    def terms(self) -> DataFrame:
        """The dictionary: stem, df, lead."""
        held = self._read("terms", _TERMS, [f"{self.folder}/terms/v={v}" for v in self.manifest["terms"]])
        if len(self.manifest["terms"]) == 1:
            return held.select("stem", "df", "lead")
        return held.groupBy("stem", "lead").agg(F.sum("df").alias("df")).filter(F.col("df") > 0).select("stem", "df", "lead")


# --- writing ---------------------------------------------------------------------------------------------------------


def _numbers(df: DataFrame, column: str) -> list[int]:
    """The different numbers of a column that has a bound, as buckets have."""
    return sorted(r[0] for r in df.select(column).distinct().collect())


def _commit(spark: SparkSession, folder: str, manifest: dict) -> Stored:
    """The manifest as the last thing of a version: one file, which appears whole."""
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifests/v={manifest['version']}")
    return Stored(spark, folder, manifest)


def opened(spark: SparkSession, folder: str, version: int | None = None) -> Stored | None:
    """The newest version of the index in a folder, or the one asked for; None where there is none."""
    try:
        found = [json.loads(r["value"]) for r in spark.read.text(f"{folder}/manifests/v={'*' if version is None else version}").collect()]
    except AnalysisException:
        return None
    return Stored(spark, folder, max(found, key=lambda m: m["version"])) if found else None


def _write_docs(found: DataFrame, folder: str, version: int, buckets: int) -> None:
    """Dealt by bucket, which is a hash of the id, so texts are analysed once and go from there to their files."""
    with dropped_shuffles(found.sparkSession):
        found.withColumn("bucket", bucket_of("doc_id", buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/docs/v={version}")


def _inverted(rows: DataFrame) -> DataFrame:
    """Blocks of (stem, doc_id, tf, size) rows: RUN rows of a task at a time are put together by stem."""
    schema = pa.schema([("stem", pa.string()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("tfs", pa.list_(pa.list_(pa.int32())))])

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        every = pa.Table.from_batches(held).combine_chunks()
        coded = pc.dictionary_encode(every.column("stem").chunk(0))
        codes = coded.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        many = np.bincount(codes, minlength=len(coded.dictionary))
        begins = np.concatenate(([0], np.cumsum(many)))
        ids, sizes = (every.column(c).to_numpy()[order] for c in ("doc_id", "size"))
        tf = every.column("tf").chunk(0).flatten().to_numpy().reshape(len(order), -1)[order]
        n, rows = tf.shape[1], len(many)
        # A block's numbers of the first field, then those of the next.
        row = np.repeat(np.arange(rows), many)
        at = begins[row] * n + np.arange(len(order)) - begins[row]
        values = np.empty(len(order) * n, np.int32)
        for f in range(n):
            values[at + f * many[row]] = tf[:, f]
        inner = np.append((begins[:-1, None] * n + np.arange(n) * many[:, None]).ravel(), len(values))
        of = lambda offsets, items: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)
        tfs = of(np.arange(rows + 1) * n, of(inner, pa.array(values)))
        return pa.RecordBatch.from_arrays([coded.dictionary, of(begins, pa.array(ids, pa.int64())), of(begins, pa.array(sizes, pa.int32())), tfs], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= RUN:
                yield block(held)
                held, size = [], 0
        if held:
            yield block(held)

    bounded_batches(rows.sparkSession)
    return rows.select("stem", "doc_id", "tf", "size").mapInArrow(run, _BLOCK)


def _single(blocks: DataFrame, fields: int) -> DataFrame:
    """The postings of blocks, one by one."""
    zipped = F.arrays_zip(F.col("ids").alias("doc_id"), F.col("sizes").alias("size"), *(F.get("tfs", F.lit(k)).alias(f"tf{k}") for k in range(fields)))
    each = blocks.select("stem", "v", "bucket", F.inline(zipped))
    return each.select("stem", "doc_id", F.array(*(F.col(f"tf{k}") for k in range(fields))).alias("tf"), "size", "v", "bucket")


def _write_postings(rows: DataFrame, path: str, buckets: int, total: int) -> None:
    """Blocks by bucket and, in large indexes, share of it, so that a stem in most documents is written by several tasks."""
    share = F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.lit(1 + total // SHARE))
    blocks = _inverted(rows).withColumn("bucket", bucket_of("stem", buckets))
    with dropped_shuffles(rows.sparkSession):
        blocks.repartition("bucket", share).sortWithinPartitions("bucket", "stem").write.mode("overwrite").partitionBy("bucket").parquet(path)


def _postings_of(docs: DataFrame) -> DataFrame:
    size = F.aggregate("dl", F.lit(0), lambda a, x: a + x)
    return docs.select("doc_id", size.alias("size"), F.explode("terms").alias("t")).select("t.stem", "doc_id", "t.tf", "size")


def _changes(docs: DataFrame, sign: int) -> DataFrame:
    return docs.select(F.explode("terms.stem").alias("stem"), F.lit(sign).cast("long").alias("df"))


def _write_terms(changes: DataFrame, folder: str, version: int) -> None:
    summed = changes.groupBy("stem").agg(F.sum("df").alias("df")).withColumn("lead", lead_of("stem"))
    with dropped_shuffles(changes.sparkSession):
        summed.repartitionByRange("lead", "stem").sortWithinPartitions("lead", "stem").write.mode("overwrite").partitionBy("lead").parquet(f"{folder}/terms/v={version}")


def _sums(docs: DataFrame, fields: int) -> tuple[int, list[int]]:
    row = docs.agg(F.count(F.lit(1)), *(F.coalesce(F.sum(F.get("dl", F.lit(k))), F.lit(0)) for k in range(fields))).first()
    return row[0], list(row[1:])


def build(docs: DataFrame, folder: str, *, key: str = "doc_id", fields: list[str] | None = None) -> Stored:
    """M7: an index of the fields, as version 0 of a folder."""
    spark, fields = docs.sparkSession, fields or ["text"]
    size = docs.agg(F.sum(sum((F.coalesce(F.octet_length(f), F.lit(0)) for f in fields), F.lit(0)).cast("long"))).first()[0] or 0
    buckets = min(MOST, max(FEWEST, 1 << (size // BUCKET_BYTES).bit_length()))
    _write_docs(analysed(docs, key, fields), folder, 0, buckets)
    first = Stored(spark, folder, {"gone": []})
    held = first._read("docs", _DOCS, [f"{folder}/docs/v=0"])
    total, lengths = _sums(held, len(fields))
    _write_postings(_postings_of(held), f"{folder}/postings/v=0", buckets, total)
    # Blocks are fewer than the documents' terms.
    blocks = first._read("postings", _POSTINGS, [f"{folder}/postings/v=0"])
    _write_terms(blocks.select("stem", F.size("ids").cast("long").alias("df")), folder, 0)
    of = lambda name, schema: {str(b): [0] for b in _numbers(first._read(name, schema, [f"{folder}/{name}/v=0"]), "bucket")}
    return _commit(spark, folder, {"version": 0, "buckets": buckets, "key": key, "fields": fields, "docs": of("docs", _DOCS), "postings": of("postings", _POSTINGS), "terms": [0], "gone": [], "total": total, "lengths": lengths})


def changed(index: Stored, new: DataFrame, gone: DataFrame | None = None) -> Stored:
    """The next version, in which documents of `new` are added or replace those of their ids, and those of `gone` (doc_id) are deleted.

    What is read is the new documents and the stored rows of the ids that go; what is written is in proportion to them.
    """
    spark, folder, v = index.spark, index.folder, index.version + 1
    fields, held, buckets = index.manifest["fields"], index.manifest, index.buckets
    _write_docs(analysed(new, held["key"], fields), folder, v, buckets)
    added = index._read("docs", _DOCS, [f"{folder}/docs/v={v}"])
    ids = added.select("doc_id")
    if gone is not None:
        ids = ids.unionByName(gone.select(F.col("doc_id").cast("long")))
    ids = ids.filter("doc_id is not null").distinct()
    # Only those that are there leave a mark; their buckets bound what is read to find them.
    there = index.docs(_numbers(ids.select(bucket_of("doc_id", buckets).alias("b")), "b")).join(ids, "doc_id", "left_semi")
    there.select("doc_id").distinct().write.mode("overwrite").parquet(f"{folder}/gone/v={v}")
    _write_terms(_changes(added, 1).unionByName(_changes(there, -1)), folder, v)
    (n, plus), (m, minus) = _sums(added, len(fields)), _sums(there, len(fields))
    _write_postings(_postings_of(added), f"{folder}/postings/v={v}", buckets, n)

    def more(name: str, schema: str) -> dict[str, list[int]]:
        written = _numbers(index._read(name, schema, [f"{folder}/{name}/v={v}"]), "bucket")
        return held[name] | {str(b): [*held[name].get(str(b), []), v] for b in written}

    manifest = held | {"version": v, "docs": more("docs", _DOCS), "postings": more("postings", _POSTINGS), "terms": [*held["terms"], v], "gone": [*held["gone"], v] if m else held["gone"]}
    return _commit(spark, folder, manifest | {"total": index.total + n - m, "lengths": [a + b - c for a, b, c in zip(held["lengths"], plus, minus, strict=True)]})


def compacted(index: Stored) -> Stored:
    """The next version with the deltas folded in: buckets that they touch are written anew, the others stay where they are."""
    spark, folder, held, v = index.spark, index.folder, index.manifest, index.version + 1
    if len(held["terms"]) == 1:
        return index
    deltas = index._read("terms", _TERMS, [f"{folder}/terms/v={d}" for d in held["terms"][1:]])
    touched = {"postings": set(_numbers(deltas.select(bucket_of("stem", index.buckets).alias("b")), "b"))}
    dead = index._read("gone", _GONE, [f"{folder}/gone/v={d}" for d in held["gone"]])
    touched["docs"] = set(_numbers(dead.select(bucket_of("doc_id", index.buckets).alias("b")), "b")) | {int(b) for b, parts in held["docs"].items() if len(parts) > 1}
    out = {}
    for name, schema in (("docs", _DOCS), ("postings", _POSTINGS)):
        rows = index._bucketed(name, schema, sorted(touched[name]))
        path = f"{folder}/{name}/v={v}"
        if name == "docs":
            rows.drop("v").write.mode("overwrite").partitionBy("bucket").parquet(path)
        else:
            _write_postings(rows, path, index.buckets, index.total)
        whole = {str(b): [v] for b in _numbers(index._read(name, schema, [path]), "bucket")}
        out[name] = {b: parts for b, parts in held[name].items() if int(b) not in touched[name]} | whole
    _write_terms(index.terms().select("stem", "df"), folder, v)
    return _commit(spark, folder, held | out | {"version": v, "terms": [v], "gone": []})


# --- searching -------------------------------------------------------------------------------------------------------


def asked(queries: DataFrame, *, key: str = "query_id", query: str = "query") -> DataFrame:
    """(query_id, q) the different stems of each query's tokens."""
    words = queries.select(F.col(key).alias("query_id"), F.explode(F.array_distinct(tx.tokens(F.col(query)))).alias("word"))
    return tx.stems(words, term="word", into="q").select("query_id", "q").distinct()


@dataclass(frozen=True)
class Matches:
    """What a batch of queries matches: its stems (query_id, q), and the postings that they meet (query_id, q, doc_id, tf, size)."""

    index: Stored
    terms: DataFrame
    found: DataFrame

    def scores(self, weights: list[float] | None = None) -> DataFrame:
        """E5: (query_id, doc_id, bm25, matched): negative, smaller is better; matched counts the query's stems that the document has.

        E53: `weights` are those of the fields. A stem in over half of the documents counts next to nothing.
        """
        weights = weights or [1.0] * len(self.index.manifest["fields"])
        weighed = sum((F.get("tf", F.lit(k)) * F.lit(float(w)) for k, w in enumerate(weights)), F.lit(0.0))
        each = self.found.groupBy("query_id", "q", "doc_id", "size").agg(F.sum(weighed).alias("f"))
        n = each.groupBy("query_id", "q").agg(F.count(F.lit(1)).alias("n"))
        total, average = self.index.total, self.index.average
        idf = F.log((total - F.col("n") + 0.5) / (F.col("n") + 0.5))
        idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
        part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("size") / average))
        return each.join(n, ["query_id", "q"]).groupBy("query_id", "doc_id").agg((-F.sum(part)).alias("bm25"), F.count(F.lit(1)).alias("matched"))


def matches(index: Stored, queries: DataFrame, cut: Cut, *, prefix: bool = True) -> Matches:
    """The queries' stems, whole or as prefixes, met with the postings of their buckets.

    Stems are resolved on the dictionary, by their first character and then tested; of what was found the buckets come to
    the driver, MOST numbers at most, and no other files of postings are read.
    """
    terms = cut(asked(queries), "asked")
    leads = _numbers(terms.select(lead_of("q").alias("lead")), "lead")
    words = index.terms().filter(F.col("lead").isin(leads))
    with_lead = terms.withColumn("lead", lead_of("q"))
    if prefix:
        resolved = words.join(with_lead, "lead").filter(F.col("stem").startswith(F.col("q")))
    else:
        resolved = words.join(with_lead.withColumn("stem", F.col("q")), ["lead", "stem"])
    met = cut(resolved.select("query_id", "q", "stem", bucket_of("stem", index.buckets).alias("bucket")), "resolved")
    postings = index.postings(_numbers(met, "bucket"))
    found = postings.join(met, ["bucket", "stem"]).select("query_id", "q", "doc_id", "tf", "size")
    return Matches(index, terms, found)


def bm25(index: Stored, queries: DataFrame, cut: Cut, *, prefix: bool = True, every: bool = False, weights: list[float] | None = None) -> DataFrame:
    """(query_id, doc_id, bm25); with `every`, only documents that have all of a query's stems."""
    held = matches(index, queries, cut, prefix=prefix)
    scored = held.scores(weights)
    if every:
        needed = held.terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("_needed"))
        scored = scored.join(needed, "query_id").filter(F.col("matched") == F.col("_needed"))
    return scored.select("query_id", "doc_id", "bm25")


def scratch(spark: SparkSession, base: str) -> Cut:
    """Writes the small tables of one search to a new folder of the shared one, and reads them again."""
    folder, number = f"{base}/search-{uuid.uuid4().hex}", count()

    def cut(df: DataFrame, part: str) -> DataFrame:
        path = f"{folder}/{next(number)}-{part}"
        with dropped_shuffles(spark):
            df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return cut
