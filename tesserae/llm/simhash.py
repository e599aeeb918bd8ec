"""SimHash near-duplicates with deletion-variant signatures.

A fingerprint has 64 bits: bit b is 1 if it is set in over half of the text's word shingles' XXH64 hashes. Fingerprints
link at two or fewer differing bits; components are what links reach.

Links come from deletion-variant signatures. A fingerprint is cut into two segments of 32 bits; of two differing bits,
either both lie in one segment, and the other is equal, or each segment has one. So a fingerprint is indexed under both
segments as they are, and under the first with each one of its bits wildcarded; an equality join on these 34 keys finds
every link, and a bit count verifies it. Equal fingerprints are one row from the start. Keys that more than HOT
fingerprints share make no pairs: their fingerprints are indexed under all 2016 two-bit wildcards instead, where at most
four can meet, all of them linked. So nothing is dropped, and no key makes rows by the square of its size.

Defined results: texts without words (null, empty, white space) have fingerprint 0 and link like others; repeated rows
give a row each; a null doc_id counts in a component only if all its ids are null; texts of any length are read whole; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm import common

SEED = 42
#: Fingerprints that share a key from which no pairs are made of them.
HOT = 256
#: Rows that share a fingerprint, as a share of all rows, from which they are joined apart: 1 / share of them at most.
HEAVY = 0.001

_LOW = 0xFFFFFFFF


def print_of(text: str | None, width: int) -> int:
    """The fingerprint as a signed 64-bit number; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = list(itertools.accumulate(map(len, words), lambda a, b: a + b + 1))
        starts = [0, *[e + 1 for e in ends[: n - 1]]]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :], strict=True)]
    bits = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        part = np.array(hashes[k : k + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<i8")[0])


def prints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of each document over shingles of `width` words. One narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [print_of(v, width) for v in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return common.mapped(rows, run, T.StructType([rows.schema["doc_id"], T.StructField("fp", T.LongType())]), __name__)


def _keys(fp: Column) -> Column:
    """The 34 keys: number of the variant in the upper half, value in the lower."""
    first, second = F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(_LOW))
    one_wild = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda j: F.call_function("shiftleft", (j + 2).cast("long"), F.lit(32)).bitwiseOR(first.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), j)))))
    return F.concat(F.array(first, second.bitwiseOR(F.lit(1 << 32))), one_wild)


def links(heads: DataFrame, where: str, *, hot: int = HOT) -> DataFrame:
    """(a, b) with a > b: fingerprints that differ in one or two bits; every link, those within hot keys by way of others."""
    indexed = heads.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    shared = indexed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = common.cut(indexed.join(shared.hint("merge"), "key"), where, "met")
    a, b = (met.filter(F.col("n") <= hot).select("key", F.col("fp").alias(x)) for x in "ab")
    apart = F.col("a").bitwiseXOR(F.col("b"))
    pairs = a.join(b.hint("merge"), "key").filter((F.col("a") > F.col("b")) & (F.bit_count(apart) <= 2) & ((F.shiftrightunsigned("key", 32) < 2) | (F.shiftrightunsigned(apart, 32) != 0))).select("a", "b").distinct()
    crowded = met.filter(F.col("n") > hot).select("fp").distinct()
    wild = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: F.transform(F.sequence(i + 1, F.lit(63)), lambda j: F.struct((i * 64 + j).cast("int").alias("mask"), F.col("fp").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), i).bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), j)))).alias("rest")))))
    near = (
        crowded.select("fp", F.explode(wild).alias("k"))
        .groupBy("k.mask", "k.rest")
        .agg(F.collect_set("fp").alias("fps"))  # four at most
        .filter(F.size("fps") > 1)
        .select(F.explode("fps").alias("a"), F.array_min("fps").alias("b"))
        .filter("a > b")
        .distinct()
    )
    return pairs.unionByName(near)


def roots(edges: DataFrame, where: str) -> DataFrame:
    """(node, root): the smallest node that each node of an edge reaches. Edges are (a, b) with a > b.

    Large-star and small-star steps (Kiveris et al.) until the edges are stars; each step is written to the shared folder. No
    table of nodes or edges is broadcast, as tables that are small in a file can be large in the driver; a node of very many
    edges is joined apart.
    """

    def with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
        return common.join_heavy(edges, least, ["a"], "n", max(1000.0, HEAVY * edges.count()), ["m"])

    step = 0
    at = common.cut(edges.distinct(), where, "edges-0")
    while True:
        both = at.select("a", "b").unionByName(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = with_least(both.filter("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = common.cut(large.distinct(), where, f"large-{step}")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = with_least(large, least)
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        step += 1
        at = common.cut(small.distinct(), where, f"edges-{step}")
        # Stars: no node is both below and above another, and none has two nodes below.
        forked = at.groupBy("a").count().filter("count > 1").select("a")
        if not at.select(F.col("b").alias("a")).distinct().join(at.select("a").hint("merge"), "a", "left_semi").unionByName(forked).take(1):
            return at.select(F.col("a").alias("node"), F.col("b").alias("root"))


def components(found: DataFrame, where: str, *, hot: int = HOT) -> DataFrame:
    """(doc_id, fp) with component_id added: the smallest doc_id that links reach. `found` is read several times."""
    heads = common.cut(found.groupBy("fp").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("n")), where, "heads")
    tops = roots(links(heads, where, hot=hot), where)
    placed = heads.join(tops.hint("merge"), heads["fp"] == tops["node"], "left").select("fp", "head", "n", F.coalesce("root", "fp").alias("root"))
    placed = common.cut(placed, where, "placed")
    named = placed.groupBy("root").agg(F.min("head").alias("component_id"), F.count(F.lit(1)).alias("members"))
    of = common.join_heavy(placed, named, ["root"], "members", max(1000.0, HEAVY * placed.count()), ["component_id"])
    of = common.cut(of.select("fp", "n", "component_id"), where, "components")
    # A fingerprint that many rows share is joined by broadcast; there are at most 1 / HEAVY of them.
    return common.join_heavy(found, of, ["fp"], "n", max(1.0, HEAVY * found.count()), ["component_id"])


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 3, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, fp, component_id."""
    where = common.shared_dir(docs.sparkSession)
    return components(common.cut(prints(docs, key=key, text=text, width=width), where, "prints"), where, hot=hot)
