"""One document of each group of near copies: texts with 0.8 of their five-word shingles in common.

Candidates come from two indexes. One is SimHash with deletion variants: sets whose 64-bit prints are equal or, by one-bit wildcards of
two segments, up to two bits apart. It finds the closest copies, but of sets with 0.8 in common few are that close. The other is exact:
of two sets with at least 0.8 of their union in common, and in whichever order all shingles are put, the first n // 5 + 1 of the n
of each have one in common (prefix filter). So each distinct set is indexed under its first shingles; sets that meet, and that their
sizes and the number of first shingles in common don't rule out, are compared whole. That finds every pair, with no probability in it
but that of two shingles with the same 64-bit hash. The order is that of the hashes, with frequent shingles (license lines, menus) last, the
more frequent the later. They are found in a sample; which ones are taken for frequent changes the cost and not the result.

Groups are what links reach. A first round compares a key's members with the least of them, and a second one all members of a key
that the first has left in different groups; within a group no link can change it, so there the members of a key's largest group
are compared with others only. So a large group of copies costs comparisons in proportion to its size, and no pair is left out. No texts
are shuffled for it, but the sets of those to compare.

Defined results: null and empty texts, and texts that differ in white space or ASCII case only, are copies of each other; a text of
fewer than five words is one shingle; of a group the row with the smallest doc_id stays (null ids last, then by text hash), of
repeated rows one; extra columns pass through, of whatever name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm import common, simhash

#: Words of a shingle.
WIDTH = 5
#: One row in SAMPLE is in the frequency sample; a shingle is frequent that FREQUENT of the sampled sets have, and OFTEN of them at least.
SAMPLE = 16
FREQUENT = 0.0001
OFTEN = 2
#: Frequent shingles at most, the most frequent ones: they come to the driver and to each task, of 16 bytes each.
MOST = 100_000
#: Members of a frequent key that all its sets are compared with first.
LEADERS = 6
#: Comparisons within a key from which only sets of like sketches are compared, and 64-bit words of a sketch. A sketch tells sets of
#: up to some 700 shingles apart; longer ones are compared.
CROWDED = 2000
WORDS = 8
#: Bits of the map of rows whose texts are compared: 2 MB. Others that fall on a bit of it only cost a shuffle.
MAP_BITS = 1 << 24
#: Bits in which the SimHash prints of such copies differ at most, as a rule. The stage doesn't rest on it.
MAX_BITS = 18
#: Different words from which a text has a print of its words.
SHORT = 20


def print_of(text: str | None) -> bytes:
    """SimHash of a text's set of words: a second measure, by which the tests look at what goes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    different = set(words)
    if len(different) < SHORT:
        return xxhash.xxh3_128_digest(b" ".join(words))
    bits = np.unpackbits(np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, different)), np.uint8).reshape(-1, 16), axis=1)
    return np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(different)).tobytes()


_FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(1, WIDTH + 1)]


def shingles(text: str | None) -> np.ndarray:
    """The hashes of a text's different shingles, ascending."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words) - WIDTH + 1
    if n < 1:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    found = each[:n] * _FACTORS[0]
    for k in range(1, WIDTH):
        # Shifts between the steps, so that the sum doesn't commute.
        found ^= found >> np.uint64(29)
        found += each[k : k + n] * _FACTORS[k]
    found ^= found >> np.uint64(32)
    found *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(found ^ (found >> np.uint64(32)))


@dataclass(frozen=True)
class Frequent:
    """Frequent shingles, ascending, and how often each was met."""

    shingles: np.ndarray
    counts: np.ndarray

    def first_of(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shingles under which a set is indexed: n // 5 + 1 of n, in two parts, frequent ones last. Two sets with 0.8 in common share one."""
        most = len(own) // 5 + 1
        if not len(self.shingles):
            return own[:most], own[:0]
        at = np.minimum(np.searchsorted(self.shingles, own), len(self.shingles) - 1)
        late = self.shingles[at] == own
        rare = own[~late]
        if len(rare) >= most:
            return rare[:most], own[:0]
        return rare, own[late][np.argsort(self.counts[at[late]], kind="stable")][: most - len(rare)]


NONE = Frequent(np.empty(0, np.uint64), np.empty(0, np.int64))


def simhash_of(own: np.ndarray) -> int:
    """The SimHash of a set of shingles: bit b is 1 if it is set in over half of the hashes."""
    bits = np.zeros(64, np.int64)
    for k in range(0, len(own), 1 << 14):
        bits += np.unpackbits(own[k : k + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(own), bitorder="little").view("<i8")[0])


def sketch_of(own: np.ndarray) -> np.ndarray:
    """A bit for each part of the hashes: whether the set has an odd number of shingles there."""
    odd = np.bincount((own >> np.uint64(7)).astype(np.int64) & (64 * WORDS - 1), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def prints(docs: DataFrame, frequent: Frequent, *, text: str = "text") -> DataFrame:
    """The documents without their text, with _p0 and _p1, a hash of their set of shingles, _n, its size, _fp, its SimHash, _s, its sketch, and its
    first shingles, _keys and (frequent ones) _late. One narrow pass."""
    rest = docs.drop(text).columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(map(shingles, batch.column(text).to_pylist()))
            first = list(map(frequent.first_of, sets))
            lists = [pa.array([x[k].view(np.int64) for x in first], pa.list_(pa.int64())) for k in range(2)]
            halves = _halves(sets)
            more = [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array([len(x) for x in sets], pa.int32()), pa.array(list(map(simhash_of, sets)), pa.int64()), pa.array(list(map(sketch_of, sets)), pa.list_(pa.int64())), *lists]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *more], names=[*rest, *added.names])

    added = T.StructType.fromDDL("_p0 long, _p1 long, _n int, _fp long, _s array<long>, _keys array<long>, _late array<long>")
    return common.mapped(docs, run, T.StructType([*docs.drop(text).schema.fields, *added.fields]), __name__)


def _halves(sets: list[np.ndarray]) -> np.ndarray:
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets), ">i8").astype(np.int64).reshape(-1, 2)


def frequent_shingles(slim: DataFrame, where: str) -> Frequent:
    """Shingles that many of a sample's distinct sets have.

    At most MOST come to the driver and to each task: among near copies most shingles are met twice, however few are frequent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(map(shingles, batch.column("text").to_pylist()))
            halves = _halves(sets)
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["_p0", "_p1", "all"])

    some = slim.filter(F.pmod(F.xxhash64("_file", "_at"), F.lit(SAMPLE)) == 0).select("text")
    some = common.cut(common.mapped(some, run, "_p0 long, _p1 long, all array<long>", __name__).dropDuplicates(["_p0", "_p1"]), where, "sample")
    least = max(OFTEN, int(FREQUENT * some.count()))
    found = some.select(F.explode("all").alias("key")).groupBy("key").count().filter(F.col("count") >= least).orderBy(F.desc("count"), "key").limit(MOST).toArrow()
    keys = found.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return Frequent(keys[order], found.column("count").to_numpy()[order])


def common_of(x: np.ndarray, y: np.ndarray) -> int:
    """Shingles in common of two sets, each ascending."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    return int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    """The sets of a column, without copies."""
    at = column.offsets.to_numpy()
    values = column.values.to_numpy().view(np.uint64)
    return [values[i:j] for i, j in zip(at, at[1:], strict=False)]


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) whose sets have at least 0.8 of their union in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(_arrays(batch.column("x")), _arrays(batch.column("y")), strict=True)
            keep = [9 * common_of(x, y) >= 4 * (len(x) + len(y)) for x, y in both]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")).hint("merge"), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")).hint("merge"), "b")
    return common.mapped(both.select("a", "b", "x", "y"), run, "a long, b long", __name__)


def _pairs(met: DataFrame) -> DataFrame:
    """(a, b) with a > b of rows (g, n, og, on), one for each key that the sets g and og share, that may have 0.8 in common.

    Of two sets, that whose first shingles end earlier has only what follows them, n - n // 5 - 1, besides the common ones among the first.
    """
    n, on = F.col("n"), F.col("on")
    rest = lambda n: n - F.floor(n / 5) - 1
    sized = met.filter((F.col("g") != F.col("og")) & (5 * F.least(n, on) >= 4 * F.greatest(n, on)))
    sized = sized.select(F.greatest("g", "og").alias("a"), F.least("g", "og").alias("b"), (n + on).alias("sum"), F.greatest(rest(n), rest(on)).alias("rest"))
    return sized.groupBy("a", "b", "sum", "rest").count().filter("9 * (count + rest) >= 4 * sum").select("a", "b")


def groups(heads: DataFrame, sets_of: Callable[[DataFrame, str], DataFrame], where: str) -> DataFrame:
    """(node, root) for the nodes of linked sets; heads is (node, _n, _fp, _s, _keys, _late), one row for each set, and sets_of gives (node, set) for nodes."""

    def links(pairs: DataFrame, name: str) -> DataFrame:
        pairs = common.cut(pairs, where, f"pairs-{name}")
        nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        return common.cut(_verified(pairs, sets_of(nodes, name)), where, f"links-{name}")

    each = lambda keys: heads.select(F.explode(keys).alias("key"), F.col("node").alias("g"), F.col("_n").alias("n"))
    of_key = Window.partitionBy("key")
    one = F.struct("g", "n")
    rare = each("_keys").withColumn("low", F.min(one).over(of_key)).withColumn("high", F.max(one).over(of_key)).filter("low.g <> high.g")
    rare = rare.select("key", "g", "n", F.array("low", "high").alias("leads"))
    # Frequent shingles by an aggregate and a join, so that a key which very many sets share makes no large task.
    some = [F.min(F.struct(F.xxhash64("g", F.lit(k)).alias("h"), one.alias("one"))).alias(f"h{k}") for k in range(LEADERS - 2)]
    tops = each("_late").groupBy("key").agg(F.min(one).alias("low"), F.max(one).alias("high"), *some).filter("low.g <> high.g")
    tops = tops.select("key", F.array_distinct(F.array("low", "high", *(f"h{k}.one" for k in range(LEADERS - 2)))).alias("leads"))
    late = each("_late").join(tops, "key").select("key", "g", "n", "leads")
    met = common.cut(rare.unionByName(late), where, "met")
    # A pair's other keys may have other leaders, so this round may leave out some; the second one doesn't.
    led = met.select("g", "n", F.explode("leads").alias("lead")).select("g", "n", F.col("lead.g").alias("og"), F.col("lead.n").alias("on"))
    first = links(_pairs(led).unionByName(simhash_pairs(heads, where)).distinct(), "first")
    tops = simhash.roots(first, f"{where}/first")
    # All that the first round has left apart; two of one group need no link more. Every key of two groups' members is here.
    rooted = common.cut(met.select("key", "g", "n").join(tops.withColumnRenamed("node", "g").hint("merge"), "g", "left").select("key", "g", "n", F.coalesce("root", "g").alias("root")), where, "rooted")
    sizes = rooted.groupBy("key", "root").count().groupBy("key").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("count", "root")).alias("big"), F.sum("count").alias("all")).filter("roots > 1")
    sizes = sizes.select("key", F.col("big.root").alias("big"), (F.col("all") * (F.col("all") - F.col("big.count")) > CROWDED).alias("crowded"))
    rooted = common.cut(rooted.join(sizes, "key"), where, "apart")
    again = _apart(rooted.filter("not crowded"))
    crowded = rooted.filter("crowded")
    if crowded.take(1):
        sketches = heads.select(F.col("node").alias("g"), *(F.get("_s", F.lit(k)).alias(f"s{k}") for k in range(WORDS)))
        crowded = common.cut(crowded.join(sketches, "g"), where, "crowded")
        again = again.unionByName(_apart(crowded, [f"s{k}" for k in range(WORDS)]))
    return simhash.roots(first.unionByName(links(_pairs(again), "second")), f"{where}/second")


def _apart(rooted: DataFrame, sketch: Sequence[str] = ()) -> DataFrame:
    """(g, n, og, on) for each key that sets g and og of different groups share; a key's largest group is met by the others only.

    Sets with 0.8 in common differ in a ninth of all their shingles at most, and sketches in no more bits than the sets do in shingles.
    """
    small = rooted.filter("root <> big").select("key", "g", "n", "root", *sketch)
    others = rooted.select("key", F.col("g").alias("og"), F.col("n").alias("on"), F.col("root").alias("oroot"), "big", *(F.col(c).alias(f"o{c}") for c in sketch))
    differ = " + ".join(f"bit_count({c} ^ o{c})" for c in sketch) or "0"
    return small.join(others, "key").filter(f"root <> oroot and (oroot = big or g > og) and 5 * least(n, on) >= 4 * greatest(n, on) and 9 * ({differ}) <= n + on").select("g", "n", "og", "on")


def simhash_pairs(heads: DataFrame, where: str) -> DataFrame:
    """(a, b) with a > b: sets whose 64-bit SimHash prints are equal or linked by deletion variants, each print by its least set."""
    of = common.cut(heads.groupBy("_fp").agg(F.min(F.struct(F.col("node").alias("g"), F.col("_n").alias("n"))).alias("least")), where, "prints")
    linked = simhash.links(of.select(F.col("_fp").alias("fp")), f"{where}/simhash")
    same = heads.join(of.hint("merge"), "_fp").select(F.struct(F.col("node").alias("g"), F.col("_n").alias("n")).alias("one"), F.col("least").alias("other")).filter("one.g <> other.g")
    near = linked.join(of.select(F.col("_fp").alias("a"), F.col("least").alias("one")).hint("merge"), "a").join(of.select(F.col("_fp").alias("b"), F.col("least").alias("other")).hint("merge"), "b").select("one", "other")
    sized = same.unionByName(near).filter(5 * F.least("one.n", "other.n") >= 4 * F.greatest("one.n", "other.n"))
    return sized.select(F.greatest("one.g", "other.g").alias("a"), F.least("one.g", "other.g").alias("b"))


def numbered(docs: DataFrame, where: str, file: str = "_file", at: str = "_at") -> DataFrame:
    """The rows with two columns by which they can be told apart in any later read.

    Rows read from files have a place there; others are written once.
    """
    try:
        found = docs.withColumn(file, F.xxhash64("_metadata.file_path")).withColumn(at, F.col("_metadata.row_index"))
        found.schema  # noqa: B018 - resolves the columns
        return found
    except AnalysisException:
        return common.cut(docs.withColumn(file, F.lit(0).cast("long")).withColumn(at, F.monotonically_increasing_id()), where, "numbered")


def deduplicated(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near copies of those that stay. The texts are shuffled once, to meet the rows that stay, and those of sets to compare before."""
    where = common.shared_dir(docs.sparkSession)
    columns = docs.columns
    file, at = common.unused(columns, "_file"), common.unused(columns, "_at")
    rows = numbered(docs, where, file, at)
    slim = rows.select(F.col(key).alias("key"), F.xxhash64(text).alias("h"), F.col(file).alias("_file"), F.col(at).alias("_at"), F.col(text).alias("text"))
    printed = prints(slim, frequent_shingles(slim, where))
    # Copies of a set are one row from here on; of each the first row is known.
    order = F.struct(F.col("key").isNull().alias("none"), "key", "h", "_file", "_at")
    heads = printed.groupBy("_p0", "_p1").agg(F.min(order).alias("best"), F.first("_n").alias("_n"), F.first("_fp").alias("_fp"), F.first("_s").alias("_s"), F.first("_keys").alias("_keys"), F.first("_late").alias("_late"))
    heads = common.cut(heads.withColumn("node", F.xxhash64("_p0", "_p1")), where, "heads")

    def sets_of(nodes: DataFrame, name: str) -> DataFrame:
        at = common.cut(heads.join(nodes.hint("merge"), "node", "left_semi").select("node", "best._file", "best._at"), where, f"wanted-{name}")
        place = F.pmod(F.xxhash64("_file", "_at"), F.lit(MAP_BITS))
        # At most MAP_BITS / 64 numbers come to the driver.
        bits = at.select(place.alias("p")).groupBy(F.floor(F.col("p") / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("bits")).toArrow()
        chosen = np.zeros(MAP_BITS // 64, np.int64)
        chosen[bits.column("word").to_numpy()] = bits.column("bits").to_numpy()
        chosen = chosen.view(np.uint64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = batch.column("_p").to_numpy()
                keep = pa.array(((chosen[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1)).astype(bool))
                batch = batch.filter(keep)
                sets = pa.array([shingles(v).view(np.int64) for v in batch.column("text").to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("_file"), batch.column("_at"), sets], names=["_file", "_at", "set"])

        some = common.mapped(slim.select("_file", "_at", "text", place.alias("_p")), run, "_file long, _at long, set array<long>", __name__)
        return common.cut(some.join(at.hint("merge"), ["_file", "_at"]).select("node", "set"), where, f"sets-{name}")

    placed = heads.select("node", "best").join(groups(heads.select("node", "_n", "_fp", "_s", "_keys", "_late"), sets_of, where).hint("merge"), "node", "left")
    stay = common.cut(placed.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best")).select("best._file", "best._at"), where, "stay")
    # Never a broadcast: what stays grows with the input.
    return rows.join(stay.toDF(file, at).hint("merge"), [file, at], "left_semi").select(*columns)
