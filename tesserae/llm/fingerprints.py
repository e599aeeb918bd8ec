"""Document fingerprints by a randomised edit embedding (Chakraborty, Goldenberg and Koucký).

A walk reads a text character by character; at step j it stays on its character or moves to the next one, by a random
bit that depends only on j and the character and is the same for all texts. Texts a small edit distance apart soon walk
in step again, so what the walks see at the same steps differs in few places: edit distance becomes Hamming distance.

The fingerprint samples that sequence: of steps 0 to 15 all, then 16 fixed random steps of each doubling [2^k, 2^(k+1)),
and writes for each a byte of the four characters at the walk's place, 00 past the end. `likeness` compares two
fingerprints step by step, each doubling weighted by its length, and so estimates the share of steps at which both walks
see the same. `classes` cuts fingerprints into bands of sampled steps, joins on equal bands and verifies each link by likeness.

Defined results: a null text counts as empty; the empty text's fingerprint is the empty string, and two of them have
likeness 1 and are one class; equal texts have equal fingerprints; texts may be of any length, in linear time; documents with equal ids are ordered by a hash of the text, a null id
comes last; repeated rows give a row each; the next document of a single document is itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm import common, simhash

#: Sampled steps of each doubling.
SAMPLES = 16
#: Steps after which the shared random bits begin anew.
PERIOD = 8192
#: Text bytes of a range of documents, about, and characters that are walked at once.
RANGE_BYTES = 8 << 20
GROUP_CHARS = 4 << 20
#: Texts of about one length from which they are walked side by side.
SIDE_BY_SIDE = 40

_LEAST = -(1 << 63)


def _waits() -> np.ndarray:
    """How many steps a walk that comes to a character at a step stays there, by step modulo PERIOD and character hash."""
    moves = np.random.Generator(np.random.PCG64(20240607)).random((PERIOD, 256)) < 0.5
    waits = np.zeros((PERIOD, 256), np.int64)
    ahead = np.full(256, 1)
    for _ in range(2):  # the second round knows what follows the last step
        for j in range(PERIOD - 1, -1, -1):
            ahead = np.where(moves[j], 1, np.minimum(ahead + 1, 255))
            waits[j] = ahead
    return waits.astype(np.uint8).ravel()


def _steps(levels: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(77))
    parts = [np.arange(SAMPLES)]
    for k in range(levels - 1):
        parts.append(np.sort(rng.choice(SAMPLES << k, SAMPLES, replace=False)) + (SAMPLES << k))
    return np.concatenate(parts).astype(np.int64)


class Walker:
    """Fingerprints of many texts at a time."""

    def __init__(self) -> None:
        self.waits = _waits()
        self.table = self.waits.tobytes()
        self.steps = _steps(26)

    def __call__(self, texts: list[str]) -> list[bytes]:
        codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
        out: list[bytes] = [b""] * len(texts)
        order = sorted(range(len(texts)), key=lambda k: -len(codes[k]))
        while order and not len(codes[order[-1]]):
            order.pop()
        at = 0
        while at < len(order):
            most = len(codes[order[at]])
            end = at + 1
            while end < len(order) and 2 * len(codes[order[end]]) >= most and (end - at) * most < GROUP_CHARS:
                end += 1
            group = order[at:end]
            arrivals = self._together([codes[k] for k in group]) if len(group) >= SIDE_BY_SIDE else map(self._alone, (codes[k] for k in group))
            for k, steps in zip(group, arrivals, strict=True):
                out[k] = self._sampled(codes[k], steps)
            at = end
        return out

    def _hashed(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8)

    def _together(self, codes: list[np.ndarray]) -> np.ndarray:
        """The step at which each walk comes to each character, and its end: a row for each text, longest first."""
        sizes = np.array([len(c) for c in codes])
        grid = np.zeros((len(codes), sizes[0]), np.uint8)
        for k, c in enumerate(codes):
            grid[k, : len(c)] = self._hashed(c)
        grid = np.ascontiguousarray(grid.T)
        steps = np.zeros((sizes[0] + 1, len(codes)), np.int32)
        # How many texts still have a character at each place.
        live = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left").tolist()
        place = np.empty(len(codes), np.int32)
        wait = np.empty(len(codes), np.uint8)
        for i, n in enumerate(live):
            p, w = place[:n], wait[:n]
            np.bitwise_and(steps[i, :n], PERIOD - 1, out=p)
            np.left_shift(p, 8, out=p)
            np.bitwise_or(p, grid[i, :n], out=p)
            np.take(self.waits, p, out=w, mode="clip")
            np.add(steps[i, :n], w, out=steps[i + 1, :n])
        return np.ascontiguousarray(steps.T)

    def _alone(self, codes: np.ndarray) -> np.ndarray:
        table, step = self.table, 0
        out = [0]
        add = out.append
        for c in self._hashed(codes).tobytes():
            step += table[((step & 8191) << 8) | c]
            add(step)
        return np.array(out, np.int64)

    def _sampled(self, codes: np.ndarray, steps: np.ndarray) -> bytes:
        n = len(codes)
        steps = steps[: n + 1]
        last = int(steps[n])
        levels = max(1, (last - 1).bit_length() - (SAMPLES.bit_length() - 1) + 1)
        wanted = self.steps[: SAMPLES * levels]
        at = np.searchsorted(steps, wanted, side="right") - 1
        inside = at < n
        at = at[inside]
        gram = np.zeros(len(at), np.uint64)
        for k in range(4):
            here = at + k
            gram = (gram + np.where(here < n, codes[np.minimum(here, n - 1)], 0).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        out = np.zeros(SAMPLES * levels, np.uint8)
        out[inside] = (gram >> np.uint64(40)) % np.uint64(255) + np.uint64(1)
        return out.tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The estimated share of steps, of those where either text goes on, at which both walks see the same: 0 to 1."""
    if a == b:
        return 1.0
    size = max(len(a), len(b))
    x = np.zeros(size, np.uint8)
    y = np.zeros(size, np.uint8)
    x[: len(a)] = np.frombuffer(a, np.uint8)
    y[: len(b)] = np.frombuffer(b, np.uint8)
    weights = np.repeat(2.0 ** np.maximum(0, np.arange(size // SAMPLES) - 1), SAMPLES)
    there = (x > 0) | (y > 0)
    return float(((x == y) & there) @ weights / (there @ weights))


def walker() -> Walker:
    own = common.held(__name__)
    if "walker" not in own:
        own["walker"] = Walker()
    return own["walker"]


def edited(text: str, after: str) -> str:
    """The text with its last third replaced by as many of the first characters of `after`."""
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


def with_next(docs: DataFrame, *, key: str = "doc_id", text: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows dealt to ranges of ids, each sorted by descending id, each followed by the row that comes after it (halo = 1).

    One shuffle of the texts. A range's last row is followed by the first row of the next range that has any, the very
    last row by the very first; only the ids of those rows, one for each range, come to the driver.
    """
    name = F.coalesce(F.col(key).cast("long"), F.lit(_LEAST))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), name.alias("place"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    slim = docs.select(name.alias("place"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("size"))
    cuts = common.range_cuts(slim, "place", "size", range_bytes)
    where = common.range_of("place", cuts)
    first = {r[0]: r[1] for r in slim.groupBy(where.alias("part")).agg(F.max("place")).collect()}
    parts = sorted(first)
    halo = [(first[p], parts[(k + 1) % len(parts)]) for k, p in enumerate(parts)]
    # The first row of range p follows the last row of the next higher range.
    goes_to = common.lookup("place", sorted(halo))
    return (
        rows.withColumn("part", where)
        .withColumn("_to", F.when(goes_to.isNull(), F.array(F.struct(F.col("part").alias("p"), F.lit(0).alias("h")))).otherwise(F.array(F.struct(F.col("part").alias("p"), F.lit(0).alias("h")), F.struct(goes_to.alias("p"), F.lit(1).alias("h")))))
        .select("doc_id", "place", "text", F.explode("_to").alias("_t"))
        .select("doc_id", "place", "text", F.col("_t.p").alias("part"), F.col("_t.h").alias("halo"))
        .repartitionById(len(cuts) + 1, F.col("part"))
        .sortWithinPartitions("part", "halo", F.desc("place"), F.xxhash64("text"), "text")
    )


def compare_edits(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document (descending id)."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    )

    def report(held: list[tuple], after: str) -> pa.RecordBatch:
        texts = [t for _, t in held] + [after]
        changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        prints = walker()(texts + changed)
        own, new = prints[: len(texts)], prints[len(texts) :]
        columns = [
            [k for k, _ in held],
            [len(t) for t in texts[:-1]],
            [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
            [x.hex() for x in own[:-1]],
            [x.hex() for x in new],
            [likeness(a, b) for a, b in zip(own, new, strict=False)],
            [likeness(a, b) for a, b in zip(own, own[1:], strict=False)],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, part, done = 0, None, False
        for batch in batches:
            for k, value, p, halo in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "text", "part", "halo")), strict=True):
                if p != part:
                    part, done = p, False
                if halo:
                    if not done and held:
                        yield report(held, value)
                    held, size, done = [], 0, True
                    continue
                if size > GROUP_CHARS:
                    yield report(held, value)
                    held, size = [], 0
                held.append((k, value))
                size += len(value)

    return common.mapped(with_next(docs, key=key, text=text), run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double", __name__)


def fingerprint(docs: DataFrame, *, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """The documents with their fingerprint, in hex, added. One narrow pass."""
    docs = docs.drop(into) if into in docs.columns else docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.hex() for x in walker()([v or "" for v in batch.column(text).to_pylist()])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, into])

    return common.mapped(docs, run, T.StructType([*docs.schema.fields, T.StructField(into, T.StringType())]), __name__)


#: Sampled steps in a band, and bands of each of the two doublings that are cut into bands.
BAND = 4
BANDS = 5
#: Members of a band that all others are compared with first.
LEADERS = 6


def _bands() -> list[list[int]]:
    """Which of a doubling's sampled steps stand in each band: fixed random draws."""
    rng = np.random.Generator(np.random.PCG64(5))
    return [sorted(rng.choice(SAMPLES, BAND, replace=False).tolist()) for _ in range(BANDS)]


def classes(prints: DataFrame, where: str, *, threshold: float = 0.8) -> DataFrame:
    """(fingerprint, class_id) for rows (doc_id, fingerprint): what links reach. Linked are fingerprints that share a band of sampled
    steps of the doublings that hold most of a text, and have `threshold` likeness.

    Equal fingerprints are one row from the start. A first round compares a band's members with its least and greatest, a second one
    those of different groups that it leaves, a band's largest group with the others only; within a group no link changes it. So no link
    is lost, and a large group costs comparisons in proportion to its size.
    """
    heads = _numbered(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("head")).withColumn("node", F.xxhash64("fingerprint")))
    heads = common.cut(heads, where, "heads")
    size = 2 * SAMPLES
    # The two doublings below the last, of short texts the last; texts of about one length share one at least.
    places = ", ".join("concat(" + ", ".join(f"substring(fingerprint, 1 + l * {size} + {2 * k}, 2)" for k in band) + ")" for band in _bands())
    level = f"cast(length(fingerprint) / {size} as int)"
    bands = F.expr(f"flatten(transform(array_distinct(array(greatest(0, {level} - 3), greatest(0, {level} - 2))), l -> transform(array({places}), (x, b) -> struct(xxhash64(l, b, x) as key, l as level))))")
    keyed = heads.filter("fingerprint <> ''").select("node", F.explode(bands).alias("k")).select("node", "k.key", "k.level")
    some = [F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node")).alias(f"h{k}") for k in range(LEADERS - 2)]
    ends = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), *some).filter("low <> high")
    ends = ends.select("key", F.array_distinct(F.array("low", "high", *(f"h{k}.node" for k in range(LEADERS - 2)))).alias("leads"))
    met = common.cut(keyed.join(ends, "key"), where, "met")
    held = heads.select("node", "fingerprint")

    def links(pairs: DataFrame, name: str) -> DataFrame:
        pairs = common.cut(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), where, f"pairs-{name}")
        both = pairs.join(held.toDF("a", "fingerprint"), "a").join(held.toDF("b", "other"), "b")
        return common.cut(_verified(both, threshold).select("a", "b"), where, f"links-{name}")

    first = links(met.select(F.col("node").alias("a"), F.explode("leads").alias("b")), "first")
    rooted = met.select("key", "level", "node").join(simhash.roots(first, f"{where}/first"), "node", "left").select("key", "level", "node", F.coalesce("root", "node").alias("root"))
    rooted = common.cut(rooted, where, "rooted")
    sizes = rooted.groupBy("key", "root").count().groupBy("key").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("count", "root")).alias("big"))
    apart = rooted.join(sizes.filter("roots > 1").select("key", F.col("big.root").alias("big")), "key")
    # What is sampled from the band's doubling on rules most of the rest out quickly, and the whole fingerprint all that aren't near.
    numbers = [F.coalesce(F.get("numbers", 2 * F.col("level") + k), F.lit(0).cast("long")).alias(f"s{k}") for k in range(6)]
    apart = common.cut(apart.join(heads.select("node", "numbers"), "node").select("key", "level", "node", "root", "big", "numbers", *numbers), where, "apart")
    own = ["numbers", *(f"s{k}" for k in range(6))]
    small = apart.filter("root <> big").select("key", F.col("node").alias("a"), "root", *own)
    others = apart.select("key", "level", F.col("node").alias("b"), F.col("root").alias("other"), "big", *(F.col(c).alias(f"o{c}") for c in own))
    again = small.join(others, "key").filter(f"root <> other and (other = big or a > b) and (level = 0 or {_may_be_near(threshold)}) and {_near(threshold)}").select("a", "b")
    tops = simhash.roots(first.unionByName(links(again, "second")), f"{where}/second")
    placed = common.cut(heads.join(tops, "node", "left").select("fingerprint", "head", F.coalesce("root", "node").alias("root")), where, "placed")
    named = placed.groupBy("root").agg(F.min("head").alias("class_id"), F.count(F.lit(1)).alias("n"))
    most = max(1.0, 0.001 * placed.count())
    return common.cut(common.join_heavy(placed.select("fingerprint", "root"), named, ["root"], "n", most, ["class_id"]).select("fingerprint", "class_id"), where, "classes")


def _numbered(heads: DataFrame) -> DataFrame:
    """With the fingerprint as numbers, two for each doubling."""
    schema = T.StructType([*heads.schema.fields, T.StructField("numbers", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [np.frombuffer(bytes.fromhex(v), "<i8") for v in batch.column("fingerprint").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.list_(pa.int64()))], names=schema.names)

    return common.mapped(heads, run, schema, __name__)


def _bytes(x: str) -> str:
    """How many bytes of a number aren't zero: each one's bits are laid over its lowest."""
    return f"bit_count(({' | '.join(f'shiftrightunsigned({x}, {k})' for k in range(8))}) & {0x0101010101010101}L)"


def _near(threshold: float) -> str:
    """`likeness` of the fingerprints of which `numbers` and `onumbers` hold all, against the threshold."""
    both = "zip_with(numbers, onumbers, (x, y) -> named_struct('differ', coalesce(x, 0L) ^ coalesce(y, 0L), 'there', coalesce(x, 0L) | coalesce(y, 0L)))"
    share = f"{1 - threshold + 1e-9}D * {_bytes('p.there')} - {_bytes('p.differ')}"
    return f"aggregate(transform({both}, (p, i) -> shiftleft(1L, greatest(0, i div 2 - 1)) * ({share})), 0D, (s, x) -> s + x) >= 0"


def _may_be_near(threshold: float) -> str:
    """Whether two fingerprints, of which s0 to s5 and os0 to os5 hold a doubling and the two after it, may have `threshold` likeness.

    What came before that doubling weighs as much as it does, and is taken to be equal.
    """
    differ = [f"({_bytes(f'(s{2 * k} ^ os{2 * k})')} + {_bytes(f'(s{2 * k + 1} ^ os{2 * k + 1})')})" for k in range(3)]
    there = [f"({_bytes(f'(s{2 * k} | os{2 * k})')} + {_bytes(f'(s{2 * k + 1} | os{2 * k + 1})')})" for k in range(3)]
    weighed = lambda x: f"({x[0]} + 2 * {x[1]} + 4 * {x[2]})"
    return f"{weighed(differ)} <= {1 - threshold + 1e-9} * ({SAMPLES} + {weighed(there)})"


def near_classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """(doc_id, class_id): the smallest id of the documents that `classes` puts together; null ids count last."""
    where = common.shared_dir(docs.sparkSession)
    prints = common.cut(fingerprint(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))).drop("text"), where, "prints")
    return with_classes(prints, where, threshold=threshold).select("doc_id", "class_id")


def with_classes(prints: DataFrame, where: str, *, threshold: float = 0.8) -> DataFrame:
    """The rows, read several times, with class_id added."""
    counts = prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))
    of = classes(prints.select("doc_id", "fingerprint"), where, threshold=threshold).join(counts, "fingerprint")
    return common.join_heavy(prints, common.cut(of, where, "of"), ["fingerprint"], "n", max(1.0, 0.001 * prints.count()), ["class_id"])


def _verified(pairs: DataFrame, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [likeness(bytes.fromhex(a), bytes.fromhex(b)) >= threshold for a, b in zip(batch.column("fingerprint").to_pylist(), batch.column("other").to_pylist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return common.mapped(pairs, run, pairs.schema, __name__)
