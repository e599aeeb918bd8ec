"""A Merkle manifest of a dataset: a leaf for each row, trees of eight over groups of rows, a root, and every leaf's proof.

H is the lower-case hex SHA-256 of its inputs put together, digests as hex text. The leaves of a group stand in ascending
order; while there are several nodes, every FAN that follow each other (the last run may be shorter) become their H. The
roots of the groups, in the order of the groups' names, become the root of the dataset in the same way.

Nodes are kept in aligned blocks of FAN ** LEVELS, one row each, so that no task sees more of a tree than a block: a round
over the blocks makes their roots, and these are the nodes of the next round, until each group is one block. Paths go the
other way: in a block, `traversal` emits one after the other, and what lies above the block is appended to each.

A path is a list of strings, one for each level from below: the node's place in its run (one digit), then the digests of
the run's other nodes from left to right.

Defined cases: a null group is a group, the first one; null ids come first; equal (group, id) stand in the order of their
leaves; no rows give no rows. Columns other than those named are not read. Texts of any length are hashed by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm import common

FAN = 8
#: Levels of a block; it has FAN ** LEVELS nodes.
LEVELS = 3
BLOCK = FAN**LEVELS
WIDTH = 64

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def h(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(nodes: int) -> int:
    """Levels of a tree over so many nodes."""
    levels = 0
    while FAN**levels < nodes:
        levels += 1
    return levels


class Subtree:
    """A run of nodes of a level, grown leaf by leaf: a stack with at most FAN nodes for each level up to it."""

    def __init__(self, level: int):
        self.stack: list[list[str]] = [[] for _ in range(level + 1)]

    def add(self, leaf: str) -> None:
        node = leaf
        for low, run in enumerate(self.stack):
            run.append(node)
            if low + 1 == len(self.stack) or len(run) < FAN:
                return
            node = h(run)
            run.clear()

    def closed(self) -> list[str]:
        """The run, with what the last leaves left in the stack below it."""
        for run, above in zip(self.stack, self.stack[1:]):
            if run:
                above.append(h(run))
                run.clear()
        return self.stack[-1]


def root_of(leaves: Sequence[str], levels: int) -> str:
    """The node that so many levels make of the leaves."""
    whole = Subtree(levels)
    for leaf in leaves:
        whole.add(leaf)
    return whole.closed()[0]


def traversal(leaves: Sequence[str], levels: int) -> Iterator[list[str]]:
    """The paths of all leaves in order, by fractal traversal.

    On each level there are two stacked subtrees: the existing one, the run that the path goes through, and the desired
    one, the run after it, which grows by a leaf in each step and so is whole when the path gets there. What is held are
    2 * levels stacks of at most FAN * levels digests; leaves are asked for by number.
    """
    n = len(leaves)
    spans = [FAN ** (k + 1) for k in range(levels)]
    existing: list[list[str]] = []
    desired: list[Subtree] = []
    for k, span in enumerate(spans):
        first = Subtree(k)
        for leaf in leaves[:span]:
            first.add(leaf)
        existing.append(first.closed())
        desired.append(Subtree(k))
    path = [""] * levels
    stale = levels  # levels below this have another place or run than the last path
    for t in range(n):
        for k in range(stale):
            run, at = existing[k], t // FAN**k % FAN
            path[k] = f"{at}{''.join(run[:at])}{''.join(run[at + 1 :])}"
        yield list(path)
        stale = 1
        for k, span in enumerate(spans):
            ahead = t + span
            if ahead < n:
                desired[k].add(leaves[ahead])
            if (t + 1) % span == 0:
                existing[k], desired[k] = desired[k].closed(), Subtree(k)
                stale = k + 2
        stale = min(stale, levels)


def fold(node: str, path: Sequence[str]) -> str:
    """The root that a node and its path lead to."""
    for step in path:
        cut = 1 + WIDTH * int(step[0])
        node = h((step[1:cut], node, step[cut:]))
    return node


def proof_digest(path: Sequence[str]) -> str:
    return h([step[1:] for step in path])


def leaf(columns: list[str], text: str | None = None, changed: Column | None = None) -> Column:
    """H of the columns, each as `-` if null, else its size in bytes, a colon and the value; `changed` stands for column `text`."""

    def field(name: str) -> Column:
        value = changed if name == text else F.col(name).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(field, columns)), 256)


def numbered(rows: DataFrame, where: str, name: str) -> DataFrame:
    """(grp, id, digest, other) with `place`, a row's number in its group by (id, digest), and `total`, the rows of the group.

    One shuffle of the slim rows into ranges; no task has to hold a group. A range knows its rows' numbers, and the
    ranges' counts, summed over each group, tell where each begins.
    """
    # Rows that are equal in all are told apart by where they come from, so that many of them make no hot range.
    keyed = rows.withColumn("_from", F.monotonically_increasing_id())
    number = F.monotonically_increasing_id()
    ranges = keyed.repartitionByRange("grp", "id", "digest", "_from").sortWithinPartitions("grp", "id", "digest", "_from").drop("_from")
    held = common.cut(ranges.withColumn("_part", F.shiftright(number, 33)).withColumn("_nth", number.bitwiseAND((1 << 33) - 1)), where, name)
    counts = held.groupBy("grp", "_part").agg(F.min("_nth").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("grp")
    counts = counts.withColumn("_before", F.sum("_n").over(whole.orderBy("_part")) - F.col("_n") - F.col("_first")).withColumn("total", F.sum("_n").over(whole))
    begins = counts.select(F.col("grp").alias("_grp"), F.col("_part").alias("_p"), "_before", "total")
    joined = held.join(begins, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("_part") == F.col("_p")))
    return joined.select(*rows.columns, (F.col("_before") + F.col("_nth")).alias("place"), "total")


def _levels(total: int, most: int) -> int:
    return min(most, height(total))


def _batches(schema: T.StructType, make: Callable[[dict], Iterator[tuple]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow function that makes rows of each block's row, a batch for each block."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                columns = zip(*make(block), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return run


def blocks_of(nodes: DataFrame, where: str, name: str) -> DataFrame:
    """(grp, block, total, members, root): the nodes in aligned blocks, each with the node that it becomes."""
    number = F.expr(f"place div {BLOCK}")
    member = F.struct("place", *(c for c in nodes.columns if c not in ("grp", "place", "total")))
    held = nodes.groupBy("grp", "total", number.alias("block")).agg(F.sort_array(F.collect_list(member)).alias("members"))
    schema = T.StructType([*held.schema, T.StructField("root", T.StringType())])
    most = LEVELS

    def make(row: dict) -> Iterator[tuple]:
        yield (*row.values(), root_of([x["digest"] for x in row["members"]], _levels(row["total"], most)))

    return common.cut(common.mapped(held, _batches(schema, make), schema, __name__), where, name)


def trees(nodes: DataFrame, where: str, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The rounds of blocks from below, and (grp, root, round) of each group, with the round in which it is one block."""
    most = nodes.agg(F.max("total")).first()[0] or 0
    rounds = [blocks_of(nodes, where, f"{name}-0")]
    while most > BLOCK:
        above = rounds[-1].filter(F.col("total") > BLOCK).select("grp", F.col("root").alias("digest"), F.col("block").alias("place"), F.expr(f"(total - 1) div {BLOCK} + 1").alias("total"))
        rounds.append(blocks_of(above, where, f"{name}-{len(rounds)}"))
        most = -(-most // BLOCK)
    tops = [r.filter(F.col("total") <= BLOCK).select("grp", "root", F.lit(k).alias("round")) for k, r in enumerate(rounds)]
    return rounds, reduce(DataFrame.unionByName, tops)


def _emitted(blocks: DataFrame, upper: DataFrame, final: bool) -> DataFrame:
    """The blocks' nodes (grp, place) with their paths, subroot and root, or of leaves what `manifest` returns; upper has that of the blocks."""
    above = upper.select(F.col("grp").alias("_grp"), F.col("place").alias("_place"), "path", "subroot", F.col("root").alias("top"))
    met = blocks.select("grp", "block", "total", "members").join(above, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("block") == F.col("_place")))
    rows = met.select("total", "grp", "members", "path", "subroot", "top")
    text = lambda *names: [T.StructField(n, T.StringType()) for n in names]
    if final:
        schema = T.StructType([T.StructField("id", blocks.schema["members"].dataType.elementType["id"].dataType), *text("leaf", "subroot", "root", "proof_sha256", "folded_root")])
    else:
        schema = T.StructType([T.StructField("grp", blocks.schema["grp"].dataType), T.StructField("place", T.LongType()), T.StructField("path", T.ArrayType(T.StringType())), *text("subroot", "root")])

    most = LEVELS

    def make(row: dict) -> Iterator[tuple]:
        members, above = row["members"], row["path"]
        siblings = [s[1:] for s in above]
        tops: dict[str, str] = {}  # what lies above the block is folded once for each node that comes out of it
        for x, path in zip(members, traversal([x["digest"] for x in members], _levels(row["total"], most)), strict=True):
            if not final:
                yield row["grp"], x["place"], path + above, row["subroot"], row["top"]
                continue
            out = fold(x["other"] or x["digest"], path)
            if out not in tops:
                tops[out] = fold(out, above)
            yield x["id"], x["digest"], row["subroot"], row["top"], h([*(s[1:] for s in path), *siblings]), tops[out]

    return common.mapped(rows, _batches(schema, make), schema, __name__)


def unfolded(rounds: list[DataFrame], tops: DataFrame, final: bool = False) -> DataFrame:
    """From the groups' paths (grp, place 0, path, subroot, root, round) down to those of the lowest round's nodes."""
    at = lambda k: tops.filter(F.col("round") == k).drop("round")
    upper = at(len(rounds) - 1)
    for k in range(len(rounds) - 1, 0, -1):
        upper = _emitted(rounds[k], upper, False).unionByName(at(k - 1))
    return _emitted(rounds[0], upper, final)


def manifest(leaves: DataFrame, where: str) -> DataFrame:
    """(grp, id, digest, other) to (id, leaf, subroot, root, proof_sha256, folded_root): each leaf with its proof to the root.

    `other` is a digest to fold instead of the leaf's own, or null; folded_root is what it and the proof lead to.
    """
    rounds, roots = trees(numbered(common.cut(leaves, where, "leaves"), where, "numbered"), where, "rows")
    groups = roots.select(F.lit(0).alias("grp"), F.col("grp").alias("id"), F.col("root").alias("digest"), F.lit(None).cast("string").alias("other"), "round")
    heads = common.cut(numbered(groups, where, "groups"), where, "heads")
    over, whole = trees(heads.drop("round"), where, "heads")
    start = whole.select("grp", F.lit(0).cast("long").alias("place"), F.array().cast("array<string>").alias("path"), F.lit("").alias("subroot"), "root", "round")
    paths = unfolded(over, start).drop("grp", "subroot").join(heads.drop("grp"), "place")
    tops = paths.select(F.col("id").alias("grp"), F.lit(0).cast("long").alias("place"), "path", F.col("digest").alias("subroot"), "root", "round")
    return unfolded(rounds, common.cut(tops, where, "tops"), True)
