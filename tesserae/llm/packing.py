"""Best-fit packing of token sequences into sequences of one capacity.

Documents are encoded and cut into pieces of at most `capacity` ids, of which the first may be shorter. The pieces go into
sequences by best fit decreasing: the longest first, each into the open sequence with the least room that is enough for it,
found in a segment tree over remaining capacities. Pieces of equal length are interchangeable, and so are sequences with
equal room. So one plan over at most `capacity` lengths, with the count of pieces of each, is that of best fit decreasing
over all pieces, whatever their number; it is small (see `plan`). The pieces then find their places by their number among
those of their length, which needs no more than counts for each task and length: no task and no driver sees all pieces.

Defined cases: null and empty texts hold the end id alone; a null doc_id and repeated rows are documents like others; no
documents give no rows; columns other than key and text aren't read. Documents of equal length take their places in the
order in which the table is read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm import common, token_ids


class Rooms:
    """Open sequences by the room that they have left: a segment tree that finds the least room that is enough.

    Sequences are kept as ranges of their numbers.
    """

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.open = [0] * (2 * self.size)  # in each node, the rooms below it that some sequence has

    def _count(self, room: int, step: int) -> None:
        at = room + self.size
        while at:
            self.open[at] += step
            at //= 2

    def add(self, room: int, first: int, n: int) -> None:
        """Sequences `first` to `first + n - 1` have so much room; those without any aren't kept."""
        if room and n:
            if not self.ranges[room]:
                self._count(room, 1)
            self.ranges[room].append((first, n))

    def take(self, room: int) -> tuple[int, int]:
        found = self.ranges[room].pop()
        if not self.ranges[room]:
            self._count(room, -1)
        return found

    def tightest(self, length: int) -> int | None:
        """The least room of at least `length`."""
        at = length + self.size
        while not self.open[at]:
            while at & 1:  # a right child: all to the right of it lies higher
                at //= 2
            if not at:
                return None
            at += 1
        while at < self.size:
            at *= 2
            at += not self.open[at]
        return at - self.size


@dataclass(frozen=True)
class Placed:
    """Pieces of a length from number `rank` on: `each` in every sequence from `first` on, the first of them at `offset`."""

    length: int
    rank: int
    first: int
    each: int
    offset: int


def plan(counts: dict[int, int], capacity: int) -> tuple[list[Placed], int]:
    """Best fit decreasing over so many pieces of each length; the placements by length and rank, and the number of sequences.

    A length opens at most two ranges of sequences and splits at most one in three, so there are at most 4 * capacity
    ranges; a range takes at most sqrt(2 * capacity) different lengths. For 1024 that bounds the placements at 190,000
    whatever the counts; in practice there are some thousands.
    """
    rooms, out, used = Rooms(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank, end = 0, counts[length]
        while rank < end:
            room = rooms.tightest(length)
            if room is None:
                room, first = capacity, used
                n = -(-(end - rank) // (capacity // length))
                used += n
            else:
                first, n = rooms.take(room)
            each = room // length  # the sequence stays the tightest one until it's full
            full = min(n, (end - rank) // each)
            rest = end - rank - full * each if full < n else 0
            out.append(Placed(length, rank, first, each, capacity - room))
            rooms.add(room - each * length, first, full)
            if rest:
                rooms.add(room - rest * length, first + full, 1)
            rooms.add(room, first + full + (rest > 0), n - full - (rest > 0))
            rank += full * each + rest
    return sorted(out, key=lambda p: (p.length, p.rank)), used


def pieces(docs: DataFrame, tokenizer: str, *, end: int, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of each document (doc_id, piece, start, length, ids_crc32), with `task` and `nth`, the number of the piece among those of its length that the task made."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, last, task = token_ids.encoder(tokenizer), end.to_bytes(4, "little"), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            rows = []
            found, edges = encode.many(pc.fill_null(batch.column(1), ""), last)
            held = memoryview(found.view(np.uint8))
            for name, a, b in zip(batch.column(0).to_pylist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                ids, n = held[4 * a : 4 * b], b - a
                begin, stop = 0, (n - 1) % capacity + 1
                for piece in range(-(-n // capacity)):
                    size = stop - begin
                    rows.append((name, piece, begin, size, zlib.crc32(ids[4 * begin : 4 * stop]), task, seen[size]))
                    seen[size] += 1
                    begin, stop = stop, stop + capacity
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    slim = docs.select(F.col(key).cast("long"), F.col(text))
    return common.mapped(slim, run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long", __name__)


def placed(numbered: DataFrame, found: list[Placed]) -> DataFrame:
    """Pieces with their `rank` among those of their length: the sequence and the offset that the plan has for them."""
    first_of: dict[int, int] = {}
    for k, p in enumerate(found):
        first_of.setdefault(p.length, k)
    lengths = sorted(first_of)
    starts = np.array([first_of[n] for n in lengths] + [len(found)])
    rank, first, each, offset = (np.array([getattr(p, name) for p in found], np.int64) for name in ("rank", "first", "each", "offset"))
    names = [*numbered.columns, "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.empty(len(length), np.int64)
            for n in np.unique(length):
                k = bisect_right(lengths, n) - 1
                rows = length == n
                at[rows] = starts[k] + np.searchsorted(rank[starts[k] : starts[k + 1]], number[rows], "right") - 1
            step = number - rank[at]
            sequence, place = first[at] + step // each[at], offset[at] + step % each[at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(place)], names=names)

    return common.mapped(numbered, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema) + ", sequence_id long, offset long", __name__)


def pack(docs: DataFrame, tokenizer: str, where: str, *, end: int, capacity: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece; sequences are numbered from 0."""
    cut = common.cut(pieces(docs, tokenizer, end=end, capacity=capacity, key=key, text=text), where, "pieces")
    counts = common.cut(cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), where, "counts")
    found, _ = plan(dict(map(tuple, counts.groupBy("length").agg(F.sum("n")).collect())), capacity)  # a row for each length: `capacity` at most
    before = counts.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    numbered = cut.join(before, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return placed(numbered, found).drop("rank")
