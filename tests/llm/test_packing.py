"""Packing: the plan against best fit decreasing piece by piece, the pieces against the library, sequences without gaps."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.llm import packing, queries
from tesserae.llm.common import shared_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")


def best_fit_decreasing(lengths, capacity):
    """Rooms left in the sequences, with a scan of all of them for each piece."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits, key=rooms.__getitem__)] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 90).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=150))))
def test_plan(case):
    capacity, lengths = case
    counts = Counter(lengths)
    found, used = packing.plan(dict(counts), capacity)
    inside = defaultdict(list)
    for n, count in counts.items():
        own = [p for p in found if p.length == n]
        for rank in range(count):
            p = [p for p in own if p.rank <= rank][-1]
            inside[p.first + (rank - p.rank) // p.each].append((p.offset + (rank - p.rank) % p.each * n, n))
    rooms = []
    for k in range(used):
        at = 0
        for offset, n in sorted(inside[k]):
            assert offset == at
            at += n
        rooms.append(capacity - at)
    assert sorted(rooms) == best_fit_decreasing(lengths, capacity) and len(inside) == used


def test_rooms():
    rooms = packing.Rooms(100)
    assert rooms.tightest(1) is None
    for room in (70, 30, 31, 100):
        rooms.add(room, room, 1)
    assert [rooms.tightest(n) for n in (1, 30, 31, 32, 71, 100)] == [30, 30, 31, 70, 100, 100]
    assert rooms.take(31) == (31, 1) and rooms.tightest(31) == 70


def test_plan_does_not_grow_with_counts():
    many, _ = packing.plan({n: 10**9 + n for n in range(1, 1025)}, 1024)
    assert len(many) < 10_000


def check(found, docs, capacity):
    """Pieces are those of the documents, and fill their sequences from 0 on without a gap."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    wanted = Counter()
    for key, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        begin, stop, piece = 0, (len(ids) - 1) % capacity + 1, 0
        while begin < len(ids):
            wanted[key, piece, begin, stop - begin, zlib.crc32(ids[begin:stop].tobytes())] += 1
            begin, stop, piece = stop, stop + capacity, piece + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == wanted
    inside = defaultdict(list)
    for r in found:
        inside[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in inside.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    lengths = [r["length"] for r in found]
    assert len(inside) == len(best_fit_decreasing(lengths, capacity))


def test_query(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    check(queries.op13_best_fit_packing(spark, data).collect(), docs, 1024)


@pytest.mark.parametrize("capacity", [1, 7, 64])
def test_cases(spark, capacity):
    docs = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x"), (4, "one two three " * 900), *((k, "same text") for k in range(10, 300))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6).withColumn("offset", F.lit("clash")).withColumn("length", F.lit(-1))
    check(packing.pack(frame, PATH, shared_dir(spark), end=2, capacity=capacity).collect(), docs, capacity)


def test_nothing(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(nothing, PATH, shared_dir(spark), end=2).count() == 0
