"""Ranked lexical search for a batch of queries, by block-max pruning over document ranges.

Terms are the maximal runs of letters, digits and characters beyond ASCII; only A-Z are lower-cased. N counts the documents
with a term, L all their terms, n a document's terms, tf a term's occurrences in it, df the documents that hold it. A term
weighs floor(1000 * ln((2N + 2) / (2 df + 1))), and a document's score is the sum, over the query's different terms, of the
weight times (10**9 * tf) div (1000 * tf + 8 * m), its impact, with m = 10 + (90 * n * N) div L; all of it in integers.

1. `forward`: each document's terms, of those that the queries have, with their counts. N, L and df are sums over all rows.
2. `blocks`: documents in ranges of doc_id, BLOCK_DOCS of them in a block with the forward index of their impacts and, for each
   term, the largest impact in the block.
3. `thresholds`: a query's bound on a block is the sum of weights times largest impacts. The few blocks with the highest
   bounds over the whole table are scored first, which gives each query a score that its k-th best document reaches.
4. `best`: every task sorts its blocks by bound, for each query, and scores them until the bound falls below the k-th best
   score so far. The tasks' best are then ranked together.

A task holds a batch of blocks and k results a query. Scores are whole numbers below 2 ** 53, so that sums in doubles are exact.

Defined cases: null and empty texts have no terms and aren't counted in N; a query without terms has no results; a null
doc_id comes after all others among equal scores; repeated rows are documents, or queries, of their own; no documents or no
queries give no rows; columns other than key and text aren't read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from tesserae.llm import common

BLOCK_DOCS = 64
#: Blocks that are scored first for each query.
SEEDS = 4
#: Different terms, and queries, of a batch at most (one query's terms may be more); what is more is searched for in further batches.
MOST_TERMS = 1_000_000
MOST_QUERIES = 20_000

#: Of each byte of UTF-8: what is part of a term, lower-cased; a space for all else.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LAST = (1 << 63) - 1


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(_LETTERS).split() if text else []


@dataclass(frozen=True)
class Batch:
    """Queries with the terms that they ask for, numbered over the batch."""

    rows: list[Row]
    vocabulary: dict[bytes, int]
    asked: list[np.ndarray]  # each query's terms, ascending


def batches(queries: DataFrame, text: str, most_terms: int, most_queries: int) -> Iterator[Batch]:
    """The queries in batches of bounded size, read one after the other."""
    rows: list[Row] = []
    vocabulary: dict[bytes, int] = {}
    asked: list[np.ndarray] = []
    for row in queries.toLocalIterator():
        own = set(terms((row[text] or "").encode()))
        if rows and (len(rows) == most_queries or len(vocabulary) + len(own) > most_terms):
            yield Batch(rows, vocabulary, asked)
            rows, vocabulary, asked = [], {}, []
        if own:
            rows.append(row)
            asked.append(np.array(sorted(vocabulary.setdefault(t, len(vocabulary)) for t in sorted(own)), np.int32))
    if rows:
        yield Batch(rows, vocabulary, asked)


def forward(docs: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document with a term: the number of its terms, and those of the vocabulary, ascending."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])
    slim = docs.filter(F.col(text) != "").select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # MOST_TERMS at most

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in found:
            keys, sizes, ids, tfs, ends = [], [], [], [], [0]
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = terms(value.as_py())
                if words:
                    counts = Counter(map(number, words))
                    counts.pop(None, None)
                    keys.append(name)
                    sizes.append(len(words))
                    own = sorted(counts)
                    ids.extend(own)
                    tfs.extend(map(counts.__getitem__, own))
                    ends.append(len(ids))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (ids, tfs)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), *lists], schema=schema)

    return common.mapped(slim, run, "doc_id long, n long, terms array<int>, tfs array<int>", __name__)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values, and where each row's begin and the last's end."""
    ends = column.offsets.to_numpy()
    return column.flatten().to_numpy(), ends - ends[0]


def weights(index: DataFrame, n_terms: int, total: int) -> np.ndarray:
    """The weight of each term of the vocabulary, by its df over all documents."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in found:
            df += np.bincount(_flat(batch.column(0))[0], minlength=n_terms)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array(held.astype(np.int32)), "df": pa.array(df[held])})

    counted = common.mapped(index.select("terms"), run, "term int, df long", __name__).groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    out = np.zeros(n_terms)
    # In Python's doubles; a term that no document holds has no impact either.
    out[counted["term"].to_numpy()] = [math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1))) for df in counted["df"].tolist()]
    return out


@dataclass(frozen=True)
class Block:
    """Documents of a range: their ids, and the terms that occur (`local` numbers of `terms`) with their impacts, document after document."""

    docs: np.ndarray
    begins: np.ndarray
    local: np.ndarray
    impacts: np.ndarray
    terms: np.ndarray
    maxima: np.ndarray

    def scores(self, asked: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Each document's score."""
        at = np.searchsorted(self.terms, asked)
        held = at < len(self.terms)
        at, asked = at[held], asked[held]
        same = self.terms[at] == asked
        own = np.zeros(len(self.terms))
        own[at[same]] = weight[asked[same]]
        return np.add.reduceat(own[self.local] * self.impacts, self.begins)


_BLOCK = "block long, docs binary, begins binary, local binary, impacts binary, terms binary, maxima binary"
_KINDS = {"docs": "<i8", "begins": "<i4", "local": "<i4", "impacts": "<i4", "terms": "<i4", "maxima": "<i4"}


def blocks(index: DataFrame, total: int, length: int) -> DataFrame:
    """The index in blocks of BLOCK_DOCS documents in ranges of doc_id, numbered apart over all tasks."""
    # Equal ids are told apart by where they come from, so that many rows of one id make no hot range.
    keyed = index.filter(F.size("terms") > 0).withColumn("_from", F.monotonically_increasing_id())
    ranges = keyed.repartitionByRange("doc_id", "_from").sortWithinPartitions("doc_id", "_from").select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc_id"), "n", "terms", "tfs")

    def made(ids: np.ndarray, n: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]]) -> dict[str, np.ndarray]:
        (flat, ends), (tfs, _) = lists
        m = 10 + (90 * n * total) // length
        tf = tfs.astype(np.int64)
        impacts = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, np.diff(ends)))
        held, local = np.unique(flat, return_inverse=True)
        maxima = np.zeros(len(held), np.int64)
        np.maximum.at(maxima, local, impacts)
        return {"docs": ids, "begins": ends[:-1], "local": local, "impacts": impacts, "terms": held, "maxima": maxima}

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        rest = None
        for batch in found:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            whole = table.num_rows - table.num_rows % BLOCK_DOCS
            yield from packed(table.slice(0, whole), number)
            number += whole // BLOCK_DOCS
            rest = table.slice(whole).combine_chunks().to_batches()[0] if whole < table.num_rows else None
        if rest is not None:
            yield from packed(pa.Table.from_batches([rest]), number)

    def packed(table: pa.Table, number: int) -> Iterator[pa.RecordBatch]:
        for begin in range(0, table.num_rows, BLOCK_DOCS):
            part = table.slice(begin, BLOCK_DOCS).combine_chunks().to_batches()[0]
            block = made(part.column(0).to_numpy(), part.column(1).to_numpy(), [_flat(part.column(2)), _flat(part.column(3))])
            yield pa.RecordBatch.from_pydict({"block": [number + begin // BLOCK_DOCS]} | {name: [block[name].astype(kind).tobytes()] for name, kind in _KINDS.items()})

    return common.mapped(ranges, run, _BLOCK, __name__)


def _block(row: dict) -> Block:
    return Block(**{name: np.frombuffer(row[name], kind) for name, kind in _KINDS.items()})


@dataclass(frozen=True)
class Asked:
    """What tasks need to know of a batch: each query's terms and all terms' weights."""

    queries: list[np.ndarray]
    weight: np.ndarray

    def bounds(self, maxima: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """A row for each query: its bounds on the blocks, given by their terms and largest impacts."""
        held = np.unique(np.concatenate([t for t, _ in maxima]))
        grid = np.zeros((len(held), len(maxima)))
        for k, (own, most) in enumerate(maxima):
            grid[np.searchsorted(held, own), k] = most
        out = np.zeros((len(self.queries), len(maxima)))
        for q, asked in enumerate(self.queries):
            at = np.searchsorted(held, asked)
            at, of = at[at < len(held)], asked[at < len(held)]
            same = held[at] == of
            out[q] = self.weight[of[same]] @ grid[at[same]]
        return out


class Best:
    """The k best of what was seen, by score and then by least id."""

    def __init__(self, k: int, least: float):
        self.k, self.least = k, least  # scores below `least` aren't wanted
        self.scores, self.docs = np.zeros(0), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        wanted = scores >= max(self.least, 1)
        if wanted.any():
            scores, docs = np.concatenate([self.scores, scores[wanted]]), np.concatenate([self.docs, docs[wanted]])
            order = np.lexsort((docs, -scores))[: self.k]
            self.scores, self.docs = scores[order], docs[order]
            if len(order) == self.k:
                self.least = self.scores[-1]


def _rows(best: dict[int, Best]) -> pa.RecordBatch:
    filled = {q: b for q, b in best.items() if len(b.docs)}
    return pa.RecordBatch.from_pydict({
        "query": pa.array(np.repeat(np.array([*filled], np.int32), [len(b.docs) for b in filled.values()])),
        "doc_id": pa.array(np.concatenate([np.zeros(0, np.int64), *(b.docs for b in filled.values())])),
        "score": pa.array(np.concatenate([np.zeros(0), *(b.scores for b in filled.values())]).astype(np.int64)),
    })


_FOUND = "query int, doc_id long, score long"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("doc_id")))).filter(F.col("rank") <= k)


def thresholds(held: DataFrame, asked: Asked, k: int) -> np.ndarray:
    """A score of each query that at least k documents reach, from the SEEDS blocks with its highest bounds; 0 if there are fewer."""

    def highest(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = (len(asked.queries), 0)
        names, bounds = np.zeros(shape, np.int64), np.zeros(shape)
        for batch in found:
            here = asked.bounds([(np.frombuffer(t, "<i4"), np.frombuffer(m, "<i4")) for t, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)])
            bounds = np.concatenate([bounds, here], axis=1)
            names = np.concatenate([names, np.broadcast_to(batch.column(0).to_numpy(), here.shape)], axis=1)
            order = np.argsort(-bounds, axis=1, kind="stable")[:, :SEEDS]
            bounds, names = np.take_along_axis(bounds, order, 1), np.take_along_axis(names, order, 1)
        q, _ = np.nonzero(bounds > 0)
        yield pa.RecordBatch.from_pydict({"query": pa.array(q.astype(np.int32)), "doc_id": pa.array(names[bounds > 0]), "score": pa.array(bounds[bounds > 0].astype(np.int64))})

    tops = _ranked(common.mapped(held.select("block", "terms", "maxima"), highest, _FOUND, __name__), SEEDS)
    chosen = tops.groupBy(F.col("doc_id").alias("block")).agg(F.sort_array(F.collect_list("query")).alias("queries"))

    def scored(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            best: dict[int, Best] = {}
            for row in batch.to_pylist():
                block = _block(row)
                for q in row["queries"]:
                    best.setdefault(q, Best(k, 0)).add(block.scores(asked.queries[q], asked.weight), block.docs)
            yield _rows(best)

    out = np.zeros(len(asked.queries))
    # Few blocks are chosen, SEEDS for each of MOST_QUERIES at most, so the blocks themselves aren't shuffled.
    reached = _ranked(common.mapped(held.join(F.broadcast(chosen), "block"), scored, _FOUND, __name__), k)
    for row in reached.filter(F.col("rank") == k).select("query", "score").collect():  # one row a query
        out[row["query"]] = row["score"]
    return out


def best(held: DataFrame, asked: Asked, least: np.ndarray, k: int) -> DataFrame:
    """(query, doc_id, score, rank): blocks by descending bound, until the bound is below the k-th best score."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {q: Best(k, least[q]) for q in range(len(asked.queries))}
        for batch in found:
            here = [_block(row) for row in batch.to_pylist()]
            bounds = asked.bounds([(b.terms, b.maxima) for b in here])
            for q, tops in enumerate(bounds):
                for b in np.argsort(-tops, kind="stable"):
                    if tops[b] < max(own[q].least, 1):
                        break
                    own[q].add(here[b].scores(asked.queries[q], asked.weight), here[b].docs)
        yield _rows(own)

    return _ranked(common.mapped(held, run, _FOUND, __name__), k)


def search(docs: DataFrame, queries: DataFrame, where: str, *, k: int = 10, key: str = "doc_id", text: str = "text", query_key: str = "item_id", query_text: str = "text", most_terms: int = MOST_TERMS, most_queries: int = MOST_QUERIES) -> DataFrame:
    """The k best documents with a score above 0 for each query: the query's key, rank from 1, doc_id and score."""
    spark = docs.sparkSession
    kind = queries.schema[query_key].dataType.simpleString()
    out = []
    for number, batch in enumerate(batches(queries.select(query_key, query_text), query_text, most_terms, most_queries)):
        index = common.cut(forward(docs, batch.vocabulary, key, text), where, f"forward-{number}")
        total, length = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(1))).first()
        asked = Asked(batch.asked, weights(index, len(batch.vocabulary), total))
        held = common.cut(blocks(index, total, length), where, f"blocks-{number}")
        found = best(held, asked, thresholds(held, asked, k), k)
        names = spark.createDataFrame([(q, row[query_key]) for q, row in enumerate(batch.rows)], f"query int, {query_key} {kind}")
        out.append(found.join(F.broadcast(names), "query").select(query_key, "rank", F.nullif("doc_id", F.lit(_LAST)).alias("doc_id"), "score"))  # MOST_QUERIES names at most
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], f"{query_key} {kind}, rank int, doc_id long, score long")


def plain(docs: Iterable[tuple[int | None, str | None]], queries: Iterable[tuple[object, str | None]], k: int) -> list[tuple]:
    """The same by the definition, document by document; for tests."""
    bags = [(key, Counter(terms((text or "").encode()))) for key, text in docs]
    bags = [(key, bag) for key, bag in bags if bag]
    total, length = len(bags), sum(sum(bag.values()) for _, bag in bags)
    df = Counter(t for _, bag in bags for t in bag)
    out = []
    for name, text in queries:
        found = []
        for key, bag in bags:
            m = 10 + 90 * sum(bag.values()) * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in set(terms((text or "").encode())) if t in bag)
            if score > 0:
                found.append((-score, _LAST if key is None else key))
        out += [(name, rank, None if key == _LAST else key, -score) for rank, (score, key) in enumerate(sorted(found)[:k], 1)]
    return out
