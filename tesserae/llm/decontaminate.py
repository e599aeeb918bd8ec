"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

Training texts are streamed word by word through the automaton, which holds at each word the longest match with any
item. A match of `window` words or more, or of a whole shorter item, marks the words it covers. Spans of marked words
are reported, and `remove_spans` cuts them from the text.

Defined results: a null or empty text has no words and no hits; a null or wordless item has no window; repeated items
count once (by item_id), and all items without an id as one, the item ""; repeated documents give a row each; texts of any length are
read whole; no documents give no rows, and no items no hits; extra columns pass through, but for ones named like those that `scan`
adds, which they replace there (`clean` keeps them). An item is held by one automaton whole, so one of more than SHARD_WORDS
words makes a larger automaton.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm import common

#: Words that make a window.
WINDOW = 10
#: Words of items that one automaton holds. It bounds what is broadcast; more items make more automata, run in turn.
SHARD_WORDS = 100_000

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The columns that a scan adds.
NAMES = ("n_words", "hit_spans", "hit_items", "longest_match")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(common.ascii_lower(text)) if text else []


class SuffixAutomaton:
    """All word sequences that occur in the items, each state with the windows that end there."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.items: list[set[str]] = [set()]  # the items of `window` words or more with an occurrence that ends here
        self.whole: dict[int, list[tuple[int, str]]] = {}  # shorter items, by the state of the whole item
        short = []
        for name, words in items:
            if not words:
                continue
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            last = 0
            for word in ids:
                last = self._extend(last, word)
                if len(ids) >= window:
                    self.items[last].add(name)
            if len(ids) < window:
                short.append((name, ids))
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        for state in reversed(order):
            if self.link[state] > 0 and self.length[self.link[state]] >= window:
                self.items[self.link[state]] |= self.items[state]
            elif self.length[state] < window:
                self.items[state] = set()
        for name, ids in short:
            state = 0
            for word in ids:
                state = self.next[state][word]
            self.whole.setdefault(state, []).append((len(ids), name))
        # The least match length at which a window ends in a state.
        never = 1 << 60
        self.least = [never] * len(self.link)
        for state in order:
            least = self.least[self.link[state]]
            for size, _ in self.whole.get(state, ()):
                least = min(least, size)
            self.least[state] = min(least, window) if self.length[state] >= window else least

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.items.append(set())
        return len(self.link) - 1

    def _extend(self, last: int, word: int) -> int:
        follow, link, length = self.next, self.link, self.length
        if word in follow[last]:  # an earlier item has this sequence
            held = follow[last][word]
            return held if length[held] == length[last] + 1 else self._split(last, word, held)
        new = self._state(length[last] + 1)
        at = last
        while at >= 0 and word not in follow[at]:
            follow[at][word] = new
            at = link[at]
        if at >= 0:
            held = follow[at][word]
            link[new] = held if length[held] == length[at] + 1 else self._split(at, word, held)
        return new

    def _split(self, at: int, word: int, held: int) -> int:
        copy = self._state(self.length[at] + 1)
        self.next[copy] = dict(self.next[held])
        self.link[copy] = self.link[held]
        self.link[held] = copy
        while at >= 0 and self.next[at].get(word) == held:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def found(self, state: int, matched: int) -> tuple[int, set[str]]:
        """Words of the longest window that ends here, and the items with a window that ends here."""
        size, names = 0, set()
        at = state
        if matched >= self.window:
            while self.length[self.link[at]] >= self.window:
                at = self.link[at]
            size, names = self.window, set(self.items[at])
        at = state
        while at > 0:
            for n, name in self.whole.get(at, ()):
                if n <= matched:
                    size = max(size, n)
                    names.add(name)
            at = self.link[at]
        return size, names

    def scan(self, words: list[str]) -> tuple[list[list[int]], set[str], int]:
        """Spans [first word, end) of hit words, the items hit, and the longest match."""
        follow, link, length, least = self.next, self.link, self.length, self.least
        spans: list[list[int]] = []
        names: set[str] = set()
        seen: set[tuple[int, int]] = set()
        state = matched = longest = 0
        for i, word in enumerate(map(self.vocabulary.get, words)):
            if word is None:
                state = matched = 0
                continue
            to = follow[state].get(word)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = follow[state].get(word)
            if to is None:
                continue
            state = to
            matched += 1
            if matched >= least[state]:
                size, more = self.found(state, matched) if (key := (state, min(matched, self.window))) not in seen else (self.found_size(state, matched), ())
                seen.add(key)
                names.update(more)
                longest = max(longest, matched)
                begin = i + 1 - size
                while spans and spans[-1][0] >= begin:
                    spans.pop()
                if spans and spans[-1][1] >= begin:
                    spans[-1][1] = i + 1
                else:
                    spans.append([begin, i + 1])
        return spans, names, longest

    def found_size(self, state: int, matched: int) -> int:
        return self.window if matched >= self.window else self.found(state, matched)[0]


def automaton(items: Broadcast, window: int) -> SuffixAutomaton:
    """The worker's automaton for broadcast items; the last one is kept between tasks."""
    value = items.value
    own = common.held(__name__)
    if own.get("of") is not value or own["window"] != window:
        own.update({"of": value, "window": window, "automaton": SuffixAutomaton(value, window)})
    return own["automaton"]


def shards(benchmark: DataFrame, item: str, text: str, most_words: int) -> Iterator[list[tuple[str, list[str]]]]:
    """The items in lists of at most about `most_words` words; they come to the driver one list at a time."""
    held: list[tuple[str, list[str]]] = []
    size = 0
    for row in benchmark.select(F.col(item).cast("string"), F.col(text)).toLocalIterator():
        words = words_of(row[1])
        if held and size + len(words) > most_words:
            yield held
            held, size = [], 0
        held.append((row[0] if row[0] is not None else "", words))
        size += len(words)
    yield held


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
    names: tuple[str, ...] = NAMES,
) -> DataFrame:
    """The documents with `n_words`, `hit_spans` (array of [first word, end)), `hit_items` and `longest_match` added.

    `names` are those of the added columns; they take the place of columns that are called so, others stay as they are.

    One narrow pass, no shuffle: the automaton is broadcast, its size bounded by `shard_words`. Items beyond that make
    further automata, each applied in a pass of its own over the rows written by the last.
    """
    spark = docs.sparkSession
    docs = docs.select(*(c for c in docs.columns if c not in names))
    kinds = [T.LongType(), T.ArrayType(T.ArrayType(T.IntegerType())), T.ArrayType(T.StringType()), T.IntegerType()]
    added = T.StructType([T.StructField(n, kind) for n, kind in zip(names, kinds, strict=True)])
    out, where = docs, None
    for k, items in enumerate(shards(benchmark, item, item_text, shard_words)):
        if k:
            where = where or common.shared_dir(spark)
            out = common.cut(out, where, f"scan-{k}")
        schema = T.StructType([f for f in out.schema.fields if k == 0 or f.name not in added.names] + added.fields)
        out = common.mapped(out, _scanner(spark.sparkContext.broadcast(items), text, window, bool(k), names), schema, __name__)
    return out


def _scanner(items: Broadcast, text: str, window: int, again: bool, names: tuple[str, ...]):
    _, in_spans, in_items, in_longest = names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(items, window)
        for batch in batches:
            sizes, spans, hits, longest = [], [], [], []
            for value in batch.column(text).to_pylist():
                words = words_of(value)
                s, h, n = found.scan(words)
                sizes.append(len(words))
                spans.append(s)
                hits.append(sorted(h))
                longest.append(n)
            if again:
                spans = [merged(a + b) for a, b in zip(batch.column(in_spans).to_pylist(), spans, strict=True)]
                hits = [sorted({*a, *b}) for a, b in zip(batch.column(in_items).to_pylist(), hits, strict=True)]
                longest = [max(a, b) for a, b in zip(batch.column(in_longest).to_pylist(), longest, strict=True)]
            kept = [n for n in batch.schema.names if n not in names]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in kept]
                + [pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(hits, pa.list_(pa.string())), pa.array(longest, pa.int32())],
                names=[*kept, *names],
            )

    return run


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return out


def without_spans(text: str, spans: list[list[int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    if not spans:
        return text
    at = [m.span() for m in WORD.finditer(common.ascii_lower(text))]
    out, last = [], 0
    for begin, end in spans:
        out.append(text[last : at[begin][0]])
        last = at[end - 1][1]
    return "".join([*out, text[last:]])


def remove_spans(scanned: DataFrame, *, text: str = "text", max_words: int = WINDOW, max_coverage: float = 0.8, names: tuple[str, ...] = NAMES) -> DataFrame:
    """Apply a scan: texts lose each hit span of `max_words` or more; documents with at least `max_coverage` of their words hit go.

    Rows without such a span pass unchanged. The columns that `scan` added are dropped.
    """
    schema, (size, found, *_) = T.StructType([f for f in scanned.schema.fields if f.name not in names]), names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                v if v is None or not s else without_spans(v, [x for x in s if x[1] - x[0] >= max_words])
                for v, s in zip(batch.column(text).to_pylist(), batch.column(found).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == text else batch.column(n) for n in schema.names], names=schema.names)

    hit = F.aggregate(found, F.lit(0), lambda a, x: a + x[1] - x[0])
    return common.mapped(scanned.filter((F.col(size) == 0) | (hit < max_coverage * F.col(size))), run, schema, __name__)


def clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, max_words: int = WINDOW, max_coverage: float = 0.8, shard_words: int = SHARD_WORDS) -> DataFrame:
    """`remove_spans` of a `scan`, in one pass of one worker where one automaton holds all items; all columns of the documents stay."""
    lists = shards(benchmark, item, item_text, shard_words)
    items = next(lists)
    if next(lists, None) is not None:
        names = tuple(common.unused(docs.columns, n) for n in NAMES)
        found = scan(docs, benchmark, text=text, item=item, item_text=item_text, window=window, shard_words=shard_words, names=names)
        return remove_spans(found, text=text, max_words=max_words, max_coverage=max_coverage, names=names)
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(items)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = automaton(held, window)
        for batch in batches:
            texts, keep = [], []
            for value in batch.column(text).to_pylist():
                words = words_of(value)
                spans, _, _ = tree.scan(words)
                keep.append(not words or sum(b - a for a, b in spans) < max_coverage * len(words))
                texts.append(without_spans(value, [x for x in spans if x[1] - x[0] >= max_words]) if spans and keep[-1] else value)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == text else batch.column(n) for n in names], names=names).filter(pa.array(keep, pa.bool_()))

    return common.mapped(docs, run, docs.schema, __name__)


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: counts of words, hit words and items, and a hash of the items."""
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + (x[1] - x[0]).cast("long"))
    return scanned.select(
        key,
        "n_words",
        hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("hit_items"), ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def sha256_of(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
