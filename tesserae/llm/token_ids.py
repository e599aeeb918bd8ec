"""Token ids in a binary file format of patched frame-of-reference blocks.

File: magic `PFR1`, then blocks of BLOCK values, a block index, a document index and a footer of four unsigned 64-bit
numbers (values, blocks, documents, offset of the block index). A block stores value minus the block's minimum in as many
bits as the PERCENTILE-th percentile of those differences needs (little-endian bit order); values that need more keep
their low bits there and stand whole in the block's exception list (one byte of position, four of difference). The block
index has each block's start (u64), minimum (u32), number of values (u16), width (u8) and exceptions (u8); the document
index has each document's id (i64), a null flag and its first value in this file (u64).

Files hold documents in ascending doc_id order and are themselves numbered in that order. Null ids come first, ties are
ordered by a hash of the text. Null and empty texts hold only the end id.
"""

from __future__ import annotations

import array
import itertools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm import common

MAGIC = b"PFR1"
BLOCK = 128
PERCENTILE = 90
#: Text bytes of a range of documents, about. A range of more than twice as many makes several files.
FILE_BYTES = 8 << 20
#: Files of a range are numbered below this.
FILES = 1_000_000
#: Ranges whose files' sizes are added up together.
GROUP = 1024
#: Words whose ids a worker keeps, and those of them that stay when there are more. About 200 bytes each.
CACHE_WORDS = 600_000
KEPT_WORDS = 200_000
#: Words that the model encodes in one call.
LEARN = 64

#: The byte-level pre-tokeniser's expression; used only on texts whose characters classify alike in every Unicode version.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_OTHER = "[^\t\n\r -~¡-¬®-ɏ‐-‧‰-⁞]"
#: White space beside a space, or a space at an end: there a space doesn't always begin a word of its own.
_WIDE = r" [ \n\t\r]|[\n\t\r] |\A | \z"

_INDEX = np.dtype([("start", "<u8"), ("low", "<u4"), ("size", "<u2"), ("width", "u1"), ("exceptions", "u1")])
_DOCS = np.dtype([("id", "<i8"), ("null", "u1"), ("first", "<u8")])


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE writes for each byte: itself, or one of those from U+0100 on in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """The tokenizers library's byte-level BPE, with the ids of words kept between texts.

    Byte-level BPE encodes each word of the pre-tokeniser by itself, so a text is cut at its spaces, words seen before come
    from a table, and the library's model encodes the others. Texts with added tokens, with characters outside Latin
    scripts, or with white space beside a space go to the library whole.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.unlike = "|".join([*added, _WIDE, _OTHER])  # texts for the library, as Arrow's expression
        self.pieces = regex.compile(PIECES).findall
        self.letters = _byte_letters()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)  # ids whose token begins with a space
        self.begins[[i for token, i in vocabulary.items() if token.startswith(self.letters[32])]] = True
        self.words: dict[str, bytes] = {}  # what stands between two spaces
        self.parts: dict[str, bytes] = {}  # pieces of those that aren't all letters

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, piece: str) -> bytes:
        return array.array("I", [t.id for t in self.tokenize(piece.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def _letters(self, words: list[str]) -> None:
        """Encode words of letters only, LEARN in one call: no merge goes across the space that begins the next word."""
        for k in range(0, len(words), LEARN):
            some = words[k : k + LEARN]
            ids = self._ids(" " + " ".join(some))
            first = (4 * np.flatnonzero(self.begins[np.frombuffer(ids, "<u4")])).tolist()
            self.words.update(zip(some, map(ids.__getitem__, map(slice, first, [*first[1:], len(ids)])), strict=True))

    def _learn(self, new: set[str]) -> None:
        """Encode what stands between two spaces, with the space before it: the pieces of all that aren't all letters are found in one call.

        A piece begins with a space only where a word begins, as no word ends in white space but the last of a text, after which
        a space makes no difference.
        """
        known, parts = self.words, self.parts
        mixed = [w for w in new if not w.isalpha()]
        new.difference_update(mixed)
        pieces = self.pieces(" " + " ".join(mixed)) if mixed else []
        starts = [k for k, piece in enumerate(pieces) if piece[0] == " "]
        heads = [pieces[k][1:] for k in starts]
        new.update(itertools.filterfalse(known.__contains__, filter(str.isalpha, heads)))
        self._letters([*new])
        for piece in itertools.filterfalse(parts.__contains__, {*pieces}):
            if piece[0] != " ":
                parts[piece] = self._ids(piece)
        for word, head, a, b in zip(mixed, heads, starts, itertools.chain(starts[1:], [len(pieces)]), strict=False):
            if (ids := known.get(head)) is None:
                ids = known[head] = self._ids(" " + head)
            if b - a > 1:
                known[word] = ids + (parts[pieces[a + 1]] if b - a == 2 else b"".join(map(parts.__getitem__, pieces[a + 1 : b])))

    def many(self, texts: pa.Array, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts as unsigned 32-bit numbers, each text's with the end id, one after the other; and where each begins, with their end.

        A word is looked up once for all its places in these texts, which take its ids by its number.
        """
        plain = pc.invert(pc.match_substring_regex(texts, self.unlike))
        cut = pc.split_pattern(pc.if_else(plain, texts, pa.scalar("", texts.type)), " ")
        flat, n = cut.flatten(), len(texts)
        begins = np.append(0, np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))).astype(np.int64)
        later = np.ones(len(flat), bool)
        later[begins[:-1]] = False
        coded = flat.filter(pa.array(later)).dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.words) + len(self.parts) > CACHE_WORDS:
            # The words met first are the frequent ones: they stay.
            self.words = dict(itertools.islice(self.words.items(), KEPT_WORDS))
            self.parts.clear()
        known = self.words
        if new := {*itertools.filterfalse(known.__contains__, words)}:
            self._learn(new)
        firsts = flat.take(pa.array(begins[:-1])).to_pylist()
        first = [b"".join(map(self._ids, self.pieces(f))) if p else self.whole(texts[k].as_py()) for k, (f, p) in enumerate(zip(firsts, plain.to_pylist(), strict=True))]
        found = [*map(known.__getitem__, words), *first, end]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        table = np.frombuffer(b"".join(found), "<u4")
        # A text is its first word, or the whole of it, then its other words, then the end.
        edges = begins + np.arange(n + 1)
        inner = np.ones(edges[-1], bool)
        inner[edges[:-1]] = inner[edges[1:] - 1] = False
        which = np.empty(edges[-1], np.int64)
        which[edges[:-1]] = len(words) + np.arange(n)
        which[edges[1:] - 1] = len(words) + n
        which[inner] = coded.indices.to_numpy()
        size = sizes[which]
        stop = np.cumsum(size)
        from_ = (np.cumsum(sizes) - sizes)[which] - (stop - size)
        ids = table[np.repeat(from_, size) + np.arange(stop[-1] if n else 0)]
        return ids, np.append(0, stop[edges[1:] - 1])

    def __call__(self, text: str, end: bytes) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers, with the end id."""
        return self.many(pa.array([text], pa.string()), end)[0].tobytes()


def encoder(path: str) -> Encoder:
    """The worker's encoder, with the words that earlier tasks met."""
    own = common.held(__name__)
    if path not in own:
        own.clear()
        own[path] = Encoder(path)
    return own[path]


def pack(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Blocks of uint32 values, and their index with starts from 0."""
    n = len(values)
    blocks = -(-n // BLOCK)
    if not n:
        return b"", np.zeros(0, _INDEX)
    sizes = np.full(blocks, BLOCK, np.int64)
    sizes[-1] = n - BLOCK * (blocks - 1)
    grid = np.empty(blocks * BLOCK, np.uint32)
    grid[:n] = values
    grid[n:] = values[-1]
    grid = grid.reshape(blocks, BLOCK)
    low = grid.min(axis=1)
    rest = grid - low[:, None]
    at = (BLOCK * PERCENTILE) // 100
    width = bits(np.partition(rest, at, axis=1)[:, at])
    outlier = rest >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    outlier[-1, sizes[-1] :] = False
    index = np.zeros(blocks, _INDEX)
    index["low"], index["size"], index["width"], index["exceptions"] = low, sizes, width, outlier.sum(axis=1)
    packed_size = BLOCK // 8 * width.astype(np.int64)
    total = packed_size + 5 * index["exceptions"].astype(np.int64)
    ends = np.cumsum(total)
    index["start"] = ends - total
    out = np.zeros(int(ends[-1]), np.uint8)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            planes = rest[rows].astype("<u4").view(np.uint8).reshape(len(rows), BLOCK, 4)
            stream = np.packbits(np.unpackbits(planes, axis=2, bitorder="little", count=int(w)).reshape(len(rows), -1), axis=1, bitorder="little")
            out[(index["start"][rows].astype(np.int64)[:, None] + np.arange(stream.shape[1])).ravel()] = stream.ravel()
    block, place = np.nonzero(outlier)
    if len(block):
        first = index["start"].astype(np.int64) + packed_size
        rank = np.arange(len(block)) - np.repeat(np.cumsum(index["exceptions"], dtype=np.int64) - index["exceptions"], index["exceptions"])
        to = first[block] + 5 * rank
        out[to] = place
        whole = rest[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
        for k in range(4):
            out[to + 1 + k] = whole[:, k]
    return out.tobytes(), index


def bits(values: np.ndarray) -> np.ndarray:
    """Bits that each uint32 needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def unpack(data: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The uint32 values of the blocks; `data` holds what the index's starts count from."""
    if not len(index):
        return np.zeros(0, np.uint32)
    out = np.zeros((len(index), BLOCK), np.uint32)
    start, width = index["start"].astype(np.int64), index["width"].astype(np.int64)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            stream = data[start[rows][:, None] + np.arange(BLOCK // 8 * w)]
            planes = np.unpackbits(stream, axis=1, bitorder="little").reshape(len(rows), BLOCK, int(w))
            whole = np.zeros((len(rows), BLOCK, 4), np.uint8)
            part = np.packbits(planes, axis=2, bitorder="little")
            whole[:, :, : part.shape[2]] = part
            out[rows] = whole.reshape(len(rows), -1).view("<u4")
    exceptions = index["exceptions"].astype(np.int64)
    if exceptions.any():
        block = np.repeat(np.arange(len(index)), exceptions)
        rank = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        at = (start + BLOCK // 8 * width)[block] + 5 * rank
        out[block, data[at]] = sum(data[at + 1 + k].astype(np.uint32) << np.uint32(8 * k) for k in range(4))
    out += index["low"][:, None]
    whole = out.ravel()
    return whole[: int(index["size"].sum())]


class Writer:
    """Collects documents' ids and gives the bytes of one file."""

    def __init__(self) -> None:
        self.parts: list[bytes] = []
        self.index: list[np.ndarray] = []
        self.docs: list[tuple[int, int, int]] = []
        self.rest: list[bytes] = []
        self.values = self.offset = self.size = 0

    def add(self, key: int | None, ids: bytes) -> None:
        self.docs.append((key or 0, key is None, self.values))
        self.values += len(ids) // 4
        self.size += len(ids)
        self.rest.append(ids)
        if self.size >= 1 << 20:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        held = b"".join(self.rest)
        n = len(held) if last else len(held) // (4 * BLOCK) * (4 * BLOCK)
        data, index = pack(np.frombuffer(held[:n], "<u4"))
        index["start"] += np.uint64(self.offset + len(MAGIC))
        self.offset += len(data)
        self.parts.append(data)
        self.index.append(index)
        self.rest, self.size = [held[n:]], len(held) - n

    def chunks(self) -> Iterator[bytes]:
        self._flush(True)
        index = np.concatenate(self.index)
        yield MAGIC
        yield from self.parts
        yield index.tobytes()
        yield np.array(self.docs, _DOCS).tobytes()
        yield struct.pack("<4Q", self.values, len(index), len(self.docs), self.offset + len(MAGIC))


class File:
    """A file's bytes, read by documents; any value is reached through the block index alone."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        self.values, blocks, docs, at = struct.unpack("<4Q", data[-32:])
        self.data = np.frombuffer(data, np.uint8)
        self.index = np.frombuffer(data, _INDEX, blocks, at)
        self.docs = np.frombuffer(data, _DOCS, docs, at + _INDEX.itemsize * blocks)

    def ids(self, first: int, end: int) -> np.ndarray:
        """The values [first, end)."""
        a = first // BLOCK
        return unpack(self.data, self.index[a : -(-end // BLOCK)])[first - a * BLOCK : end - a * BLOCK]

    def documents(self, most: int = 1 << 18) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, first value, ids) of each document, blocks unpacked some `most` values at a time."""
        firsts = [*self.docs["first"].tolist(), self.values]
        held, base, end = np.zeros(0, np.uint32), 0, 0
        for k, (key, null) in enumerate(zip(self.docs["id"].tolist(), self.docs["null"].tolist(), strict=True)):
            a, b = firsts[k], firsts[k + 1]
            if b > end:
                base = a
                end = min(self.values, max(b, a + most))
                held = self.ids(base, end)
            yield (None if null else key), a, held[a - base : b - base]


def ordered(docs: DataFrame, *, key: str = "doc_id", text: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """The rows dealt to numbered files by ranges of the key, sorted in each: one shuffle of the texts.

    The ranges come from the ids' own quantiles, found over id and length alone, so that texts are read once. Documents
    with the same id stand in one file; a null id counts as least.
    """
    place = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    slim = docs.select(place.alias("place"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("size"))
    cuts = common.range_cuts(slim, "place", "size", file_bytes)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), place.alias("place"))
    dealt = rows.select("key", "text", common.range_of("place", cuts).alias("file"))
    return dealt.repartitionById(len(cuts) + 1, F.col("file")).sortWithinPartitions("file", F.asc_nulls_first("key"), F.xxhash64("text"), "text")


def write(docs: DataFrame, folder: str, tokenizer: str, *, end: int, key: str = "doc_id", text: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the files to `folder`; returns (file, n_values), one row for each file, already computed.

    A task writes a file under its own name and then moves it, so a task that runs again leaves the same file.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt = str(TaskContext.get().taskAttemptId())
        last = struct.pack("<I", end)
        encode, at, out, size, part = encoder(tokenizer), None, Writer(), 0, 0

        def close() -> Iterator[pa.RecordBatch]:
            if at is not None:
                name = at * FILES + part
                common.put_file(f"{folder}/{name:012d}.pfr", out.chunks(), attempt)
                yield pa.RecordBatch.from_pydict({"file": [name], "n_values": [out.values]}, schema=pa.schema([("file", pa.int64()), ("n_values", pa.int64())]))

        for batch in batches:
            texts = batch.column("text")
            ids, edges = encode.many(texts, last)
            columns = [batch.column("file"), batch.column("key"), pc.utf8_length(texts)]
            for number, name, length, a, b in zip(*(c.to_pylist() for c in columns), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if number != at or size > 2 * file_bytes:
                    yield from close()
                    at, out, size, part = number, Writer(), 0, part + 1 if number == at else 0
                out.add(name, ids[a:b].tobytes())
                size += length
        yield from close()

    files = common.mapped(ordered(docs, key=key, text=text, file_bytes=file_bytes), run, "file long, n_values long", __name__)
    return common.cut(files, folder + "-files", "written")


def starts(files: DataFrame) -> DataFrame:
    """(file, before): the values of all files before each. Sums of groups of files meet in one task, and not the files."""
    part = F.expr(f"file div {GROUP * FILES}")
    sums = files.groupBy(part.alias("part")).agg(F.sum("n_values").alias("sum"))
    groups = sums.select("part", (F.sum("sum").over(Window.orderBy("part")) - F.col("sum")).alias("base"))
    within = files.select("file", "n_values", part.alias("part")).withColumn("before", F.sum("n_values").over(Window.partitionBy("part").orderBy("file")) - F.col("n_values"))
    return within.join(groups, "part").select("file", (F.col("base") + F.col("before")).alias("before"))


def read(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """Documents from the written files: doc_id, start (values of all documents before it), n_tokens, ids_crc32, and ids (binary, u32).

    Just the files that `write` lists are read; what a lost task may have left beside them isn't.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True):
                rows: list[tuple] = []
                size = 0
                for key, first, ids in File(common.get_file(f"{folder}/{number:012d}.pfr")).documents():
                    data = ids.astype("<u4").tobytes()
                    rows.append((key, before + first, len(ids), zlib.crc32(data), data))
                    size += len(data)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return common.mapped(common.listed(starts(files)), run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary", __name__)
