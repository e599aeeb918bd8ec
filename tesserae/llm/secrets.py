"""Secret scan: an Aho-Corasick keyword prefilter, regular expressions anchored at its hits, then embedded checksums.

Kinds, in order: `assign` (a credential name, then a value of 6 or more characters), `access` (AKIA identifiers of 20 or
more), `hex` (runs of 24 or more lower-case hex digits), `github` and `npm` (tokens whose last six characters are the
base-62 CRC-32 of the rest; tokens that fail that checksum aren't reported). Within a kind, matches are leftmost and
don't overlap; a match that fails its length is dropped but still consumes its characters. Hex runs have no keyword:
their prefilter is every eighth character, of which a run of 24 covers three.

Defined results: null and empty texts have no secrets; texts of any length are read whole, in linear time; repeated rows give a
row each; an empty table gives an empty table; extra columns pass through; spans are in code points, end exclusive.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm import common

KINDS = ("assign", "access", "hex", "github", "npm")
BASE_KINDS = KINDS[:3]

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
GITHUB = re.compile(r"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])")
NPM = re.compile(r"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])")
HEX = re.compile(r"[0-9a-f]+")
HEX_SAMPLES = re.compile(r"[0-9a-f]{3,}")
HEX_DIGITS = frozenset("0123456789abcdef")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

#: Keyword, in lower case, to the kind whose expression is tried where the keyword begins.
KEYWORDS = {
    "password": 0, "passwd": 0, "secret": 0, "token": 0, "apikey": 0, "api_key": 0,
    "akia": 1,
    "ghp_": 3, "gho_": 3, "ghu_": 3, "ghs_": 3, "ghr_": 3,
    "npm_": 4,
}

#: Spans as Spark sees them.
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def base62(number: int) -> str:
    out = ""
    while number:
        number, digit = divmod(number, 62)
        out = BASE62[digit] + out
    return out.rjust(6, "0")


def checksum_holds(token: str) -> bool:
    """Whether the last six characters are the checksum of what stands between prefix and them."""
    body = token.partition("_")[2]
    return base62(zlib.crc32(body[:-6].encode())) == body[-6:]


def _accepts(kind: int, m: re.Match) -> bool:
    if kind == 0:
        return len(m[2]) >= 6
    if kind == 1:
        return len(m[0]) >= 20
    return checksum_holds(m[0])


_PATTERNS = {0: ASSIGN, 1: ACCESS, 3: GITHUB, 4: NPM}


def prefilter() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def find(text: str, keywords: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all secrets, by start, then kind."""
    spans: list[tuple[int, int, int]] = []
    hits = sorted((end + 1 - n, kind) for end, (n, kind) in keywords.iter(common.ascii_lower(text)))
    after = [0] * len(KINDS)
    for start, kind in hits:
        if start >= after[kind] and (m := _PATTERNS[kind].match(text, start)):
            after[kind] = m.end()
            if _accepts(kind, m):
                spans.append((start, kind, m.end()))
    end = 0
    for samples in HEX_SAMPLES.finditer(text[7::8]):
        for at in range(7 + 8 * samples.start(), 7 + 8 * samples.end(), 8):
            if at < end:
                continue
            start = at
            while start > end and text[start - 1] in HEX_DIGITS:
                start -= 1
            end = HEX.match(text, start).end()
            if end - start >= 24:
                spans.append((start, 2, end))
    spans.sort()
    return spans


def scan(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The documents with `secrets` added: an array of (kind, start, end) by start, then kind. One narrow pass."""
    docs = docs.drop("secrets") if "secrets" in docs.columns else docs
    schema = T.StructType([*docs.schema.fields, T.StructField("secrets", SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = prefilter()
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find(v, keywords)] if v else [] for v in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, _ARROW_SPANS)], names=[*batch.schema.names, "secrets"])

    return common.mapped(docs, run, schema, __name__)


def redact(scanned: DataFrame, *, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replace what the scan found by `mark`, overlapping spans as one; other rows pass unchanged. Drops `secrets`."""
    schema = T.StructType([f for f in scanned.schema.fields if f.name != "secrets"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [masked(v, [(x["start"], x["end"]) for x in s], mark) if s else v for v, s in zip(batch.column(text).to_pylist(), batch.column("secrets").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == text else batch.column(n) for n in schema.names], names=schema.names)

    return common.mapped(scanned, run, schema, __name__)


def mask(docs: DataFrame, *, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """`redact` of a `scan` in one pass of one worker."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = prefilter()
        for batch in batches:
            texts = [masked(v, [(a, b) for a, _, b in s], mark) if v and (s := find(v, keywords)) else v for v in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == text else batch.column(n) for n in names], names=names)

    return common.mapped(docs, run, docs.schema, __name__)


def masked(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    out, last = [], 0
    for begin, end in sorted(spans):
        if begin >= last:
            out += [text[last:begin], mark]
        last = max(last, end)
    return "".join([*out, text[last:]])


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: counts by base kind, a hash of the base spans, and all spans."""
    base = F.filter("secrets", lambda x: x["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    return scanned.select(
        key,
        *(count(kind).alias(f"n_{kind}") for kind in BASE_KINDS),
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("secrets")).alias("spans"),
    )
