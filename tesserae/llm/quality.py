"""Quality classifier: Bradley-Terry ranking. Document scores are learned from preference pairs (a good document beats a
bad one) by logistic loss on the difference of their features, then cut at a quantile of the training scores.

Features come from the whole text alone. The utility u = w·f(text) is shifted so that the chosen quantile of the training
utilities lies at CUT after the logistic function: score >= CUT is the operator's "keep".

Fitting reads a bounded sample: of the labelled rows that may be learned from, the SAMPLE_ROWS with the smallest hash of
their id. Scoring is one narrow pass over all rows.

Defined results: null and empty texts get the score of a text without words; labels with a null id or label are ignored,
an id labelled more than once counts by its mean (a tie is good); with no label, or labels of one kind only, every score is 0.5; repeated rows
get the same score; extra columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm import common

#: Labelled rows that fitting reads at most.
SAMPLE_ROWS = 20_000
#: Preference pairs that fitting draws.
PAIRS = 40_000
#: Score of the chosen quantile.
CUT = 0.3

_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLASSES = np.zeros((256, 6 + len(_MARKS)), np.float64)
for _k, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", bytes(range(128, 256)))):
    _CLASSES[list(_set), _k] = 1
for _k, _c in enumerate(_MARKS.encode()):
    _CLASSES[_c, 6 + _k] = 1
_END = re.compile(r"[.!?…:;][\"')\]]*\s*$")


def raw_features(text: str | None) -> list[float]:
    """Shares and sizes that describe a whole text; all finite, also for an empty one."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    size = max(1, len(data))
    shares = np.bincount(data, minlength=256) @ _CLASSES / size
    words = text.split()
    n = max(1, len(words))
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(1, len(lines))
    letters = max(1e-9, shares[0] + shares[1] + shares[5])
    return [
        *shares,
        shares[0] / letters,
        1 - shares[:6].sum(),
        len(seen) / n,
        sum(c for c in seen.values() if c > 1) / n,
        max(seen.values(), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        sum(not w[-1].isalnum() for w in words) / n,
        sum(map(str.isalpha, words)) / n,
        sum(map(str.isupper, words)) / n,
        len(text) / n / 20,
        len(set(lines)) / m,
        sum(1 for x in lines if _END.search(x[-4:])) / m,
        np.log1p(len(data)) / 10,
        np.log1p(len(words)) / 10,
        np.log1p(len(lines)) / 5,
        n / m / 100 if n / m < 1000 else 10.0,
    ]


def features(text: str | None) -> np.ndarray:
    """The raw features, their square roots (which tell small shares apart) and marks of shares that are there at all."""
    raw = np.array(raw_features(text))
    return np.concatenate([raw, np.sqrt(np.abs(raw)), np.minimum(1, 20 * raw)])


@dataclass(frozen=True)
class Model:
    """Weights on standardised features, and the shift that puts the chosen quantile at CUT."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    shift: float
    quantile: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        u = ((rows - self.mean) / self.scale).clip(-8, 8) @ self.weights + self.shift
        return 1 / (1 + np.exp(-u.clip(-40, 40)))


def fit(rows: np.ndarray, good: np.ndarray, *, pairs: int = PAIRS, ridge: float = 2e-3, seed: int = 7) -> Model:
    """Bradley-Terry by Newton's method on preference pairs; the quantile is the one with the fewest errors on the sample."""
    width = rows.shape[1] if rows.ndim == 2 else len(features(""))
    a, b = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(a) or not len(b):
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 0.0)
    mean, scale = rows.mean(axis=0), rows.std(axis=0)
    scale[scale < 1e-6] = 1.0
    x = ((rows - mean) / scale).clip(-8, 8)
    rng = np.random.default_rng(seed)
    n = min(pairs, 50 * len(rows))
    win, lose = rng.choice(a, n), rng.choice(b, n)
    w = np.zeros(width)
    for _ in range(15):
        gradient, hessian = ridge * w, ridge * np.eye(width)
        for k in range(0, n, 20_000):
            d = x[win[k : k + 20_000]] - x[lose[k : k + 20_000]]
            p = 1 / (1 + np.exp((d @ w).clip(-40, 40)))  # how unlikely the preference is
            gradient = gradient - p @ d / n
            hessian = hessian + (d * (p * (1 - p))[:, None]).T @ d / n
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-2:
            break
    u = x @ w
    order = np.argsort(u)
    ranked = good[order].astype(int)
    # Errors if everything below position k goes: good ones below, bad ones from there on; balanced between the kinds.
    errors = np.concatenate([[0], np.cumsum(ranked)]) / len(a) + (len(b) - np.concatenate([[0], np.cumsum(1 - ranked)])) / len(b)
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    k = int(best[len(best) // 2])
    edge = (u[order[max(0, k - 1)]] + u[order[min(len(u) - 1, k)]]) / 2
    return Model(mean, scale, w, float(np.log(CUT / (1 - CUT)) - edge), k / len(u))


def sample(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the sample, as arrays on the driver: at most `rows` labelled ids, one row each.

    Ids are taken by their hash, whatever their labels; an id labelled more than once counts by its mean. Of several
    documents with one id the least text counts, so repeated rows change nothing. Labels without a document, null ids and
    null labels count for nothing; null and empty texts have the features of an empty one, and texts of any length are
    read whole. Without labels there are no rows. The sample's ids are broadcast: `rows` numbers at most.
    """
    chosen = (
        labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(key)
        .agg(F.avg(label).alias("_label"))
        .orderBy(F.xxhash64(key), key)
        .limit(rows)
    )
    schema = "label double, f array<double>"
    met = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen.withColumnRenamed(key, "_key")), "_key")
    wanted = met.groupBy("_key", "_label").agg(F.min("_text").alias("_text")).select("_text", "_label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(v).tolist() for v in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_label"), pa.array(found, pa.list_(pa.float64()))], names=["label", "f"])

    got = common.mapped(wanted, run, schema, __name__).orderBy("label", "f").toArrow()
    width = len(features(""))
    if not got.num_rows:
        return np.zeros((0, width)), np.zeros(0, bool)
    flat = got.column("f").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, width), got.column("label").to_numpy() >= 0.5


def scored(docs: DataFrame, model: Model, *, text: str = "text", into: str = "score") -> DataFrame:
    """The documents with a score in [0, 1] added. One narrow pass."""
    docs = docs.drop(into) if into in docs.columns else docs
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.stack([features(v) for v in batch.column(text).to_pylist()]) if batch.num_rows else np.zeros((0, len(model.mean)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(rows), pa.float64())], names=[*batch.schema.names, into])

    return common.mapped(docs, run, schema, __name__)


def held_out(key: str = "doc_id"):
    """Rows whose labels aren't learned from: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))
