"""The pipeline against plain versions of its stages."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tesserae.llm import decontaminate, near_copies, secrets


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    out, docs = [], spark.read.parquet(f"{data}/documents.parquet")
    folder = tmp_path_factory.mktemp("stages")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(f"file://{folder}/{k}")
        docs = spark.read.parquet(f"file://{folder}/{k}")
        out.append(docs.toPandas())
    return out


def test_columns_and_decisions(spark, data, stages):
    before = spark.read.parquet(f"{data}/documents.parquet").toPandas()
    for frame in stages[:-1]:
        assert list(frame.columns) == corpus_pipeline.COLUMNS and frame.doc_id.is_unique
    assert len(before) > len(stages[0]) > len(stages[1]) >= len(stages[2]) == len(stages[3]) > 0


def test_quality_stage(spark, data, stages):
    labels = spark.read.parquet(f"{data}/labels.parquet").toPandas().set_index("doc_id").quality
    kept = stages[0].doc_id[stages[0].doc_id.isin(labels.index)]
    assert labels[kept].mean() == 1.0


def test_dedup_stage(stages):
    """Each document that went has a near print in the input; no two that stay have 0.8 of their five-word shingles in common."""
    before, after = dict(zip(stages[0].doc_id, stages[0].text, strict=True)), set(stages[1].doc_id)
    prints = {d: int.from_bytes(near_copies.print_of(t)) for d, t in before.items()}
    for d in set(before) - after:
        assert any(bin(prints[d] ^ q).count("1") <= near_copies.MAX_BITS for e, q in prints.items() if e != d)

    def shingles(text):
        words = text.lower().split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}

    sets = {d: shingles(before[d]) for d in after}
    where = {}
    for d, own in sets.items():
        for x in own:
            where.setdefault(x, []).append(d)
    pairs = {(a, b) for ids in where.values() for a in ids for b in ids if a < b}
    assert not [p for p in pairs if len(sets[p[0]] & sets[p[1]]) >= 0.8 * len(sets[p[0]] | sets[p[1]])]


def test_decontamination_and_secrets(spark, data, stages):
    items = [(str(r["item_id"]), decontaminate.words_of(r["text"])) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    tree = decontaminate.SuffixAutomaton(items)
    assert any(tree.scan(decontaminate.words_of(t))[0] for t in stages[1].text)
    clean = {d: t for d, t in zip(stages[1].doc_id, stages[1].text, strict=True) if not tree.scan(decontaminate.words_of(t))[0]}
    after = dict(zip(stages[2].doc_id, stages[2].text, strict=True))
    assert all(after[d] == t for d, t in clean.items())
    assert not any(b - a >= decontaminate.WINDOW for t in after.values() for a, b in tree.scan(decontaminate.words_of(t))[0])
    words = secrets.prefilter()
    for d, t in zip(stages[3].doc_id, stages[3].text, strict=True):
        assert t == secrets.masked(after[d], [(a, b) for a, _, b in secrets.find(after[d], words)], "[SECRET]")


def test_tokens(stages):
    last = stages[4]
    assert last.round_trip.all() and set(last.doc_id) == set(stages[3].doc_id)


def test_run_and_empty(spark, data, tmp_path):
    import shutil

    assert corpus_pipeline.run(spark, data).count() > 0
    for name in ("labels", "benchmark"):
        shutil.copy(f"{data}/{name}.parquet", tmp_path / f"{name}.parquet")
    spark.read.parquet(f"{data}/documents.parquet").filter(F.lit(False)).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_sampling_in_the_pipeline_is_held_in_little_memory(spark, monkeypatch):
    """Of three million characters of ever new words a worker keeps little, and the samples are those of large tables."""
    import tracemalloc
    import zlib

    import numpy as np
    import public_tokenizers
    import pyarrow as pa

    from tesserae.llm import common, pieces

    runs = []
    monkeypatch.setattr(common, "mapped", lambda rows, run, schema, module: runs.append(run))
    docs = spark.createDataFrame([], "doc_id long, text string")
    corpus_pipeline.sentencepiece(spark, docs, "")
    letters = np.random.default_rng(7).choice(list("etaoinshrdlu"), (1500, 220, 8))
    texts = [" ".join("".join(word) for word in text) for text in letters]
    batches = [pa.RecordBatch.from_pydict({"doc_id": list(range(k, k + 300)), "_text": texts[k : k + 300]}) for k in range(0, 1500, 300)]
    next(runs[0](iter(batches[:1])))  # the model's own tables
    tracemalloc.start()
    found = {(r["doc_id"], r["sample"]): r["ids_crc32"] for b in runs[0](iter(batches)) for r in b.select(["doc_id", "sample", "ids_crc32"]).to_pylist()}
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert len(found) == 3000 and peak < 90, peak
    lattice = pieces.Lattice(public_tokenizers.path("piece_bpe_32k.model"))
    samples = pieces.sample_texts(lattice, texts[:600], list(range(600)), 2)
    assert all(found[d, n] == zlib.crc32(s.ids.tobytes()) for d, of in enumerate(samples) for n, s in enumerate(of))
