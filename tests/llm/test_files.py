"""Written files: the same bytes from a repeated task, just the listed ones read, ranges by binary search."""

import hashlib
import os
import shutil
import time

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from tesserae.llm import common, pieces, token_ids, warc


def digests(folder):
    path = folder.removeprefix("file://")
    return {n: hashlib.sha1(open(f"{path}/{n}", "rb").read()).hexdigest() for n in os.listdir(path) if not n.startswith("_")}




def test_archives_are_the_same_again(spark, data):
    """A second run of all tasks writes the same bytes; files that a lost attempt left aren't read."""
    pages = spark.read.parquet(f"{data}/pages.parquet")
    folder = common.shared_dir(spark) + "/warc"
    written = warc.write(warc.marked(pages), folder, file_bytes=20_000)
    before, rows = digests(folder), sorted(map(tuple, written.collect()))
    again = warc.write(warc.marked(pages), folder, file_bytes=20_000)
    assert digests(folder) == before and sorted(map(tuple, again.collect())) == rows and len(rows) > 3
    path = folder.removeprefix("file://")
    shutil.copy(f"{path}/{rows[0][0]}", f"{path}/999999-00000.warc.gz")
    assert warc.assemble(warc.read(spark, folder, again)).count() == pages.count() == sum(n for _, n in rows)


def test_captures_without_companions(spark):
    def row(name, kind, of=None):
        return (name, kind, of, None, None, None, 1, "page-id: 7\r\nurl: null\r\n" if kind == "metadata" else None, None)

    records = spark.createDataFrame([row("a", "response"), row("b", "request", "a"), row("c", "request", "a"), row("d", "metadata", "a"), row("e", "revisit"), row("f", "metadata", "gone"), row("g", "request")], warc.RECORDS)
    got = {r["response"]["record_id"]: r for r in warc.assemble(records).collect()}
    assert got.keys() == {"a", "e"} and got["a"]["page_id"] == 7 and got["a"]["request"]["record_id"] == "c" and got["e"]["request"] is None is got["e"]["metadata"]


def test_token_files_are_the_same_again(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    folder, path = common.shared_dir(spark) + "/t", public_tokenizers.path("byte_bpe_50k.json")
    files = token_ids.write(docs, folder, path, end=2, file_bytes=20_000)
    before, first = digests(folder), token_ids.read(spark, folder, files).toPandas()
    token_ids.write(docs, folder, path, end=2, file_bytes=20_000)
    assert digests(folder) == before and len(before) > 5 and len(first) == docs.count()
    first = first.sort_values("start")
    assert first.doc_id.is_monotonic_increasing and (first.start.to_numpy()[1:] == (first.start + first.n_tokens).to_numpy()[:-1]).all()


def test_starts_over_groups(spark, monkeypatch):
    monkeypatch.setattr(token_ids, "GROUP", 3)
    files = [(r * token_ids.FILES + p, 10 * r + p + 1) for r in range(20) for p in range(r % 3 + 1)]
    got = dict(map(tuple, token_ids.starts(spark.createDataFrame(files, "file long, n_values long")).collect()))
    total = 0
    for f, n in files:
        assert got[f] == total
        total += n


def test_ranges(spark):
    for n in (0, 1, 2, 3, 7, 8, 1000):
        cuts = list(range(0, 10 * n, 10))
        rows = spark.range(-5, 10 * n + 5, 3 if n < 100 else 97).select(F.col("id").alias("k"))
        got = rows.select("k", common.range_of("k", cuts).alias("r"), common.lookup("k", [(c, c + 1) for c in cuts]).alias("v")).collect()
        assert all(r["r"] == sum(c < r["k"] for c in cuts) and r["v"] == (r["k"] + 1 if r["k"] in cuts else None) for r in got)


def test_words_of_a_batch_are_learnt_together(monkeypatch):
    """One call of the model for many new words, with punctuation or without; when the table overflows, the words met first stay."""
    encode = token_ids.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    words = [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyzabcd'[k // 100]}" for k in range(1000)]
    texts = ["", *(" ".join(w + p for w, p in zip(words[k:] + words[:k], [",", ".\nNew", "", "###", "\t1a\n\n", "'s?"] * 200)) for k in range(0, 1000, 50)), "a  b", "漢字", "x<|endoftext|>", "one\n\n\n", " x"]
    model, calls = encode.tokenize, []
    encode.tokenize = lambda piece: calls.append(piece) or model(piece)
    for most in (token_ids.CACHE_WORDS, 100):
        monkeypatch.setattr(token_ids, "CACHE_WORDS", most)
        monkeypatch.setattr(token_ids, "KEPT_WORDS", 60)
        ids, edges = encode.many(pa.array(texts), b"\2\0\0\0")
        assert len(edges) == len(texts) + 1
        for k, text in enumerate(texts):
            assert ids[edges[k] : edges[k + 1]].tolist() == [*encode.tokenizer.encode(text, add_special_tokens=False).ids, 2]
    kept = list(encode.words)[:60]
    assert len(calls) < 150
    ids, edges = encode.many(pa.array([], pa.string()), b"")
    assert len(ids) == 0 and edges.tolist() == [0] and list(encode.words) == kept


def test_a_written_table_leaves_no_shuffle_files(spark):
    def shuffled():
        dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}

    before, held = shuffled(), spark.conf.get(common.CLEANUP)
    rows = spark.range(20_000).select((F.col("id") % 100).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("t"))
    met = rows.repartition(3, "k").join(rows.groupBy("k").agg(F.max("t").alias("most")).hint("merge"), "k")
    cut = common.cut(met, common.shared_dir(spark), "met")
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before and spark.conf.get(common.CLEANUP) == held
    assert cut.count() == 20_000 and cut.exceptAll(met).isEmpty()


def test_units_met_first_stay():
    """A worker whose states overflow keeps the units that it met first; samples don't depend on what is kept."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = [f"the {a}on, of {b}er. {a}{b}###\nthe  end {c} ½ " + "x" * (k % 3) for k, (a, b, c) in enumerate((chr(97 + i % 26) * 3, chr(98 + i % 25) + "te", "漢字"[: i % 3]) for i in range(60))] + ["", " ", "a\ud800 b", "the of"]
    small, large = pieces.Lattice(path, most_states=200), pieces.Lattice(path)

    def plain(samples):
        return [[(s.ids.tolist(), round(s.log, 9), round(s.value, 9), round(s.inclusion, 9)) for s in x] for x in samples]

    keys = list(range(len(texts)))
    want = plain(pieces.sample_texts(large, texts, keys, 2))
    for k in range(0, len(texts), 8):
        assert plain(pieces.sample_texts(small, texts[k : k + 8], keys[k : k + 8], 2)) == want[k : k + 8]
    before = list(small.units.items())
    small.shrink(60)
    assert 0 < len(small.units) < len(before) and list(small.units.items()) == before[: len(small.units)] and "the" in small.units
    assert 60 <= small.states < 120 and all(max(own) < small.states for own in small.words.values())
    assert plain(pieces.sample_texts(small, texts, keys, 2)) == want
