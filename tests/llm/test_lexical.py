"""Ranked search against scores by the definition, its bounds, its pruning and its defined cases."""

import random

import numpy as np
from pyspark.sql import functions as F

from tesserae.llm import lexical
from tesserae.llm.common import shared_dir


def ranked(found):
    return sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect())


def corpus(n, seed=3):
    """Documents of words with a long tail; copies, so that scores are equal."""
    pick = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    weights = [1 / (k + 1) for k in range(400)]
    docs = [(k, " ".join(pick.choices(words, weights, k=pick.randint(1, 60)))) for k in range(n)]
    return [*docs, *((n + k, docs[k % 7][1]) for k in range(n // 3))]


def test_against_the_definition(spark):
    docs = corpus(900)
    queries = [(f"q{k}", " ".join(f"w{j}" for j in random.Random(k).sample(range(400), 1 + k % 12))) for k in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    asked = spark.createDataFrame(queries, "item_id string, text string")
    wanted = sorted(lexical.plain(docs, queries, 10))
    assert ranked(lexical.search(frame, asked, shared_dir(spark))) == wanted
    # The same in batches of few terms and of few queries.
    assert ranked(lexical.search(frame, asked, shared_dir(spark), most_terms=40, most_queries=15)) == wanted


def test_defined_cases(spark):
    long = "deep " * 300_000 + "Needle"
    docs = [(1, None), (2, ""), (3, " .,-"), (None, "needle here"), (5, "Needle HERE"), (5, "Needle HERE"), (6, long), (7, "É needle é"), (4, "needle here")]
    queries = [(1, "needle HERE"), (2, None), (3, ""), (4, "!!"), (5, "nowhere"), (1, "needle HERE"), (None, "É"), (6, "é")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("block", F.lit(1))
    asked = spark.createDataFrame(queries, "item_id long, text string").withColumn("doc_id", F.lit(9))
    got = sorted(map(str, (tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in lexical.search(frame, asked, shared_dir(spark), k=4).collect())))
    assert got == sorted(map(str, lexical.plain(docs, queries, 4)))
    equal = [r for r in lexical.plain(docs, queries, 9) if r[0] == 1]
    assert [r[2] for r in equal[:4]] == [4, 5, 5, None]
    nothing = frame.limit(0)
    assert lexical.search(nothing, asked, shared_dir(spark)).count() == 0 == lexical.search(frame, asked.limit(0), shared_dir(spark)).count()


def held_blocks(spark, docs, queries):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    (batch,) = lexical.batches(spark.createDataFrame(queries, "item_id long, text string"), "text", 10_000, 100)
    index = lexical.forward(frame, batch.vocabulary, "doc_id", "text").cache()
    total, length = index.agg(F.count(F.lit(1)), F.sum("n")).first()
    asked = lexical.Asked(batch.asked, lexical.weights(index, len(batch.vocabulary), total))
    return lexical.blocks(index, total, length).cache(), asked


def test_blocks_and_bounds(spark):
    """Blocks hold BLOCK_DOCS documents in ascending order, ranges don't overlap, and no score exceeds its bound."""
    docs, queries = corpus(700), [(k, f"w{k} w{3 * k} w{50 + k}") for k in range(20)]
    held, asked = held_blocks(spark, docs, queries)
    found = [lexical._block(r.asDict()) for r in sorted(held.collect(), key=lambda r: r["block"])]
    assert all(len(b.docs) <= lexical.BLOCK_DOCS for b in found) and sum(len(b.docs) for b in found) > 400
    ids = np.concatenate([b.docs for b in found])
    assert (np.diff(ids) > 0).all()
    bounds = asked.bounds([(b.terms, b.maxima) for b in found])
    for q, own in enumerate(asked.queries):
        for k, b in enumerate(found):
            assert b.scores(own, asked.weight).max() <= bounds[q, k]


def test_blocks_are_skipped(spark, monkeypatch):
    """Documents that hold a rare term stand in few blocks: the others aren't scored."""
    docs = [(k, f"common filler{k % 50} " + ("rare rare" if k < 20 else "")) for k in range(2000)]
    held, asked = held_blocks(spark, docs, [(1, "common rare")])
    least = lexical.thresholds(held, asked, 10)
    blocks = [lexical._block(r.asDict()) for r in held.collect()]
    bounds = asked.bounds([(b.terms, b.maxima) for b in blocks])[0]
    assert least[0] > 0 and (bounds >= least[0]).sum() < len(blocks) / 10
    got = [(r["doc_id"], r["score"]) for r in lexical.best(held, asked, least, 10).orderBy("rank").collect()]
    assert got == [r[2:] for r in lexical.plain(docs, [(1, "common rare")], 10)]
