"""Stored indexes: versions, deltas and compaction against a full build, pruning, substrings, windows, blocks, cascades."""

import os
import random
import re
import time

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.functions import text as tx
from tesserae.operators import inverted, search, substring
from tesserae.plans import registry
from tesserae.session import shared_base

WORDS = "run running runs license licensed apache worth worthless caring cared city cities hopping hoped relational agreed sky happy 2024 é".split()


def folder(spark, name):
    return f"{shared_base(spark)}/{name}-{os.urandom(6).hex()}"


def corpus(n, seed=1):
    pick = random.Random(seed)
    return [(k, " ".join(pick.choices(WORDS, k=pick.randint(0, 12)))) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def content(index):
    """All that an index holds, as sets of rows."""
    docs = {(r["doc_id"], tuple(r["dl"]), tuple(sorted((t["stem"], tuple(t["tf"])) for t in r["terms"]))) for r in index.docs().collect()}
    postings = sorted((r["stem"], r["doc_id"], tuple(r["tf"]), r["size"]) for r in index.postings().collect())
    terms = {(r["stem"], r["df"]) for r in index.terms().collect()}
    return docs, postings, terms, index.total, index.manifest["lengths"]


def test_versions(spark):
    """Documents added, changed and deleted in two deltas, then folded in: at each step what a full build gives; older versions stay."""
    rows = dict(corpus(60))
    index = inverted.build(frame(spark, list(rows.items())), folder(spark, "v"))
    first = content(index)
    one = {3: "brand new words", 7: None, 100: "license"}
    index = inverted.changed(index, frame(spark, list(one.items())), frame(spark, [(1, ""), (2, ""), (999, "")]))
    rows = {k: t for k, t in (rows | one).items() if k not in (1, 2)}
    assert content(index) == content(inverted.build(frame(spark, list(rows.items())), folder(spark, "w")))
    two = {3: "changed again", 4: "license license"}
    index = inverted.changed(index, frame(spark, list(two.items())))
    rows |= two
    whole = content(inverted.build(frame(spark, list(rows.items())), folder(spark, "w")))
    assert content(index) == whole and index.version == 2
    folded = inverted.compacted(index)
    assert content(folded) == whole and not folded.manifest["gone"] and folded.manifest["terms"] == [3]
    # After folding, another delta: rows of untouched buckets are older than those of folded ones.
    last = inverted.changed(folded, frame(spark, [(4, "runs")]))
    assert content(last) == content(inverted.build(frame(spark, list((rows | {4: "runs"}).items())), folder(spark, "w")))
    assert content(inverted.opened(spark, index.folder, 0)) == first and inverted.opened(spark, index.folder).version == 4


def test_a_change_writes_its_own_rows(spark):
    index = inverted.build(frame(spark, corpus(400)), folder(spark, "c"))
    new = inverted.changed(index, frame(spark, [(5, "license"), (1000, "license")]))
    assert new._read("postings", inverted._POSTINGS, [f"{new.folder}/postings/v=1"]).count() == 2
    folded = inverted.compacted(new)
    stems = {r["stem"] for r in index.docs().filter("doc_id = 5").select(F.explode("terms.stem").alias("stem")).collect()} | {"licens"}
    touched = {r[0] for r in spark.createDataFrame([(s,) for s in stems], "stem string").select(inverted.bucket_of("stem", index.buckets)).collect()}
    assert {int(b) for b, v in folded.manifest["postings"].items() if v == [2]} == touched != {int(b) for b in folded.manifest["postings"]}


def test_empty_and_odd_tables(spark):
    nothing = inverted.build(frame(spark, []), folder(spark, "e"))
    cut = registry.scratch(spark)
    asked = spark.createDataFrame([(1, "license"), (2, ""), (3, None)], "query_id int, query string")
    assert inverted.bm25(nothing, asked, cut).count() == 0 and nothing.total == 0
    grown = inverted.changed(nothing, frame(spark, [(1, "License, LICENSED"), (None, "license"), (2, "")]).withColumn("stem", F.lit("clash")))
    assert [r["doc_id"] for r in inverted.bm25(grown, asked, cut).collect()] == [1] and grown.total == 2
    assert inverted.opened(spark, folder(spark, "none")) is None


def test_only_the_buckets_of_the_query_are_read(spark):
    index = inverted.build(frame(spark, corpus(300)), folder(spark, "p"))
    held = inverted.matches(index, spark.createDataFrame([(1, "licensed")], "query_id int, query string"), registry.scratch(spark))
    (bucket,) = [r[0] for r in spark.createDataFrame([("licens",)], "stem string").select(inverted.bucket_of("stem", index.buckets)).collect()]
    plan = held.found._jdf.queryExecution().executedPlan().toString()
    filters = re.search(r"postings/v=0\].*?PartitionFilters: \[([^\]]*)", plan)[1]
    assert re.search(rf"bucket#\d+ (= {bucket}\)|IN \({bucket}\))", filters) and len(index.manifest["postings"]) > 1
    assert {r["doc_id"] for r in held.found.collect()} == {k for k, t in corpus(300) if "license" in t}


def test_stored_index_follows_the_table(spark, tmp_path):
    """A table that is written anew in its place, with the same ids, isn't searched in the index of what it was."""
    path = f"{tmp_path}/documents.parquet"
    frame(spark, [(k, "license text") for k in range(5)]).write.parquet(path)
    assert registry.ranked(spark, str(tmp_path)).filter("query_id = 1").count() == 5
    time.sleep(0.01)
    frame(spark, [(k, "another text") for k in range(5)]).write.mode("overwrite").parquet(path)
    assert registry.ranked(spark, str(tmp_path)).filter("query_id = 1").count() == 0


def test_stems_in_sql():
    """Two ways to write Porter's algorithm agree, on words made of beginnings and all endings that it knows."""
    heads = "run hop hopp fall fil relat cont sky s oper conflat radic probabl abl caress pon agre plaster mot y ayy tr bb".split()
    tails = ["", "s", "es", "ies", "sses", "ed", "eed", "ing", "y", "e", "l", "ll", *(a for a, _ in tx.STEP2 + tx.STEP3), *tx.STEP4]
    words = sorted({h + t for h in heads for t in tails} | {h + t + u for h in heads[:6] for t in tails for u in ("s", "ed", "ing", "ly")} | {"é", "été", "2024"})
    values = ", ".join(f"('{w}')" for w in words)
    found = dict(duckdb.sql("WITH " + registry._stems_sql(f"SELECT * FROM (VALUES {values}) AS v(term)") + " SELECT term, stem FROM stems").fetchall())
    assert found == {w: tx.porter(w) for w in words} and len(found) > 1500


@pytest.fixture(scope="module")
def grams(spark):
    docs = [(k, t) for k, t in corpus(200)] + [(500, None), (501, ""), (502, "a"), (503, "ab"), (504, "Été ÉTÉ x" * 3000), (505, "100% a_b")]
    held = frame(spark, docs).withColumnRenamed("text", "content").cache()
    return docs, held, substring.build(held, folder(spark, "grams"))


def test_substrings(spark, grams):
    docs, held, index = grams
    phrases = ["running", "unni", "e l", "ab", "a", "é", "été x", " ", "", None, "zzz", "run run", "% a", "_", "license apache", "\u0001", "S R"]
    asked = spark.createDataFrame(list(enumerate(phrases)), "query_id int, query string")
    found = substring.containing(held, index, asked, registry.scratch(spark))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    wanted = {(k, d) for k, p in enumerate(phrases) if (p or "").strip(" ") for d, t in docs if t is not None and p.strip(" ").lower() in t.lower()}
    assert {(r["query_id"], r["doc_id"]) for r in found.collect()} == wanted and len(wanted) > 300


def test_cascade_stops(spark):
    """A tier isn't asked for what earlier ones have answered, nor run where nothing is left."""
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "query_id int, query string")
    seen = []

    def tier(name, *answers):
        def run(left):
            seen.append((name, sorted(r["query_id"] for r in left.collect())))
            return left.filter(F.col("query_id").isin(*answers)).select("query_id", F.lit(name).alias("by"))

        return run

    got = search.cascade(asked, [tier("one", 1), tier("two", 2, 3), tier("three", 1, 2, 3)], registry.scratch(spark))
    assert sorted(map(tuple, got.collect())) == [(1, "one", 1), (2, "two", 2), (3, "two", 2)]
    assert seen == [("one", [1, 2, 3]), ("two", [2, 3])]


def test_substring_tier_reads_nothing_where_all_queries_hit(spark, grams, monkeypatch):
    docs, held, index = grams
    stems = inverted.build(held, folder(spark, "t"), fields=["content"])
    table = held.withColumns({"learned": F.lit(1.0), "affinity": F.lit(0), "scraped_at": F.col("doc_id")})
    monkeypatch.setattr(substring, "containing", lambda *a, **k: pytest.fail("the second tier ran"))
    found = search.tiered(table, stems, index, spark.createDataFrame([(1, "licensed"), (2, "sky")], "query_id int, query string"), registry.scratch(spark))
    assert {r["tier"] for r in found.collect()} == {1}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-1, 3), min_size=1, max_size=40), st.integers(1, 12))
def test_best_window(terms, words):
    hits = [(k, t) for k, t in enumerate(terms) if t >= 0]
    value = lambda at: (len({t for k, t in hits if at <= k < at + words}), sum(at <= k < at + words for k, _ in hits))
    begin = search.best_window(hits, len(terms), words)
    assert 0 <= begin <= max(0, len(terms) - words)
    assert value(begin) == max(value(at) for at in range(len(terms)))


def test_snippets(spark):
    text = "Zero one two. Three licensed four five six apache Licenses seven eight, nine ten."
    hits = spark.createDataFrame([(1, 10, text), (1, 11, None), (2, 12, "no match here"), (3, 13, "")], "query_id int, doc_id long, content string")
    asked = inverted.asked(spark.createDataFrame([(1, "license apache")], "query_id int, query string"))
    got = {r["doc_id"]: r["snippet"] for r in search.snippets(hits, asked, words=4).collect()}
    assert got == {10: "...six [apache] [Licenses] seven...", 11: "", 12: "no match here", 13: ""}
    assert search.snippet_of(text, ["licens"], 50, True) == text.replace("licensed", "[licensed]").replace("Licenses", "[Licenses]")


def test_nearest_in_blocks(spark):
    pick = np.random.default_rng(5)
    vectors = [(k, pick.integers(-3, 4, 8).astype(float).tolist()) for k in range(150)]
    rows = spark.createDataFrame([*vectors, (900, None), (901, [1.0]), (902, [None] * 8), (903, [])], "vec_id long, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(f"q{k}", x) for k, x in vectors[::4]] + [("none", None)], "query_id string, qv array<float>")
    found = search.nearest(rows, asked, limit=4, block=16, query_block=7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    wanted = set()
    for k, q in vectors[::4]:
        best = sorted((-float(np.dot(q, x)), i) for i, x in vectors)[:4]
        wanted |= {(f"q{k}", i, -s, r) for r, (s, i) in enumerate(best, 1)}
    assert {(r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in found.collect()} == wanted
