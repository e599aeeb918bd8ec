"""Cases that a review of round 4 found."""

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tesserae.operators import feedback, inverted, search
from tesserae.streaming import ordered


def plain_vectors(docs, most):
    """TF-IDF as its SQL has it: the rows of a document put together, terms chosen by count and name."""
    tf = Counter()
    for key, text in docs:
        words = [w for w in re.findall(r"\w{2,}", (text or "").lower()) if w not in search.STOP_WORDS]
        tf.update((key, t) for t in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))])
    cf, df = Counter(), Counter(t for _, t in tf)
    for (_, t), n in tf.items():
        cf[t] += n
    chosen = sorted(cf, key=lambda t: (-cf[t], t))[:most]
    x = {(key, t): (1 + math.log(n)) * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for (key, t), n in tf.items() if t in set(chosen)}
    norm = Counter()
    for (key, _), v in x.items():
        norm[key] += v * v
    return {k: round(v / math.sqrt(norm[k[0]]), 9) for k, v in x.items()}


def test_vectors_are_made_where_the_texts_are(spark, tmp_path):
    """No text, term or vector is shuffled, and no table of weights stands beside that of the frequencies."""
    rng = np.random.default_rng(5)
    words = ["the", "a", "x", "apple", "Pear", "ÉTÉ", "été", "_", "__", "日本", "日", "\U0001d4b3\U0001d4b3", "7", "42", "apple\npear", "a-b", ","]
    docs = [(k, " ".join(rng.choice(words, rng.integers(0, 30)))) for k in range(60)]
    docs += [(100, None), (101, ""), (102, "the a x"), (3, "apple pear"), (3, "pear"), (103, "rare " + "apple " * 50)]
    plans, cut = {}, inverted.scratch(spark, f"file://{tmp_path}")

    def seen(df, part):
        plans[part] = df._jdf.queryExecution().executedPlan().toString()
        return cut(df, part)

    for most in (1, 7, 20, 10_000):
        found = search.tfidf(spark.createDataFrame(docs, "doc_id long, text string"), seen, most=most)
        assert {(r["doc_id"], r["term"]): round(r["weight"], 9) for r in found.weights.collect()} == plain_vectors(docs, most), most
    once = [d for d in docs if d[0] != 3]
    plans.clear()
    spark.createDataFrame(once, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    found = search.tfidf(spark.read.parquet(f"{tmp_path}/docs"), seen, most=20)
    assert {(r["doc_id"], r["term"]): round(r["weight"], 9) for r in found.weights.collect()} == plain_vectors(once, 20)
    assert "Exchange" not in plans["frequencies"] and not {"weights", "hashes"} & set(plans)
    asked = spark.createDataFrame([(1, "apple pear"), (2, "nothing")], "query_id int, query string")
    plan = search.semantic(found, asked)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert {r["query_id"] for r in search.semantic(found, asked).collect()} == {1}


def test_frequent_terms_where_counters_are_shared(spark, tmp_path):
    """Few counters for many terms: exact counts all the same, also where the first choice of counters leaves a term out."""
    rng = np.random.default_rng(6)
    steep, flat = [f"w{k}" for k in (rng.pareto(0.6, 20_000) * 3).astype(int) % 9000], [f"f{k}" for k in range(6000) for _ in range(1 + (k % 7 == 0))]
    for words, most, passes in ((steep, 3, 1), (steep, 200, 1), (steep, 600, 1), (flat, 200, 2)):
        parts, cut = [], inverted.scratch(spark, f"file://{tmp_path}")
        wanted = sorted(Counter(words).items(), key=lambda x: (-x[1], x[0]))[:most]
        rows_ = spark.createDataFrame([(w,) for w in [*words, None]], "term string")
        found = search.most_frequent(rows_, most, lambda df, part, cut=cut, parts=parts: parts.append(part) or cut(df, part), size=1024)
        assert sorted((r["term"], r["cf"], r["df"]) for r in found.collect()) == sorted((w, n, n) for w, n in wanted)
        assert len(parts) == passes


def test_an_index_leaves_no_shuffle_files(spark, tmp_path):
    """What the build of an index shuffles goes with each table that it writes."""
    jvm = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def held():
        files = jvm.getAllFiles()
        return {str(f): f.length() for f in (files.apply(k) for k in range(files.size())) if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}

    before = held()
    docs = spark.range(6000).selectExpr("id as doc_id", "concat('word', id % 70, ' text ', id) as text")
    index = inverted.build(docs, f"file://{tmp_path}/index")
    # Only those of counts that came to the driver may be there.
    left = sum(size for f, size in held().items() if f not in before)
    assert index.total == 6000 and left < 10_000


def test_learned_scores_need_no_call_to_python_for_a_key(spark, tmp_path):
    """A source's events in order of microseconds, repeated in a later batch, in ranges that the watermark has passed, and of no source."""
    start, hour, schema = 1_700_000_000_000_000, 3_600_000_000, "url string, at long, seq long, success boolean"
    high = [("up", start + k, k, True) for k in range(30)] + [("up", start + 41, 41, False), ("up", start + 40, 42, True)]
    batches = [
        [*high, (None, start, 100, False)],
        [high[-2], ("up", start + 3 * hour, 200, False), ("late", start + 2 * hour + hour // 2, 201, True)],
        [("late", start + 2 * hour + hour // 2, 201, True), ("gone", start, 202, True), ("up", start + 3 * hour + 1, 203, False)],
    ]
    fold, seen = ordered.score_fold(feedback.STEP, feedback.LEAST, feedback.MOST), []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in").withColumn("ts", F.timestamp_micros("at"))
        updates = ordered.score_ranges(stream, fold, hours=1)
        assert "TransformWithState" not in updates._jdf.queryExecution().analyzed().toString()
        ordered.upsert(updates, f"file://{tmp_path}/log", f"file://{tmp_path}/checkpoint")
        found = ordered.composed(ordered.latest(spark, f"file://{tmp_path}/log"), feedback.START)
        seen.append({r["url"]: round(r["score"], 6) for r in found.collect()})
    # The range of `gone` had ended two hours before it came.
    assert seen == [{"up": 4.8, None: 0.8}, {"up": 4.6, None: 0.8, "late": 1.2}, {"up": 4.4, None: 0.8, "late": 1.2}]
