"""Streams cut into files that arrive out of order and repeatedly, and restarted between them, end where a batch over all events does."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import feedback
from tesserae.session import shared_base
from tesserae.streaming import feeds, ordered

HOUR = 3_600_000
START = 1_700_000_000_000


def folder(spark):
    return f"{shared_base(spark)}/stream-{os.urandom(6).hex()}"


def arrive(spark, path, batches, schema):
    """Runs `go` after each batch of rows has arrived as a file of its own."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{k:03d}")
        yield k


def shuffled(events, reach, seed):
    """The events in batches; each may come up to `reach` ms later than those after it, and some come twice."""
    pick = random.Random(seed)
    late = sorted(events, key=lambda e: e[1] + pick.random() * reach)
    late = [x for e in late for x in ([e, e] if pick.random() < 0.2 else [e])]
    cuts = sorted(pick.sample(range(1, len(late)), 4))
    return [late[a:b] for a, b in zip([0, *cuts], [*cuts, len(late)])]


def plain_jobs(events, watermark):
    out = {}
    for key, at, _, event in sorted(set(events), key=lambda e: (e[1], e[2])):
        value = out.get(key, ordered.JOBS.start)
        if (end := ordered.job_ends(value)) is not None and end <= at:
            value = ordered.JOBS.ended(value)
        out[key] = ordered.job_step(value, at, json.loads(event))
    for key, value in out.items():
        if (end := ordered.job_ends(value)) is not None and end <= watermark:
            out[key] = ordered.JOBS.ended(value)
    return {k: tuple(v) for k, v in out.items()}


def test_jobs_out_of_order_and_restarted(spark):
    pick = random.Random(4)
    events = []
    for seq in range(220):
        key = f"k{pick.randint(0, 5)}"
        events.append((key, START + pick.randint(0, 12 * 24) * HOUR // 2 + seq, seq, json.dumps(pick.choices(["request", "done", "failed"], [4, 1, 1])[0])))
    events.append(("alone", START, 1000, '"request"'))  # nothing else comes of this one: its timer expires it
    base, schema = folder(spark), "key string, at long, seq long, event string"
    for _ in arrive(spark, f"{base}/in", shuffled(events, 0.9 * HOUR, 1), schema):
        # A new query each time, which goes on from the checkpoint.
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/in").withColumn("ts", F.timestamp_millis("at"))
        ordered.upsert(ordered.jobs(stream), f"{base}/log", f"{base}/checkpoint")
    got = {r["key"]: (r["status"], r["since"], r["starts"], r["refused"]) for r in ordered.latest(spark, f"{base}/log").collect()}
    assert got == plain_jobs(events, max(e[1] for e in events) - HOUR)
    assert got["alone"] == ("expired", START + 24 * HOUR, 1, 0)
    assert {v[0] for v in got.values()} >= {"completed", "expired"} and any(v[3] for v in got.values())


def test_running_then_completed_in_one_batch(spark):
    base, schema = folder(spark), "key string, at long, seq long, event string"
    for _ in arrive(spark, f"{base}/in", [[("a", START + 2, 2, '"done"'), ("a", START + 1, 1, '"request"')]], schema):
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/in").withColumn("ts", F.timestamp_millis("at"))
        ordered.upsert(ordered.jobs(stream), f"{base}/log", f"{base}/checkpoint")
    assert [(r["key"], r["status"]) for r in ordered.latest(spark, f"{base}/log").collect()] == [("a", "completed")]


def test_scores_out_of_order(spark, monkeypatch):
    """Late and repeated feedback, and an update log that is folded on the way: the scores of the batch operator."""
    monkeypatch.setattr(ordered, "FOLD", 2)
    pick = random.Random(9)
    events = [(f"u\n{pick.randint(0, 3)}", START + pick.randint(0, 90) * HOUR + seq, seq, pick.random() < 0.6) for seq in range(300)]
    base, schema = folder(spark), "url string, at long, seq long, success boolean"
    fold = ordered.score_fold(feedback.STEP, feedback.LEAST, feedback.MOST)
    for _ in arrive(spark, f"{base}/in", shuffled(events, 0.9 * HOUR, 2), schema):
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/in").withColumn("ts", F.timestamp_millis("at"))
        ordered.upsert(ordered.score_ranges(stream, fold, hours=6), f"{base}/log", f"{base}/checkpoint")
    got = {r["url"]: round(r["score"], 9) for r in ordered.composed(ordered.latest(spark, f"{base}/log"), feedback.START).collect()}
    batch = spark.createDataFrame(events, schema).withColumn("ts", F.timestamp_millis("at"))
    assert got == {r["url"]: round(r["score"], 9) for r in feedback.scores(batch).collect()} and len(got) == 4


def test_complete_results_go_to_a_table(spark, data):
    base = folder(spark)
    found = feeds.run_once(feeds.counts(feeds.feedback(feeds.events(spark, data))), f"{base}/counts", f"{base}/checkpoint")
    log = feeds.feedback(spark.read.parquet(f"{data}/events.parquet"))
    assert sorted(map(tuple, found.select("query", "url", "success_count", "failure_count").collect())) == sorted(map(tuple, feedback.rollup(log).drop("affinity").collect()))


@pytest.mark.parametrize("text, wanted", [("request request done request failed", ("completed", 1, 2)), ("failed done", ("new", 0, 0)), ("request failed request", ("running", 2, 0))])
def test_job_steps(text, wanted):
    value = ordered.JOBS.start
    for at, event in enumerate(text.split()):
        value = ordered.job_step(value, at, event)
    assert (value[0], value[2], value[3]) == wanted
