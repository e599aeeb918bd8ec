"""Learned source scores and affinities from a feedback log (query, url, success, ts, seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A success or failure moves a score by STEP, between LEAST and MOST; unknown sources have START.
STEP, LEAST, MOST, START = 0.2, 0.1, 5.0, 1.0


def rollup(log: DataFrame) -> DataFrame:
    """Counts of each query and source, and their difference."""
    counted = log.groupBy("query", "url").agg(F.count_if(F.col("success")).alias("success_count"), F.count_if(~F.col("success")).alias("failure_count"))
    return counted.withColumn("affinity", F.col("success_count") - F.col("failure_count"))


def clamp_step(events, start: float = START):
    """The clamped running sum over an array of (ts, seq, delta) in order."""
    return F.aggregate(F.sort_array(events), F.lit(start), lambda a, x: F.greatest(F.lit(LEAST), F.least(F.lit(MOST), a + x["delta"])))


def scores(log: DataFrame, *, run: int = 10_000) -> DataFrame:
    """Each source's score: steps in order of time, clamped after each.

    A clamped step is the function x -> min(hi, max(lo, x + add)), and such functions compose to one of the same form. The log is
    dealt to ranges of (source, time), so a busy source or a burst lies in many of them; runs of `run` events are folded
    to one function each, then runs of such functions, and what is left of a source, some functions a range, is folded last.
    No array holds more than `run` steps, or more than there are ranges.
    """
    delta = F.when(F.col("success"), STEP).otherwise(-STEP)
    steps = log.select("url", "ts", "seq", delta.alias("add"), F.lit(LEAST).alias("lo"), F.lit(MOST).alias("hi"))
    dealt = steps.repartitionByRange("url", "ts", "seq").sortWithinPartitions("url", "ts", "seq").withColumn("at", F.monotonically_increasing_id())
    first = F.struct(F.lit(0.0).alias("add"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))

    def then(a, x):
        """x after a, both as (add, lo, hi)."""
        low = F.least(x["hi"], F.greatest(x["lo"], a["lo"] + x["add"]))
        high = F.least(x["hi"], F.greatest(x["lo"], a["hi"] + x["add"]))
        return F.struct((a["add"] + x["add"]).alias("add"), low.alias("lo"), high.alias("hi"))

    def folded(rows: DataFrame, *keys) -> DataFrame:
        runs = rows.groupBy("url", *keys).agg(F.sort_array(F.collect_list(F.struct("at", "add", "lo", "hi"))).alias("e"))
        return runs.withColumn("f", F.aggregate("e", first, then)).select("url", F.get("e", F.lit(0))["at"].alias("at"), "f.add", "f.lo", "f.hi")

    # Numbers ascend with the ranges, so runs of numbers are runs of a source's events in order.
    once = folded(dealt, F.expr(f"at div {run}"))
    whole = folded(folded(once, F.expr(f"at div {run * run}")))
    return whole.select("url", F.least(F.col("hi"), F.greatest(F.col("lo"), START + F.col("add"))).alias("score"))


def learned(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Documents with their source's score, START where there is none."""
    return docs.join(found.select("url", F.col("score").alias("learned")), "url", "left").withColumn("learned", F.coalesce("learned", F.lit(START)))


def with_affinity(results: DataFrame, rolled: DataFrame) -> DataFrame:
    """E48, H6."""
    return results.join(rolled.select("query", "url", "affinity"), ["query", "url"], "left").withColumn("affinity", F.coalesce("affinity", F.lit(0)))


def from_dwell(log: DataFrame, least_ms: int = 4000) -> DataFrame:
    """N5."""
    return log.withColumn("success", F.col("dwell_ms") >= least_ms)
