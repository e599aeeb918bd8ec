"""Folds over streams in the order of event time, whatever order the events arrive in.

A key's events wait in its state until the watermark has passed them and are then folded, in order of (time, number), into the
value that the state keeps; so what is held for a key is that value and the events of the watermark's delay. After each
micro-batch a key that had events shows the value with the waiting ones folded in as well: a result that later events may
still mend. Repeated events (of one number) count once while they wait; what comes later than the watermark is dropped.

Learned scores, whose sources have few events a range of time, are a streaming aggregate instead (`score_ranges`).

The results go to a folder by `upsert`, an update log that names each batch's rows by the batch's number, so that a batch
which runs again writes the same; `latest` reads the last row of each key.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000
#: Batches of an update log after which it is folded into one table.
FOLD = 50


class OrderedFold(StatefulProcessor):
    """start: a key's first value; step(value, time in ms, event) the next one; show(value) the output's fields; ends(value) the time in ms at which it changes by itself, or None, and ended(value) what it is then. Values and events are JSON."""

    def __init__(self, start: Any, step: Callable[[Any, int, Any], Any], show: Callable[[Any], dict], ends: Callable[[Any], int | None] = lambda value: None, ended: Callable[[Any], Any] = lambda value: value):
        self.start, self.step, self.show, self.ends, self.ended = start, step, show, ends, ended

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", "value string")
        self.waiting = handle.getListState("waiting", "seq long, at long, event string")

    def _folded(self, value: Any, events: list[tuple[int, int, str]]) -> Any:
        for at, _, event in sorted(events):
            value = self.step(self._until(value, at), at, json.loads(event))
        return value

    def _until(self, value: Any, now: int) -> Any:
        """The value as time alone has changed it."""
        end = self.ends(value)
        return self.ended(value) if end is not None and end <= now else value

    def _advance(self, watermark: int, new: list[tuple[int, int, str]]) -> Any:
        """Fold what the watermark has passed, keep it, and return the value with the rest folded in.

        A key's events (seq, at, event) are read and written as a list, since each call to the state is a trip to the JVM.
        """
        held = self.value.get()
        value, self.shown = json.loads(held[0]) if held is not None else (self.start, 0)
        held = [tuple(row) for row in self.waiting.get()] if self.waiting.exists() else []
        by_seq = {seq: (at, seq, event) for seq, at, event in [*held, *new]}
        waiting = list(by_seq.values())
        passed = [e for e in waiting if e[0] <= watermark]
        if passed:
            value = self._folded(value, passed)
        rest = [(seq, at, event) for at, seq, event in waiting if at > watermark]
        if not rest:
            self.waiting.clear()
        elif passed or len(by_seq) < len(held) + len(new):
            self.waiting.put(rest)
        elif new:
            self.waiting.appendList(new)
        value = self._until(value, watermark)
        self.shown += 1
        self.value.update((json.dumps([value, self.shown]),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        end = self.ends(shown := self._folded(value, [e for e in waiting if e[0] > watermark]))
        if end is not None:
            self.handle.registerTimer(max(end, watermark + 1))
        return shown

    def _rows(self, key: tuple, value: Any) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([{"key": key[0], **self.show(value), "order": self.shown}])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        new = [e for frame in rows for e in zip(frame["seq"].tolist(), frame["at"].tolist(), frame["event"].tolist(), strict=True)]
        yield from self._rows(key, self._advance(watermark, new))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._rows(key, self._advance(timerValues.getCurrentWatermarkInMs(), []))

    def close(self) -> None:
        pass


def _stored_on_disk(spark: SparkSession) -> None:
    """Streams that start from now on keep their state in files and not in the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def folded(stream: DataFrame, fold: OrderedFold, fields: str, *, delay: str) -> DataFrame:
    """The updates (key, the fold's fields, and `order`, which counts a key's updates) of a stream of key (string), ts (timestamp), seq (long, one for each event) and event (JSON)."""
    _stored_on_disk(stream.sparkSession)
    slim = stream.select("key", "ts", "seq", F.unix_millis("ts").alias("at"), "event").withWatermark("ts", delay)
    return slim.groupBy("key").transformWithStateInPandas(statefulProcessor=fold, outputStructType=f"key string, {fields}, order long", outputMode="Update", timeMode="EventTime")


def upsert(updates: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over what there is and add each micro-batch's rows to an update log; every FOLD batches the log becomes one table."""
    spark = updates.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if number and number % FOLD == 0:
            latest(spark, path, until=number).drop("batch").write.mode("overwrite").parquet(f"{path}-folded/until={number}")

    updates.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, path: str, until: int | None = None) -> DataFrame:
    """The last row of each key in an update log, by batch and, in a batch that gives a key several rows (its events, then its timer), by `order`."""
    log = spark.read.option("basePath", path).parquet(path)
    base, first = None, -1
    try:
        tables = spark.read.parquet(f"{path}-folded")
        done = sorted(r[0] for r in tables.select("until").distinct().collect() if until is None or r[0] < until)
        if done:
            first, base = done[-1], tables.filter(F.col("until") == done[-1]).drop("until").withColumn("batch", F.lit(done[-1]))
    except AnalysisException:
        pass
    log = log.filter(F.col("batch") > first)
    if until is not None:
        log = log.filter(F.col("batch") <= until)
    rows = log if base is None else log.unionByName(base)
    rest = [c for c in rows.columns if c not in ("key", "batch")]
    return rows.groupBy("key").agg(F.max_by(F.struct(*rest, "batch"), F.struct("batch", "order")).alias("_row")).select("key", "_row.*")


# --- jobs ------------------------------------------------------------------------------------------------------------

#: What a job may be. Only one that isn't running and hasn't completed can start; one that runs for a day is given up.
NEW, RUNNING, COMPLETED, FAILED, EXPIRED = "new", "running", "completed", "failed", "expired"


def job_step(value: list, at: int, event: str) -> list:
    """The job (status, since, starts, refused) after a request, or the end of the work (done or failed), at a time in ms."""
    status, since, starts, refused = value
    if event == "request":
        return [status, since, starts, refused + 1] if status in (RUNNING, COMPLETED) else [RUNNING, at, starts + 1, refused]
    if status == RUNNING:
        return [COMPLETED if event == "done" else FAILED, at, starts, refused]
    return value


def job_ends(value: list) -> int | None:
    return value[1] + DAY_MS if value[0] == RUNNING else None


JOBS = OrderedFold([NEW, None, 0, 0], job_step, lambda v: {"status": v[0], "since": v[1], "starts": v[2], "refused": v[3]}, job_ends, lambda v: [EXPIRED, v[1] + DAY_MS, v[2], v[3]])
JOB_FIELDS = "status string, since long, starts long, refused long"


def jobs(stream: DataFrame, *, delay: str = "1 hour") -> DataFrame:
    """The states of jobs from requests and ends; stream: key, ts, seq, event (`request`, `done` or `failed` as JSON strings)."""
    return folded(stream, JOBS, JOB_FIELDS, delay=delay)


# --- learned scores --------------------------------------------------------------------------------------------------


def score_fold(step: float, least: float, most: float) -> Callable[[Column], Column]:
    """A range's clamped steps as one function x -> min(high, max(low, x + add)) of an array of (ts, seq, success) in order; an event is whether it was a success."""

    def after(a: Column, e: Column) -> Column:
        move = F.when(e["success"], F.lit(float(step))).otherwise(F.lit(-float(step)))
        clamped = lambda x: F.least(F.lit(float(most)), F.greatest(F.lit(float(least)), x + move))
        return F.struct((a["add"] + move).alias("add"), clamped(a["low"]).alias("low"), clamped(a["high"]).alias("high"))

    first = F.struct(F.lit(0.0).alias("add"), F.lit(-1e300).alias("low"), F.lit(1e300).alias("high"))
    return lambda events: F.aggregate(events, first, after)


def score_ranges(log: DataFrame, fold: Callable[[Column], Column], *, hours: int = 24, delay: str = "1 hour") -> DataFrame:
    """The updates (key, add, low, high, order) of the function of each source's events in each range of time; a busy source is many keys. log: url, ts, seq, success.

    The state is that of a streaming aggregate: a range's different events, so that repeated ones count once, until the watermark
    has passed its end. What comes later than that is dropped. No key is a call to Python, as sources with few events a range have
    about as many keys as events.
    """
    _stored_on_disk(log.sparkSession)
    events = F.collect_set(F.struct("ts", "seq", "success")).alias("events")
    held = log.withWatermark("ts", delay).groupBy(F.window("ts", f"{hours} hours"), "url").agg(events)
    part = F.expr(f"cast(unix_seconds(window.start) div {3600 * hours} as string)")
    made = held.select(F.concat_ws("\n", part, "url").alias("key"), fold(F.sort_array("events")).alias("f"), F.size("events").cast("long").alias("order"))
    return made.select("key", "f.add", "f.low", "f.high", "order")


def composed(ranges: DataFrame, start: float) -> DataFrame:
    """(url, score): the ranges' functions applied in order of time."""
    each = ranges.select(F.substring_index("key", "\n", 1).cast("long").alias("part"), F.expr("if(instr(key, '\\n') > 0, substring(key, instr(key, '\\n') + 1), null)").alias("url"), "add", "low", "high")
    whole = each.groupBy("url").agg(F.sort_array(F.collect_list(F.struct("part", "add", "low", "high"))).alias("p"))
    return whole.select("url", F.aggregate("p", F.lit(start), lambda a, x: F.least(x["high"], F.greatest(x["low"], a + x["add"]))).alias("score"))
