"""Streams: feedback, misses and windows over files that arrive in a folder; folds in order of time are in `ordered`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, sf_dir: str, *, per_trigger: int | None = None) -> DataFrame:
    """The events as a stream, with a time that watermarks accept."""
    reader = spark.readStream.schema(EVENTS)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(f"{sf_dir}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def feedback(stream: DataFrame) -> DataFrame:
    """Events as feedback: purchases and clicks are successes, errors failures; the source is the user, the query the property k."""
    kept = stream.filter(F.col("event_type").isin("purchase", "click", "error"))
    return kept.select(F.get_json_object("props", "$.k").alias("query"), F.concat(F.lit("user://"), "user_id").alias("url"), (F.col("event_type") != "error").alias("success"), "ts", F.col("event_id").alias("seq"))


def misses(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each query once; state is dropped after the watermark's delay."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["query"])


def counts(log: DataFrame) -> DataFrame:
    """Running counts of each query and source, for update or complete mode."""
    return log.groupBy("query", "url").agg(F.count_if("success").alias("success_count"), F.count_if(~F.col("success")).alias("failure_count"))


def windows(stream: DataFrame, length: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """An extension: counts of events by window and type."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"))


def run_once(df: DataFrame, folder: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what there is (availableNow) into a folder, a table for each micro-batch: in complete mode the last one is the result, in append mode all are."""
    spark = df.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    tables = spark.read.parquet(folder)
    return (tables if mode == "append" else tables.filter(F.col("batch") == tables.agg(F.max("batch")).first()[0])).drop("batch")
