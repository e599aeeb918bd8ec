"""Session factory with the settings that the operators are written for."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch that goes to Python, about; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def build_session(app: str = "tesserae", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; on a cluster, master and sizes come from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share, of spark.checkpoint.dir. Only a local session without one gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tesserae-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for the tables that are written in here goes with each write, and doesn't stand on disks until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds in bytes, so that a worker's memory doesn't follow the lengths of rows; a lower bound of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = re.fullmatch(r"(\d+)([kmgt]?)b?", spark.conf.get(name).strip().lower())
    if not held or not 0 < int(held[1]) * 1024 ** " kmgt".index(held[2] or " ") <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
