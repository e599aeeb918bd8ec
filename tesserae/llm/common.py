"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae import session

#: Bytes of an Arrow batch that goes to Python, about; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20
#: Spark's setting that removes the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds in bytes, so that a worker's memory doesn't follow the lengths of texts.

    The bound is the same for all operators, so it doesn't matter when a plan runs; a session with a lower one keeps it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = re.fullmatch(r"(\d+)([kmgt]?)b?", spark.conf.get(name).strip().lower())
    if not held or not 0 < int(held[1]) * 1024 ** " kmgt".index(held[2] or " ") <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


_held: dict[str, dict] = {}


def held(module: str) -> dict:
    """What a worker keeps between the tasks of a module; what other modules have left in the worker goes."""
    if any(name != module for name in _held):
        for other in [name for name in _held if name != module]:
            del _held[other]
        give_back()
    return _held.setdefault(module, {})


def give_back() -> None:
    """Hand freed memory back to the system, where Arrow and the C library can (their heaps keep what many arrays of changing size leave)."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mapped(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str, module: str) -> DataFrame:
    """mapInArrow with bounded batches, in workers that hold only what the module keeps."""
    small_batches(rows.sparkSession)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(module)
        return run(batches)

    return rows.mapInArrow(alone, schema)


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's shared one (spark.checkpoint.dir)."""
    return f"{session.shared_base(spark)}/tesserae-{uuid.uuid4().hex}"


def cut(df: DataFrame, where: str, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage, and survives the loss of an executor.

    What the write shuffled goes with its end, and doesn't stand on disks until the driver happens to collect its garbage.
    """
    path, conf = f"{where}/{name}", df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(columns: list[str], name: str) -> str:
    """The name, with as many underscores before it as keep it apart from the columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def filesystem(uri: str) -> tuple[object, str]:
    """The Arrow file system of a URI and the path in it, usable from any worker."""
    from pyarrow import fs

    if not urlparse(uri).scheme:
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def get_file(uri: str) -> bytes:
    files, path = filesystem(uri)
    with files.open_input_stream(path) as source:
        return source.read()


def listed(files: DataFrame) -> DataFrame:
    """The rows of a list of written files, dealt so that each task gets few of them."""
    return files.repartition(max(1, min(MOST_RANGES, files.count())))


def put_file(uri: str, data: Iterable[bytes], attempt: str) -> None:
    """Write a file under a name of this attempt's own, then move it into place: a repeated task leaves one whole file."""
    files, path = filesystem(uri)
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    own = f"{path}.{attempt}.part"
    with files.open_output_stream(own) as out:
        for chunk in data:
            out.write(chunk)
    files.move(own, path)


def sliced(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Gather small batches, or cut large ones, to about `most` bytes of one string column; a longer row stands alone."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        begin = 0
        for i, n in enumerate(lengths):
            if size and size + n > most:
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                yield joined(held)
                held, size, begin = [], 0, i
            size += n
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
    if held:
        yield joined(held)


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def ascii_lower(text: str) -> str:
    """Lower-case A-Z only; other letters stay, and so do all code point offsets."""
    if text.isascii():
        return text.lower()
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


#: Ranges of ids at most, as a driver can have so many tasks; beyond that (800 GB at 8 MB each) they grow, to 1 GB at 100 TB, which a
#: task sorts with spilling and reads as a stream.
MOST_RANGES = 100_000


def range_cuts(rows: DataFrame, key: str, size: str, most: int) -> list[int]:
    """Ids that cut the rows into ranges of about `most` bytes, MOST_RANGES at most: one number for each comes to the driver."""
    total = rows.agg(F.sum(size)).first()[0]
    ranges = min(MOST_RANGES, max(1, -(-(total or 0) // most)))
    if ranges == 1:
        return []
    found = rows.agg(F.percentile_approx(key, [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0]
    return sorted({int(x) for x in found})


def _numbers(values: list[int]) -> str:
    """A constant array of numbers, one node of a plan however many there are."""
    return f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)"


def range_of(key: str, cuts: list[int]) -> Column:
    """The number of the range of column `key`: how many cuts are less than it, by binary search."""
    if not cuts:
        return F.lit(0)
    steps = len(cuts).bit_length()
    step = "greatest(0, cast(shiftright({n}, s) as int))".format(n=1 << (steps - 1))
    # `a` cuts are known to be less; the step is taken if the last cut that it would add is less too.
    return F.expr(f"aggregate(sequence(0, {steps - 1}), 0, (a, s) -> if(a + {step} <= {len(cuts)} and get({_numbers(cuts)}, a + {step} - 1) < {key}, a + {step}, a))").cast("int")


def lookup(key: str, pairs: list[tuple[int, int]]) -> Column:
    """The value of column `key` among sorted (key, value) pairs, null if there is none."""
    if not pairs:
        return F.lit(None).cast("int")
    keys, values = [k for k, _ in pairs], [v for _, v in pairs]
    at = range_of(key, keys)
    return F.when(F.get(F.expr(_numbers(keys)), at) == F.col(key), F.get(F.expr(_numbers(values)), at)).cast("int")


def join_heavy(rows: DataFrame, of: DataFrame, on: list[str], n: str, most: float, values: list[str]) -> DataFrame:
    """Inner join of rows to a table that is unique on `on`, and whose column `n` counts the rows of each key.

    Keys of `most` rows or more are joined by broadcast (there are at most all rows / `most` of them), so none is hot in
    the shuffled join of the rest, which is never a broadcast: the table grows with the input.
    """
    heavy = of.filter(F.col(n) >= most).select(*on, *(F.col(v).alias(f"_{v}") for v in values), F.lit(True).alias("_heavy"))
    split = rows.join(F.broadcast(heavy), on, "left")
    rest = split.filter(F.col("_heavy").isNull()).select(*rows.columns).join(of.filter(F.col(n) < most).select(*on, *values).hint("merge"), on)
    return split.filter(F.col("_heavy")).select(*rows.columns, *(F.col(f"_{v}").alias(v) for v in values)).unionByName(rest.select(*rows.columns, *values))
