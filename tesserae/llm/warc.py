"""WARC archives: write a request, a response (or revisit) and a metadata record for each capture, read them back, and
join the three through their concurrent-to identifiers into one nested row per capture.

Payloads are the HTML in UTF-8. Of captures with equal payloads of at least MIN_REVISIT bytes, the one with the largest
page_id is stored as response, the others as revisits that name it and keep its digest and length. Files are gzipped
record by record. A partition is sorted before it is written, records are named by partition and place, and files are cut by the
payloads' bytes, so a task that runs again leaves the same files. Just the files that `write` lists are read back.

Defined results: a null html is an empty payload; null urls and page ids come back null (a null page_id counts as
least); repeated rows give a capture each, all those with the group's largest page_id as responses; extra columns of
the input are ignored; an empty table gives no captures.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm import common

#: Bytes from which equal payloads are stored once.
MIN_REVISIT = 1000
#: Parts into which the join deals each group of equal payloads.
SALTS = 64
#: Payload bytes after which a partition begins another file.
FILE_BYTES = 32 << 20
#: WARC-Date of the records; the pages carry no time of their own.
DATE = "2024-01-01T00:00:00Z"

RECORDS = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("concurrent_to", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("fields", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)
_ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("fields", pa.string()), ("payload", pa.binary())])


def marked(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_REVISIT) -> DataFrame:
    """The pages as (page_id, url, payload, digest, refers_to, refers_url): refers_to is set on those to be revisits.

    Groups are counted before anything is joined; the join deals each group of equal payloads to SALTS tasks.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    groups = (
        pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.length(payload).alias("size"), F.sha1(payload).alias("digest"))
        .filter(F.col("size") >= min_bytes)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "url")).alias("best"))
        .filter("n > 1")
        .select(F.col("digest"), F.col("best.page_id").alias("refers_to"), F.col("best.url").alias("refers_url"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    found = rows.withColumn("salt", salt).join(groups, ["digest", "salt"], "left")
    own = F.col("refers_to").isNull() | F.col("page_id").eqNullSafe(F.col("refers_to"))
    return found.select(
        "page_id",
        "url",
        "payload",
        "digest",
        F.when(~own, F.col("refers_to")).alias("refers_to"),
        F.when(~own, F.col("refers_url")).alias("refers_url"),
    )


def _headed(fields: list[tuple[str, str | None]], body: bytes) -> bytes:
    lines = "".join(f"{k}: {_plain(v)}\r\n" for k, v in fields if v is not None)
    whole = f"WARC/1.1\r\n{lines}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(whole) + squeeze.flush()


def _plain(value: str) -> str:
    """A header value on one line; exact values stand in the metadata record as JSON."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def capture(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None, name: str) -> bytes:
    """The three records of a transaction, whose identifiers come from its name."""
    ids = [f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}/{k}')}>" for k in range(3)]
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    common_fields = [("WARC-Target-URI", url), ("WARC-Date", DATE)]
    response = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", ids[1]), *common_fields, ("WARC-Payload-Digest", digest), ("Content-Type", "application/http;msgtype=response")]
    if revisit:
        response += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Target-URI", refers_url), ("WARC-Refers-To-Date", DATE)]
    host = re.sub(r"^\w+://([^/?#]*).*", r"\1", _plain(url or ""))
    request = [("WARC-Type", "request"), ("WARC-Record-ID", ids[0]), ("WARC-Concurrent-To", ids[1]), *common_fields, ("Content-Type", "application/http;msgtype=request")]
    metadata = [("WARC-Type", "metadata"), ("WARC-Record-ID", ids[2]), ("WARC-Concurrent-To", ids[1]), *common_fields, ("Content-Type", "application/warc-fields")]
    about = f"page-id: {json.dumps(page_id)}\r\nurl: {json.dumps(url)}\r\nrefers-to-page-id: {json.dumps(refers_to)}\r\n"
    return (
        _headed(request, f"GET {_plain(url or '/')} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode())
        + _headed(response, http if revisit else http + payload)
        + _headed(metadata, about.encode())
    )


def write(rows: DataFrame, folder: str, *, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write marked pages as .warc.gz files; returns (file, captures), already computed."""
    run_name = "/".join(folder.rstrip("/").split("/")[-2:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        held, size, count, files = [], 0, 0, 0

        def close() -> pa.RecordBatch:
            name = f"{task.partitionId():06d}-{files:05d}.warc.gz"
            common.put_file(f"{folder}/{name}", held, str(task.taskAttemptId()))
            return pa.RecordBatch.from_pydict({"file": [name], "captures": [count]})

        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("page_id", "url", "payload", "refers_to", "refers_url")), strict=True):
                held.append(capture(*row, f"{run_name}/{task.partitionId()}/{files}/{count}"))
                size += len(row[2] or b"")
                count += 1
                if size >= file_bytes:
                    yield close()
                    held, size, count, files = [], 0, 0, files + 1
        if held:
            yield close()

    ready = rows.sortWithinPartitions("page_id", "url", "digest")
    return common.cut(common.mapped(ready, run, "file string, captures long", __name__), folder + "-files", "written")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an archive, gzipped or not."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers.get("content-length", 0)))


def _row(headers: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    kind = headers.get("warc-type")
    digest = size = payload = fields = None
    if kind in ("response", "revisit"):
        head, _, body = block.partition(b"\r\n\r\n")
        if kind == "response":
            digest, size, payload = hashlib.sha1(body).hexdigest(), len(body), body if with_payload else None
        else:
            digest = base64.b32decode(headers.get("warc-payload-digest", "").removeprefix("sha1:")).hex()
            size = int(m[1]) if (m := re.search(rb"(?i)\ncontent-length: *(\d+)", head)) else None
    else:
        fields = block.decode("utf-8", "replace")
    return (headers.get("warc-record-id"), kind, headers.get("warc-concurrent-to"), headers.get("warc-target-uri"), headers.get("warc-date"), digest, size, fields, payload)


def read(spark: SparkSession, folder: str, written: DataFrame | None = None, *, payload: bool = True) -> DataFrame:
    """The records of the files that `written` lists, or else of all archives in a folder. Digests and lengths of responses are those of the payload as read."""

    whole = written is None

    def rows_of(data: bytes) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for headers, block in parse(data):
            rows.append(_row(headers, block, payload))
            size += len(block)
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                yield from rows_of(value.as_py() if whole else common.get_file(f"{folder}/{value.as_py()}"))

    if whole:
        return common.mapped(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content"), run, RECORDS, __name__)
    return common.mapped(common.listed(written.select("file")), run, RECORDS, __name__)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: a response or revisit with the request and metadata records that name it as concurrent.

    Records meet once, by the identifier of the capture, so archives are read once. A capture without a request or metadata record
    keeps a null there, of several that with the greatest identifier counts; records that name no capture give no row.
    """
    is_ = lambda *kinds: F.col("record_type").isin(*kinds)
    about = lambda kind, *names: F.max_by(F.struct(*names), F.when(is_(*kind), F.col("record_id")))
    beside = ("record_id", "target_uri", "date", "fields")
    of = F.when(is_("response", "revisit"), F.col("record_id")).otherwise(F.col("concurrent_to"))
    captures = (
        records.withColumn("_of", of)
        .filter("_of is not null")
        .groupBy("_of")
        .agg(
            about(("response", "revisit"), "record_id", "record_type", "target_uri", "date", "payload_digest", "payload_bytes", "payload").alias("response"),
            about(("request",), *beside).alias("request"),
            about(("metadata",), *beside).alias("metadata"),
        )
        .filter("response is not null")
    )
    field = lambda name: rf"regexp_extract(metadata.fields, '(?m)^{name}: ([^\\r\\n]*)', 1)"
    return captures.select(
        F.expr(f"try_cast(nullif({field('page-id')}, 'null') as long)").alias("page_id"),
        F.get_json_object(F.concat(F.lit('{"u":'), F.expr(field("url")), F.lit("}")), "$.u").alias("url"),
        F.expr(f"try_cast(nullif({field('refers-to-page-id')}, 'null') as long)").alias("refers_to"),
        "response",
        "request",
        "metadata",
    )
