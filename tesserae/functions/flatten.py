"""Structured texts as lines and topics: JSON and XML by path, Markdown by headings and fences, and the router between parsers."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions import html

LINES = 500
LIST_ITEMS = 5

PARSED = T.StructType(
    [
        T.StructField("content", T.StringType()),
        T.StructField("topics", T.ArrayType(T.StructType([T.StructField("heading", T.StringType()), T.StructField("content", T.StringType())]))),
        T.StructField("code_blocks", T.ArrayType(T.StructType([T.StructField("snippet", T.StringType()), T.StructField("language", T.StringType())]))),
    ]
)
_ARROW = pa.struct([("content", pa.string()), ("topics", pa.list_(pa.struct([("heading", pa.string()), ("content", pa.string())]))), ("code_blocks", pa.list_(pa.struct([("snippet", pa.string()), ("language", pa.string())])))])


def json_paths(value: object, path: str = "") -> Iterator[tuple[str, str]]:
    """Dotted paths to scalars, the first items of lists."""
    if isinstance(value, dict):
        for key, inner in value.items():
            yield from json_paths(inner, f"{path}.{key}" if path else str(key))
    elif isinstance(value, list):
        for k, inner in enumerate(value[:LIST_ITEMS]):
            yield from json_paths(inner, f"{path}[{k}]")
    else:
        yield path, "" if value is None else str(value)


def xml_paths(element: ET.Element, path: str = "") -> Iterator[tuple[str, str, bool]]:
    """Slash paths to texts (False) and attributes (True)."""
    here = f"{path}/{element.tag}"
    for name, value in element.attrib.items():
        yield f"{here}@{name}", value, True
    if element.text and element.text.strip():
        yield here, element.text.strip(), False
    for child in element:
        yield from xml_paths(child, here)


def parse_json(text: str) -> dict:
    pairs = list(json_paths(json.loads(text)))[:LINES]
    return {"content": "\n".join(f"{p}: {v[:100]}" for p, v in pairs), "topics": [{"heading": p, "content": v[:400]} for p, v in pairs], "code_blocks": [{"snippet": text[:5000], "language": "json"}]}


def parse_xml(text: str) -> dict:
    found = list(xml_paths(ET.fromstring(text)))[:LINES]
    return {"content": "\n".join(f"{p}: {v[:200]}" for p, v, a in found if not a), "topics": [{"heading": p, "content": v[:400]} for p, v, a in found if a], "code_blocks": []}


def parse_plain(text: str) -> dict:
    """Headings with what follows them, fenced code by its own fences, and a long text as a block of its own."""
    topics: list[dict] = []
    blocks: list[dict] = [{"snippet": text[:5000], "language": "text"}] if len(text) > 100 else []
    fence: list[str] | None = None
    name = ""
    for line in text.split("\n"):
        if m := re.match(r"\s*(?:```|~~~)\s*(\S*)", line):
            if fence is None:
                fence, name = [], m[1].lower() or "text"
            else:
                blocks.append({"snippet": "\n".join(fence), "language": name})
                fence = None
        elif fence is not None:
            fence.append(line)
        elif m := re.match(r"#{1,6}\s+(.*)", line):
            topics.append({"heading": m[1].strip(), "content": ""})
        elif topics and line.strip():
            topics[-1]["content"] = (topics[-1]["content"] + "\n" + line.strip()).strip()[:500]
    if fence:
        blocks.append({"snippet": "\n".join(fence), "language": name})
    return {"content": text, "topics": topics, "code_blocks": blocks}


def _parsed(kind: str, text: str | None) -> dict | None:
    text = text or ""
    try:
        return parse_json(text) if kind == "json" else parse_xml(text) if kind == "xml" else parse_plain(text) if kind == "plaintext" else None
    except (ValueError, ET.ParseError, RecursionError):
        return parse_plain(text)


def parse(files: DataFrame, *, url: str = "url", content: str = "content") -> DataFrame:
    """Files with `kind` and, of JSON, XML and plain ones, `structured`; HTML goes to html.parse. One narrow pass."""
    typed = files.withColumn("kind", html.content_type(F.col(content), F.col(url)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_parsed(k, v) for k, v in zip(batch.column("kind").to_pylist(), batch.column(content).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _ARROW)], names=[*batch.schema.names, "structured"])

    return typed.mapInArrow(run, T.StructType([*typed.schema.fields, T.StructField("structured", PARSED)]))
