"""A JSON-RPC surface over a store of tables: a thin layer that turns requests into operators and their rows into dicts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import text
from tesserae.operators import context, inverted, search, store, substring
from tesserae.session import shared_base

PARSE_ERROR, INVALID_REQUEST, NO_METHOD, INVALID_PARAMS, INTERNAL_ERROR = -32700, -32600, -32601, -32602, -32603


def clamp(value: Any, default: int, least: int, most: int) -> int:
    """An integer argument within its bounds; what isn't a number is the default."""
    try:
        return max(least, min(most, int(value)))
    except (TypeError, ValueError):
        return default


class Server:
    """docs: doc_id, url, title, content, domain, scraped_at, learned, affinity. The indexes are built once and reused."""

    def __init__(self, spark: SparkSession, docs: DataFrame):
        self.spark, self.docs = spark, docs
        self.folder = f"{shared_base(spark)}/server-{uuid.uuid4().hex}"
        self.index = inverted.build(docs, f"{self.folder}/stems", fields=["title", "content"])
        self.grams = substring.build(docs, f"{self.folder}/grams")
        self.tools: dict[str, Callable[[dict], Any]] = {"search_docs": self.search, "get_doc": self.get, "list_docs": self.list, "get_context": self.get_context, "get_index_stats": self.stats}
        self.prompts = {"build_feature": (3, 3), "debug_code": (3, 2), "explain_api": (4, 3)}

    def _one(self, query: str) -> DataFrame:
        return self.spark.createDataFrame([(1, query)], "query_id int, query string")

    def _found(self, asked: DataFrame, limit: int) -> DataFrame:
        return search.tiered(self.docs, self.index, self.grams, asked, inverted.scratch(self.spark, self.folder), limit=limit).join(self.docs, "doc_id")

    def search(self, args: dict) -> list[dict]:
        limit = clamp(args.get("limit"), 10, 1, 25)
        hits = self._found(self._one(str(args["query"])), limit)
        return [r.asDict() for r in hits.orderBy("rank").select("url", "title", F.substring("content", 1, 400).alias("snippet"), "tier", "final_score").collect()]

    def get(self, args: dict) -> dict | None:
        from tesserae.sources import readers

        wanted = self.spark.createDataFrame([(1, str(args["url"]))], "query_id int, url string")
        row = readers.lookup(self.docs.select("doc_id", "url", "title", "content"), wanted).first()
        return row and {k: row[k] for k in ("url", "title", "content")}

    def list(self, args: dict) -> list[str]:
        limit = clamp(args.get("limit"), 50, 1, 200)
        return [r["url"] for r in self.docs.orderBy(F.desc("scraped_at"), F.desc("doc_id")).limit(limit).select("url").collect()]

    def get_context(self, args: dict) -> str:
        asked = self._one(str(args["query"]))
        hits = self._found(asked, 5).withColumn("variant_pos", F.lit(0))
        kept = context.diversify(context.first_per_url(hits), [F.asc("rank")]).withColumn("snippet", F.substring("content", 1, 400))
        return context.render(kept.select("query_id", "snippet", "rank"), asked).first()["context"]

    def stats(self, args: dict) -> dict:
        top = store.domains(self.docs).limit(5).collect()
        return {"total_docs": self.docs.count(), "domains": {r["domain"]: r["n"] for r in top}}

    def handle(self, line: str) -> str | None:
        """The answer to one line; notifications have none."""
        try:
            request = json.loads(line)
        except ValueError:
            return self._error(None, PARSE_ERROR, "parse error")
        if not isinstance(request, dict) or request.get("jsonrpc") != "2.0" or not isinstance(request.get("method"), str):
            return self._error(request.get("id") if isinstance(request, dict) else None, INVALID_REQUEST, "invalid request")
        name, params, number = request["method"], request.get("params") or {}, request.get("id")
        try:
            result = self._call(name, params)
        except LookupError as error:
            return self._error(number, NO_METHOD if error.args[:1] == (name,) else INVALID_PARAMS, str(error))
        except Exception as error:  # the caller gets any failure as an answer
            return self._error(number, INTERNAL_ERROR, str(error)[:300])
        return None if "id" not in request else json.dumps({"jsonrpc": "2.0", "id": number, "result": result}, default=str, ensure_ascii=False)

    def _call(self, name: str, params: dict) -> Any:
        if name == "initialize":
            return {"serverInfo": {"name": "tesserae"}, "capabilities": {"tools": {}, "resources": {}, "prompts": {}}}
        if name == "ping":
            return {}
        if name == "tools/list":
            return {"tools": [{"name": n} for n in self.tools]}
        if name == "tools/call":
            return {"content": self.tools[params["name"]](params.get("arguments") or {})}
        if name == "resources/list":
            return {"resources": [{"uri": "docs://stats"}, {"uri": "docs://domains"}, *({"uri": "docs://" + u} for u in self.list({"limit": 25}))]}
        if name == "resources/read":
            uri = params["uri"].removeprefix("docs://")
            return self.stats({}) if uri == "stats" else [r.asDict() for r in store.domains(self.docs).collect()] if uri == "domains" else self.get({"url": uri})
        if name == "prompts/list":
            return {"prompts": [{"name": n} for n in self.prompts]}
        if name == "prompts/get":
            docs, _ = self.prompts[params["name"]]
            query = str((params.get("arguments") or {}).get("query", ""))
            intent = self._one(query).select(text.intent(F.col("query"))).first()[0]
            return {"intent": intent, "documents": self.search({"query": query, "limit": docs})}
        raise LookupError(name)

    @staticmethod
    def _error(number: Any, code: int, message: str) -> str:
        return json.dumps({"jsonrpc": "2.0", "id": number, "error": {"code": code, "message": message}})
