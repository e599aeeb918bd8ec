import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tesserae.api import Server
from tesserae.plans import registry


@pytest.fixture(scope="module")
def server(spark, data):
    docs = registry.page_docs(spark, data).withColumnRenamed("id", "doc_id").withColumn("learned", F.lit(1.0)).withColumn("affinity", F.lit(0))
    return Server(spark, docs.cache())


def ask(server, method, **params):
    return json.loads(server.handle(json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})))


def test_tools(server):
    urls = ask(server, "tools/call", name="list_docs", arguments={"limit": 3})["result"]["content"]
    assert len(urls) == 3
    assert ask(server, "tools/call", name="get_doc", arguments={"url": urls[0]})["result"]["content"]["url"] == urls[0]
    hits = ask(server, "tools/call", name="search_docs", arguments={"query": "thtion", "limit": 2})["result"]["content"]
    assert len(hits) == 2 and hits[0]["tier"] == 1
    assert ask(server, "tools/call", name="get_context", arguments={"query": "fix thtion"})["result"]["content"].startswith("[ERROR]")
    assert ask(server, "resources/read", uri="docs://stats")["result"]["total_docs"] == 50


def test_errors(server):
    assert json.loads(server.handle("{"))["error"]["code"] == -32700
    assert json.loads(server.handle("[]"))["error"]["code"] == -32600
    assert ask(server, "nope")["error"]["code"] == -32601
    assert ask(server, "tools/call", name="nope")["error"]["code"] == -32602
    assert server.handle('{"jsonrpc": "2.0", "method": "ping"}') is None


def test_page_source(spark):
    from tesserae.sources.http import PageSource

    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.path == "/ok" else 404)
            self.end_headers()
            self.wfile.write("<title>é</title>".encode())

        def log_message(self, *args):
            pass

    http = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{http.server_port}"
    spark.dataSource.register(PageSource)
    got = {r["url"]: r for r in spark.read.format("pages").option("urls", f"{base}/ok\n{base}/no\nhttp://127.0.0.1:1/").option("tries", "1").load().collect()}
    http.shutdown()
    assert got[f"{base}/ok"]["html"] == "<title>é</title>" and got[f"{base}/no"]["status"] == 404 and got["http://127.0.0.1:1/"]["error"]
