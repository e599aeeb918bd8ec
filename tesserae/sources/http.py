"""Pages from the network as a Spark data source: spark.read.format("pages").option("urls", "a\nb").load().

URLs are dealt to `partitions` tasks. A page that can't be fetched gives a row with its error and no content.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, status int, html string, error string"
#: Statuses after which a fetch is tried again.
RETRY = (429, 500, 502, 503, 504)


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)


class PageReader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split("\n") if u.strip()]
        self.parts = max(1, int(options.get("partitions", "8")))
        self.timeout = float(options.get("timeout", "8"))
        self.tries = max(1, int(options.get("tries", "3")))
        self.backoff = float(options.get("backoff", "0.6"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.urls[k :: self.parts]) for k in range(min(self.parts, len(self.urls)))] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for url in partition.value:
            yield self.fetch(url)

    def fetch(self, url: str) -> tuple:
        for turn in range(self.tries):
            status = None
            try:
                request = urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0 (compatible; tesserae)"})
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return url, answer.status, answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace"), None
            except urllib.error.HTTPError as error:
                status, said = error.code, str(error)
            except TimeoutError:
                return url, None, "", "timeout"
            except (OSError, ValueError) as error:
                said = str(error)
            if status is not None and status not in RETRY or turn + 1 == self.tries:
                return url, status, None, said
            time.sleep(self.backoff * 2**turn)
        return url, None, None, "not tried"
