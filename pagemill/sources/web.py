"""Pages fetched over HTTP, as a data source that a job asks for by name.  Nothing else opens connections."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from http.client import HTTPException
from urllib.error import HTTPError, URLError
from urllib.request import Request, urlopen

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Time limits in seconds, and what a request says it is.
PAGE_SECONDS, API_SECONDS = 30, 10
BROWSER = "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/124.0 Safari/537.36"
ROBOT = "pagemill/1.0"


@dataclass
class FetchError(Exception):
    """``status`` is the code of an answer that is not 200, or None if there was none."""

    url: str
    status: int | None
    reason: str = ""


def _decoded(body: bytes, charset: str | None) -> str:
    """Text of an answer; a charset that nobody knows counts as UTF-8."""
    try:
        return body.decode(charset or "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def fetch_page(url: str, timeout: float = PAGE_SECONDS, agent: str = BROWSER, headers: dict[str, str] | None = None) -> str:
    try:
        with urlopen(Request(url, headers={"User-Agent": agent, **(headers or {})}), timeout=timeout) as answer:  # noqa: S310
            if answer.status != 200:
                raise FetchError(url, answer.status)
            return _decoded(answer.read(), answer.headers.get_content_charset())
    except HTTPError as e:
        raise FetchError(url, e.code, str(e.reason)) from e
    except (URLError, HTTPException, OSError, ValueError) as e:
        raise FetchError(url, None, str(e)) from e


def fetch_api(url: str, headers: dict[str, str] | None = None) -> str | None:
    """Body of an API answer, None for any failure."""
    try:
        return fetch_page(url, API_SECONDS, ROBOT, headers)
    except FetchError:
        return None


@dataclass
class _Part(InputPartition):
    urls: list[str]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.size = int(options.get("urlsPerTask", "50"))
        self.api = options.get("api", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        return [_Part(self.urls[k : k + self.size]) for k in range(0, len(self.urls), self.size)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for url in partition.urls:
            try:
                body = fetch_page(url, API_SECONDS if self.api else PAGE_SECONDS, ROBOT if self.api else BROWSER)
                yield url, body, 200, None
            except FetchError as e:
                yield url, None, e.status, e.reason


class WebPages(DataSource):
    """``spark.read.format("web_pages").option("urls", "\\n".join(urls)).load()``: url, body, status, error."""

    @classmethod
    def name(cls) -> str:
        return "web_pages"

    def schema(self) -> str:
        return "url string, body string, status int, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WebPages)
