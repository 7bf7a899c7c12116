"""Search and page fetches as data sources: partitions are planned by a query's quota, or by host.

``spark.dataSource.register(WebSearch)``, then ``spark.read.format("web_search").options(...).load()``. What answers is a
provider named by an option (``package.module:function``), as a data source has only texts as options; :func:`recorded_search`
and :func:`recorded_pages` answer from stored tables.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from importlib import import_module
from urllib.parse import urlsplit
from zlib import crc32

import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ready

FOUND = "ord long, query string, title string, url string, content string, score double, error string"
FETCHED = "url string, host string, final_url string, status_code int, content_type string, body binary, error string"


@dataclass
class Asked(InputPartition):
    """A query, its place in the plan and how many answers it may have."""

    idx: int
    query: str
    quota: int


@dataclass
class Hosts(InputPartition):
    """Addresses by host; one task asks a host, one address after the other."""

    addresses: dict[str, list[str]]


def provider(spec: str, options: dict) -> Callable:
    """The function that ``package.module:function`` makes of the options."""
    module, _, name = spec.partition(":")
    return getattr(import_module(module), name)(options)


def shares(most: int, n: int) -> list[int]:
    """``most`` in ``n`` equal parts, the remainder to the first ones."""
    return [most // n + (k < most % n) for k in range(n)]


class SearchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[Asked]:
        queries = list(dict.fromkeys(q for q in json.loads(self.options["queries"]) if q and q.strip()))
        quotas = shares(int(self.options.get("most", 10)), len(queries)) if queries else []
        return [Asked(k, q, n) for k, (q, n) in enumerate(zip(queries, quotas, strict=True)) if n > 0] or [Asked(0, "", 0)]

    def read(self, partition: Asked) -> Iterator[tuple]:
        """Answers of one query in their order, no more than its quota; a query that fails is a row with its error."""
        if not partition.quota:
            return
        try:
            found = provider(self.options["provider"], self.options)(partition.query, partition.quota)
            for k, a in enumerate(found[: partition.quota]):
                yield (partition.idx * 1_000_000 + k, partition.query, a.get("title"), a.get("url"), a.get("content"), a.get("score"), None)
        except Exception as e:
            yield (partition.idx * 1_000_000, partition.query, None, None, None, None, f"{type(e).__name__}: {e}")


class WebSearch(DataSource):
    """Options: ``queries`` (a JSON list), ``most`` (answers over all queries, 10), ``provider``, and what that reads."""

    @classmethod
    def name(cls) -> str:
        return "web_search"

    def schema(self) -> str:
        return FOUND

    def reader(self, schema) -> SearchReader:
        return SearchReader(self.options)


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[Hosts]:
        tasks = int(self.options.get("tasks", 32))
        dealt: dict[int, dict[str, list[str]]] = {}
        for url in dict.fromkeys(json.loads(self.options["addresses"])):
            host = urlsplit(url).netloc.lower()
            dealt.setdefault(crc32(host.encode()) % tasks, {}).setdefault(host, []).append(url)
        return [Hosts(v) for _, v in sorted(dealt.items())] or [Hosts({})]

    def read(self, partition: Hosts) -> Iterator[tuple]:
        get = provider(self.options["provider"], self.options) if partition.addresses else None
        for host, urls in partition.addresses.items():
            for url in urls:
                try:
                    body, status, final, headers = get(url)
                    kind = {k.lower(): v for k, v in headers.items()}.get("content-type", "")
                    yield (url, host, final, status, kind, bytes(body), None)
                except Exception as e:
                    yield (url, host, None, None, None, None, f"{type(e).__name__}: {e}")


class WebPages(DataSource):
    """Options: ``addresses`` (a JSON list, a run's batch), ``tasks`` (32), ``provider``, and what that reads. All addresses of a host are asked by one task."""

    @classmethod
    def name(cls) -> str:
        return "web_pages"

    def schema(self) -> str:
        return FETCHED

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)


def _stored(options: dict) -> ds.Dataset:
    system, path = fs.FileSystem.from_uri(options["answers"])
    return ds.dataset(path, filesystem=system, format="parquet", exclude_invalid_files=True)


def recorded_search(options: dict) -> Callable[[str, int], list[dict]]:
    """Answers (query, rank, title, url, content, score) of a stored table, best rank first; only a query's own rows are read."""
    data = _stored(options)

    def find(query: str, most: int) -> list[dict]:
        return data.to_table(filter=pc.field("query") == query).sort_by("rank").slice(0, most).to_pylist()

    return find


def recorded_pages(options: dict) -> Callable[[str], tuple]:
    """Responses (url, body, status_code, content_type) of a stored table; an address that is not there is an error."""
    data = _stored(options)

    def get(url: str) -> tuple:
        found = data.to_table(filter=pc.field("url") == url).to_pylist()
        if not found:
            raise KeyError("no recorded response")
        return found[0]["body"], found[0]["status_code"], url, {"Content-Type": found[0]["content_type"]}

    return get


def search(spark: SparkSession, queries: list[str], spec: str, most: int = 10, **options: str) -> DataFrame:
    """The answers to a plan's queries, a task per query."""
    ready(spark).dataSource.register(WebSearch)
    return spark.read.format("web_search").options(queries=json.dumps(queries), most=str(most), provider=spec, **options).load()


def fetch(spark: SparkSession, addresses: list[str], spec: str, tasks: int = 32, **options: str) -> DataFrame:
    """The responses to a batch's addresses, a task for the addresses of some hosts."""
    ready(spark).dataSource.register(WebPages)
    return spark.read.format("web_pages").options(addresses=json.dumps(addresses), tasks=str(tasks), provider=spec, **options).load()
