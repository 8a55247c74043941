"""A Python data source that pulls payloads from a fetcher, one partition per upstream host.

Fetchers are named by ``module:function`` and take a URL; a slow or failing
upstream fails its own rows only, which carry the error and the time taken.
"""

from __future__ import annotations

import importlib
import json
import time
from urllib.parse import urlparse

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "ord int, source string, url string, payload string, ok boolean, error string, duration_ms long"


class _Upstream(InputPartition):
    def __init__(self, specs: list[tuple[int, str, str]]):
        self.specs = specs


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.fetch, self.specs = options["fetcher"], json.loads(options["specs"])

    def partitions(self):
        hosts: dict[str, list] = {}
        for k, (source, url) in enumerate(self.specs):
            hosts.setdefault(urlparse(url).netloc, []).append((k, source, url))
        return [_Upstream(v) for v in hosts.values()]

    def read(self, partition: _Upstream):
        module, _, name = self.fetch.partition(":")
        fetch = getattr(importlib.import_module(module), name)
        for k, source, url in partition.specs:
            began = time.monotonic()
            try:
                got, error = fetch(url), None
            except Exception as e:  # noqa: BLE001  a failing upstream is a row, not a failed job
                got, error = None, str(e)
            yield k, source, url, got, error is None, error, int((time.monotonic() - began) * 1000)


class FeedSource(DataSource):
    """``spark.read.format("feed_payloads")`` with options ``fetcher`` and ``specs`` (JSON pairs of source and URL)."""

    @classmethod
    def name(cls) -> str:
        return "feed_payloads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def read_payloads(spark: SparkSession, specs: list[tuple[str, str]], fetcher: str):
    """Payloads of all specs; sort by ``ord`` for the order of the configuration."""
    spark.dataSource.register(FeedSource)
    return spark.read.format("feed_payloads").option("fetcher", fetcher).option("specs", json.dumps(specs)).load()
