"""Pages as a data source: ``spark.read.format(...)`` over a platform's connector."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from hearthline.sources.readers import connector

SCHEMA = "url string, html string, error string"


class Urls(InputPartition):
    """The urls of one task."""

    def __init__(self, urls: list[str]):
        super().__init__(urls)
        self.urls = urls


class PageReader(DataSourceReader):
    """Fetches the urls of a partition; errors stay with their row."""

    def __init__(self, fetch: Callable[[str], str | None], urls: list[str], size: int):
        self.fetch, self.urls, self.size = fetch, urls, size

    def partitions(self) -> list[Urls]:
        return [Urls(self.urls[at : at + self.size]) for at in range(0, len(self.urls), self.size)] or [Urls([])]

    def read(self, partition: Urls) -> Iterator[tuple]:
        for url in partition.urls:
            try:
                yield url, self.fetch(url), None
            except Exception as e:  # noqa: BLE001  kept as data
                yield url, None, str(e)


def register_pages(spark: SparkSession, platform: str) -> str:
    """Make ``spark.read.format(name)`` read a platform's pages; returns the name.

    Options: ``urls``, one on each line, and ``size``, the urls of a task (100).
    """
    fetch = connector(platform)

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"pages_{platform}"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> PageReader:
            urls = [u.strip() for u in self.options.get("urls", "").splitlines() if u.strip()]
            return PageReader(fetch, urls, max(1, int(self.options.get("size", "100"))))

    spark.dataSource.register(Pages)
    return Pages.name()
