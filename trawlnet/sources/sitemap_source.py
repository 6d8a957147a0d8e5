"""A Python data source: the pages a sitemap file lists, as rows; and as a stream that goes on where it stopped.

    spark.dataSource.register(SitemapSource)
    spark.read.format("sitemap").load("/path/sitemap.xml")
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from trawlnet.functions.sitemaps import decode_sitemap

SCHEMA = "sitemap string, pos int, kind string, loc string, lastmod string, changefreq string, priority double"


def _rows(path: str, start: int = 0, end: int | None = None) -> Iterator[tuple]:
    for i, x in enumerate(decode_sitemap(Path(path).read_bytes(), path, None)):
        if i >= start and (end is None or i < end):
            yield path, i, x["kind"], x["loc"], x["lastmod"], x["changefreq"], x["priority"]


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from _rows(partition.value)


class _Stream(SimpleDataSourceStreamReader):
    """Offset: how many entries of the file have been given; `batch` entries at a time (the loader's bounded buffer)."""

    def __init__(self, path: str, batch: int) -> None:
        self.path, self.batch = path, batch

    def initialOffset(self) -> dict:
        return {"done": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = list(_rows(self.path, start["done"], start["done"] + self.batch))
        return iter(rows), {"done": start["done"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return _rows(self.path, start["done"], end["done"])


class SitemapSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sitemap"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        at = Path(self.options["path"])
        return _Reader([str(p) for p in sorted(at.iterdir())] if at.is_dir() else [str(at)])

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(self.options["path"], int(self.options.get("batch", "200")))
