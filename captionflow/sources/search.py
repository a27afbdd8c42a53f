"""A paginated search source with an offline reader: pages come from stored responses, not from the network."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Page(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def partitions(self) -> list[_Page]:
        return [_Page(str(p)) for p in sorted(Path(self.folder).glob("*.json"))] or [_Page("")]

    def read(self, partition: _Page) -> Iterator[tuple]:
        if partition.path:
            path = Path(partition.path)
            name, _, offset = path.stem.rpartition("_")
            body = path.read_text(encoding="utf-8")
            try:
                json.loads(body)
            except ValueError:
                return
            yield name, int(offset) if offset.isdigit() else 0, body


class StoredSearch(DataSource):
    """``spark.read.format("stored_search").load(folder)``: (name, offset, body) of files ``name_offset.json``; broken pages are skipped."""

    @classmethod
    def name(cls) -> str:
        return "stored_search"

    def schema(self) -> str:
        return "name string, offset int, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(StoredSearch)
