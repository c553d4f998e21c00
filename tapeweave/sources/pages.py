"""A history that lands page by page, as a streaming source whose offsets are pages.

Files page-0.jsonl, page-1.jsonl and so on, each of up to `size` JSON rows, in a folder that driver and executors share
(any file system that pyarrow opens). A batch reads the pages from the last offset to the first one that is missing, each
in a task of its own; a restart from a checkpoint goes on after the last page that was read. A page that isn't full is
the history's last.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


class Page(InputPartition):
    def __init__(self, number: int) -> None:
        self.number = number


class PageReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, path: str, size: int) -> None:
        self.names = [f.name for f in schema.fields][2:]
        self.path, self.size = path, size

    def file(self, number: int) -> tuple[fs.FileSystem, str]:
        system, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        return system, f"{path}/page-{number}.jsonl"

    def landed(self, number: int) -> bool:
        system, path = self.file(number)
        return system.get_file_info(path).type == fs.FileType.File

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        known = getattr(self, "known", 0)
        while self.landed(known):
            known += 1
        self.known = known
        return {"page": known}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Page(k) for k in range(start["page"], end["page"])]

    def read(self, partition: Page) -> Iterator[tuple]:
        system, path = self.file(partition.number)
        with system.open_input_stream(path) as file:
            rows = [json.loads(x) for x in file.read().decode().splitlines() if x.strip()]
        for row in rows:
            yield (partition.number, len(rows) < self.size, *(row.get(c) for c in self.names))

    def commit(self, end: dict) -> None:
        pass


class PageSource(DataSource):
    """Options: path, and size, the rows of a full page (1000). The schema begins with page long and last boolean; the
    other columns are fields of the rows, of JSON's own types."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PageReader(schema, self.options["path"], int(self.options.get("size", "1000")))


def pages(spark: SparkSession, path: str, columns: str, size: int = 1000):
    """A stream of page, last and the given columns."""
    spark.dataSource.register(PageSource)
    return spark.readStream.format("pages").schema(f"page long, last boolean, {columns}").option("path", path).option("size", str(size)).load()
