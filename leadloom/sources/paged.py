"""Landed list pages as a data source: spark.read.format("landed_pages") and spark.readStream.

A landing folder, on any file system that pyarrow.fs knows by its URI, holds one JSON file per page of a list, in the
order of their paths (below it, so page=000001/part-0.txt is as good as 000001.json):

    {"data": [{"id": "ch_1", ...}, ...], "has_more": true, "starting_after": "ch_0"}

A page that others follow names its cursor by its last entry; the next page must start after it. Each
page is a partition, parsed by the executors with nothing of it on the driver but its name. The stream's
offset is the number of pages read, and the cursor to go on with: pages that land later are read from there, and a page
that doesn't start after the cursor fails the query instead of skipping entries."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

NAME = "landed_pages"


class CursorLost(Exception):
    """A page doesn't go on where the one before it ended."""


class Page(InputPartition):
    def __init__(self, path: str, before: str | None, number: int) -> None:
        self.path, self.before, self.number = path, before, number


def _file_system(folder: str) -> tuple[fs.FileSystem, str]:
    # Hadoop writes file:/tmp for file:///tmp.
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def _pages(folder: str) -> list[str]:
    system, path = _file_system(folder)
    found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


def _load(folder: str, path: str) -> dict:
    with _file_system(folder)[0].open_input_stream(path) as stream:
        page = json.loads(stream.read())
    if not isinstance(page.get("data"), list):
        raise CursorLost(f"{posixpath.basename(path)} has no list of entries")
    return page


def _cursor(page: dict) -> str | None:
    """The last entry's id."""
    return page["data"][-1].get("id") if page["data"] else None


def _check(page: dict, path: str, cursor: str | None) -> None:
    if page.get("starting_after") != cursor:
        raise CursorLost(f"{path} starts after {page.get('starting_after')}, not {cursor}")


class _Reader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self._folder = folder

    def partitions(self) -> list[Page]:
        there = _pages(self._folder)
        return [Page(p, there[n - 1] if n else None, n) for n, p in enumerate(there)]

    def read(self, partition: Page | None) -> Iterator[tuple]:
        """page, place, id, entry (as JSON). A page's own task looks at the page before it, so the driver opens none."""
        if partition is None:  # no pages
            return
        page = _load(self._folder, partition.path)
        if page.get("has_more") and not _cursor(page):
            raise CursorLost(f"{partition.path}: pagination cursor missing")
        if partition.before:
            before = _load(self._folder, partition.before)
            if not before.get("has_more"):
                raise CursorLost(f"{partition.before} says that no page follows")
            _check(page, partition.path, _cursor(before))
        for place, entry in enumerate(page["data"]):
            yield partition.number, place, entry.get("id"), json.dumps(entry, sort_keys=True, ensure_ascii=False)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, folder: str) -> None:
        self._folder = folder

    def initialOffset(self) -> dict:
        return {"pages": 0, "cursor": None}

    def latestOffset(self) -> dict:
        there = _pages(self._folder)
        return {"pages": len(there), "cursor": _cursor(_load(self._folder, there[-1])) if there else None}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        new = _Reader(self._folder).partitions()[start["pages"] : end["pages"]]
        if start["pages"] and new:
            _check(_load(self._folder, new[0].path), new[0].path, start["cursor"])
        return new

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from _Reader(self._folder).read(partition)

    def commit(self, end: dict) -> None:
        """Landed pages stay."""


class LandedPages(DataSource):
    """Options: path, the landing folder, which driver and executors see."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "page long, place long, id string, entry string"

    def _folder(self) -> str:
        if "path" not in self.options:
            raise ValueError("path names the landing folder")
        return self.options["path"]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._folder())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self._folder())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LandedPages)
