"""Paged listings as Spark data sources: by offset in date windows, and by an opaque cursor.

The transport is a picklable function, so a service, a folder of landed pages or a test
stands behind the same source. A window is a partition; windows are read in parallel and a
lost task asks for its own window again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as SqlWindow
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: ``fetch(window, cursor)`` gives the entries of a page (tuples in the schema's order) and the next cursor, None at the end.
Fetch = Callable[[tuple[str, str] | None, object], tuple[list[tuple], object]]


class Window(InputPartition):
    def __init__(self, span: tuple[str, str] | None):
        self.span = span


class _Reader(DataSourceReader):
    def __init__(self, windows: list[tuple[str, str] | None], fetch: Fetch, first: object, stop: Callable[[tuple], bool] | None):
        self.windows, self.fetch, self.first, self.stop = windows, fetch, first, stop

    def partitions(self) -> list[Window]:
        return [Window(w) for w in self.windows]

    def read(self, partition: Window) -> Iterator[tuple]:
        cursor = self.first
        while cursor is not None:
            entries, cursor = self.fetch(partition.span, cursor)
            for entry in entries:
                if self.stop and self.stop(entry):
                    return  # a listing is newest first: all behind is older
                yield entry
            if not entries:
                return


def read_pages(spark: SparkSession, schema: str, fetch: Fetch, windows: list[tuple[str, str] | None] = (None,), first: object = 0, stop: Callable[[tuple], bool] | None = None) -> DataFrame:
    """All entries of a paged listing.

    ``windows`` are date spans (see ``io.windows``), each read by a task of its own from the
    cursor ``first`` on: a number for offsets, any value for opaque cursors. ``stop`` ends a
    window at the first entry that it is true for.
    """
    name, spans = f"pages_{abs(hash((schema, id(fetch))))}", list(windows)

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Reader(spans, fetch, first, stop)

    spark.dataSource.register(Pages)
    return spark.read.format(name).load()


def by_offset(total: Callable, page: Callable, size: int = 500) -> Fetch:
    """A fetch of ``page(window, offset, size)`` up to ``total(window)`` entries."""

    def fetch(window, offset):
        entries = page(window, offset, size)
        return entries, (offset + size if entries and offset + size < total(window) else None)

    return fetch


def land(rows: DataFrame, folder: str, window: str, size: int, *order: Column | str) -> None:
    """Rows as the pages of a listing that has been fetched: a folder for each window and number of a page, ``size`` rows each."""
    nth = F.row_number().over(SqlWindow.partitionBy(window).orderBy(*order)) - 1
    entries = rows.withColumn("__page", F.floor(nth / size)).withColumn("__nth", nth)
    pages = entries.groupBy(F.col(window).alias("window"), F.col("__page").alias("page")).agg(F.array_sort(F.collect_list(F.struct("__nth", *rows.columns))).alias("entries"))  # ``size`` rows
    pages.write.partitionBy("window", "page").json(folder)


def landed(folder: str, fields: list[str], size: int) -> Fetch:
    """A fetch of landed pages by offset; tasks read them from the store that the folder's address names. A missing page is the end."""

    def page(span, offset, _):
        from pyarrow.fs import FileSelector, FileSystem  # where it is used: the process that tasks are forked from stays single-threaded

        files, path = FileSystem.from_uri(f"{folder}/window={span[0]}/page={offset // size}")
        found = files.get_file_info(FileSelector(path, allow_not_found=True))
        out = []
        for f in sorted(x.path for x in found if x.path.endswith(".json")):
            with files.open_input_stream(f) as stream:
                out += [e for line in stream.read().decode().splitlines() if line for e in json.loads(line)["entries"]]
        return [tuple(e.get(c) for c in fields) for e in out]

    return by_offset(lambda _: float("inf"), page, size)


def chained(folder: str, fields: list[str]) -> Fetch:
    """A fetch of landed pages that name the next one: ``cursor=X`` holds ``entries`` and ``next``."""

    def fetch(_, cursor):
        from pyarrow.fs import FileSelector, FileSystem

        files, path = FileSystem.from_uri(f"{folder}/cursor={cursor}")
        found = [x.path for x in files.get_file_info(FileSelector(path, allow_not_found=True)) if x.path.endswith(".json")]
        if not found:
            return [], None
        with files.open_input_stream(found[0]) as stream:
            held = json.loads(stream.read().decode().splitlines()[0])
        return [tuple(e.get(c) for c in fields) for e in held["entries"]], held.get("next")

    return fetch
