"""Paged sources: records that a marketplace gives page after page, as a table and as a stream.

A page is a folder `connection=C/page=N/last=T` of JSON lines, N being the cursor that the page before it named and T the
greatest updated_at of its records; pages of a connection follow each other in order of updated_at. Planning lists
names, tasks read pages, one after the other: no record passes the driver. Few pages are a task each; of many, up to A_TASK
are one, so that a long drain isn't spent on starting tasks.
A stream's offset is the last page of each connection and its T, so a run that ends anywhere goes on after what it has
stored, and records of one updated_at on both sides of a page's end are neither lost nor read twice.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Records of a page, as the marketplaces give them.
PAGE = 50
#: Pages are a task each up to TASKS of them; beyond, a task has as many as that takes, but A_TASK at most.
TASKS, A_TASK = 200, 100
SCHEMA = "connection string, page int, updated_at string, external_id string, raw string"


@dataclass
class Page(InputPartition):
    connection: str
    number: int
    last: str
    path: str


@dataclass
class Pages(InputPartition):
    """Pages that one task reads."""

    pages: list[Page]


def bundled(pages: list[Page]) -> list[Pages]:
    n = min(A_TASK, max(1, -(-len(pages) // TASKS)))
    return [Pages(pages[i : i + n]) for i in range(0, len(pages), n)]


def listed(path: str) -> list[Page]:
    """All pages of a folder, by connection and number; one that was being written when its job died has no data yet."""
    fs, root = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    out = []
    for info in fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
        parts = info.path[len(root) :].strip("/").split("/")
        if info.type == pafs.FileType.Directory and len(parts) == 3:
            connection, number, last = (unquote(p.partition("=")[2]) for p in parts)  # Spark escapes what a path can't hold
            out.append(Page(connection, int(number), last, info.path))
    return sorted(out, key=lambda p: (p.connection, p.number))


class _Reader:
    def __init__(self, options: dict):
        self.path, self.since = options["path"], options.get("modifiedAfter", "")

    def pages(self) -> list[Page]:
        return [p for p in listed(self.path) if not self.since or p.last > self.since]

    def read(self, part: Pages | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # there are no pages
            return
        fs, _ = pafs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        for page in part.pages:
            yield from self.records(fs, page)

    def records(self, fs: pafs.FileSystem, page: Page) -> Iterator[pa.RecordBatch]:
        for info in sorted(fs.get_file_info(pafs.FileSelector(page.path)), key=lambda i: i.path):
            if info.type != pafs.FileType.File or info.base_name.startswith(("_", ".")):
                continue
            with fs.open_input_stream(info.path) as f:
                lines = f.read().decode().splitlines()
            rows = [(page.connection, page.number, *self.record(x)) for x in lines if x]
            rows = [r for r in rows if not self.since or r[2] is None or r[2] > self.since]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32() if i == 1 else pa.string()) for i in range(5)], ["connection", "page", "updated_at", "external_id", "raw"])

    def record(self, line: str) -> tuple[str | None, str | None, str]:
        """updated_at and id of a record; null for what isn't JSON or has none."""
        try:
            v = json.loads(line)
        except ValueError:
            return None, None, line
        v = v if isinstance(v, dict) else {}
        text = lambda x: None if x is None else str(x)
        return text(v.get("updated_at")), text(v.get("id")), line


class PagesReader(_Reader, DataSourceReader):
    def partitions(self) -> list[Pages]:
        return bundled(self.pages())


class PagesStreamReader(_Reader, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        out: dict[str, list] = {}
        for p in self.pages():
            out[p.connection] = [p.number, p.last]
        return out

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        none = [-1, ""]
        return bundled([p for p in self.pages() if start.get(p.connection, none)[0] < p.number <= end.get(p.connection, none)[0]])

    def commit(self, end: dict) -> None:
        pass


class RecordPages(DataSource):
    """`record_pages`: SCHEMA of the pages in `path`; with `modifiedAfter`, only records with a later updated_at."""

    @classmethod
    def name(cls) -> str:
        return "record_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagesReader:
        return PagesReader(self.options)

    def streamReader(self, schema) -> PagesStreamReader:  # noqa: N802
        return PagesStreamReader(self.options)


def drain(spark: SparkSession, path: str, modified_after: str | None = None) -> DataFrame:
    """All records of the pages, or those that were modified after a time; an empty or missing folder has none."""
    spark.dataSource.register(RecordPages)
    reader = spark.read.format("record_pages").option("path", path)
    return (reader.option("modifiedAfter", modified_after) if modified_after else reader).load()


def sync(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream: each batch has the pages that came since the last."""
    spark.dataSource.register(RecordPages)
    return spark.readStream.format("record_pages").option("path", path).load()


def write_pages(records: DataFrame, path: str, size: int = PAGE, first: Column | None = None) -> None:
    """Deal records (connection, updated_at, external_id, raw: JSON text) to pages of `size` in order of updated_at and id.

    first is each connection's number of its first new page (a column of connection; 0 if None). A connection's records are
    ordered in one task, which spills; nothing of them is held. A page is a file of one task.
    """
    nth = F.row_number().over(Window.partitionBy("connection").orderBy("updated_at", "external_id")) - 1
    page = F.floor(nth / size).cast("int") + (F.lit(0) if first is None else first)
    numbered = records.withColumn("page", page).withColumn("last", F.max("updated_at").over(Window.partitionBy("connection", "page")))
    # opening files takes the time, whatever the rows: a connection's pages are written by all tasks
    spread = numbered.select("connection", "page", "last", "raw").repartition(max(records.sparkSession.sparkContext.defaultParallelism, 1), "connection", "page")
    spread.write.mode("append").partitionBy("connection", "page", "last").text(path)
