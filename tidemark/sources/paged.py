"""Pages of a JSON API as a data source: ``spark.read.format("paged_json")`` and ``spark.readStream.format("paged_json")``.

Whoever fetches an API lands each response as a folder ``page=<n>`` of files below one place, which hold its body. The source lists them, reads
``pagination.total_pages`` of the first page that tells it, and plans partitions of landed pages up to there, so pages are read and
parsed in parallel, without a task for each, and those past the end are never opened. A batch read takes the pages that there are. A stream's offset is a page: it
goes on to the page before the first that is not landed yet, so that every page is read once and in order, and ends at ``total_pages``.

Rows are the records of ``listings``: page, seq and the JSON text of the record. ``api_records`` reads the same of
pages in a table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME, SCHEMA = "paged_json", "page long, seq long, record string"
_ARROW = pa.schema([("page", pa.int64()), ("seq", pa.int64()), ("record", pa.string())])
_ROWS = 1_000
#: Partitions of a read, about, while none has more than so many pages.
PARTITIONS, PAGES = 200, 256


class Pages(InputPartition):
    """Some pages, read one after another."""

    def __init__(self, numbers: Sequence[int]):
        super().__init__(list(numbers))


def planned(pages: Sequence[int]) -> list[Pages]:
    """Partitions of pages in order; one without pages if there are none."""
    step = min(PAGES, max(1, -(-len(pages) // PARTITIONS)))
    return [Pages(pages[at : at + step]) for at in range(0, len(pages), step)] or [Pages([])]


class _Landed:
    """The landed pages below a place."""

    def __init__(self, path: str):
        self.path = path

    def _fs(self) -> tuple[pafs.FileSystem, str]:
        if urlparse(self.path).scheme in ("", "file"):
            return pafs.LocalFileSystem(), urlparse(self.path).path
        return pafs.FileSystem.from_uri(self.path)

    def pages(self) -> list[int]:
        filesystem, root = self._fs()
        found = filesystem.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        return sorted(int(m[1]) for f in found if f.type == pafs.FileType.Directory and (m := re.match(r"page=(\d+)$", f.base_name)))

    def body(self, page: int) -> dict:
        """The response of a page, which must have ``listings``."""
        filesystem, root = self._fs()
        files = [f.path for f in filesystem.get_file_info(pafs.FileSelector(f"{root}/page={page}")) if f.is_file and not f.base_name.startswith(("_", "."))]
        texts = []
        for path in sorted(files):
            with filesystem.open_input_stream(path) as stream:
                texts.append(stream.read())
        data = json.loads(b"".join(texts).decode("utf-8", "replace"))
        if not isinstance(data, dict) or "listings" not in data:
            raise ValueError(f"page {page} has no listings")
        return data

    def total(self, pages: list[int]) -> int:
        """How many pages the API has, as the first landed page says; one if it says nothing."""
        told = (self.body(pages[0]).get("pagination") or {}).get("total_pages") if pages else None
        return int(told or 1)

    def records(self, pages: Sequence[int]) -> Iterator[pa.RecordBatch]:
        for page in pages:
            yield from self._records(page)

    def _records(self, page: int) -> Iterator[pa.RecordBatch]:
        texts = [json.dumps(r, ensure_ascii=False) for r in self.body(page)["listings"] or []]
        for at in range(0, len(texts), _ROWS):
            some = texts[at : at + _ROWS]
            yield pa.RecordBatch.from_arrays([pa.array([page] * len(some), pa.int64()), pa.array(range(at, at + len(some)), pa.int64()), pa.array(some)], schema=_ARROW)


class _Reader(DataSourceReader):
    def __init__(self, landed: _Landed):
        self.landed = landed

    def partitions(self) -> list[InputPartition]:
        pages = self.landed.pages()
        total = self.landed.total(pages)
        return planned([p for p in pages if 1 <= p <= total])

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from self.landed.records(partition.value)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, landed: _Landed):
        self.landed = landed

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        pages = self.landed.pages()
        there, last = set(pages), 0
        if 1 in there:
            total = self.landed.total(pages)
            while last + 1 in there and last < total:
                last += 1
        return {"page": last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return planned(range(start["page"] + 1, end["page"] + 1))

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from self.landed.records(partition.value)

    def commit(self, end: dict) -> None:
        pass


class PagedJson(DataSource):
    """Options: ``path``, the place with the landed pages."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def _landed(self) -> _Landed:
        if not self.options.get("path"):
            raise ValueError(f"{NAME} needs the path of the landed pages")
        return _Landed(self.options["path"])

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self._landed())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self._landed())


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Records of the landed pages: page, seq, record (variant); active or not."""
    spark.dataSource.register(PagedJson)
    return _as_variant(spark.read.format(NAME).load(path))


def stream_pages(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream that follows the pages as they land."""
    spark.dataSource.register(PagedJson)
    return _as_variant(spark.readStream.format(NAME).load(path))


def _as_variant(records: DataFrame) -> DataFrame:
    return records.select("page", "seq", F.parse_json("record").alias("record"))


def land(pages: DataFrame, path: str) -> None:
    """Writes pages (page, body: text of one line) the way this source reads them."""
    pages.select("page", F.col("body").cast("string").alias("value")).repartition("page").write.mode("append").partitionBy("page").text(path)
