"""Commits: what a store consists of, switched at once.

A store is a folder of Parquet folders with names of their own, and of numbered commits. A commit is a JSON file that says which folders
count, and exists as a whole or not at all; of writers that make the same number one wins and the others see it. Data are written
before their commit, so a reader or a writer that dies leaves nothing but folders that no commit names (``sweep`` deletes them).
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

Content = dict


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; only where that is unset and all runs in one process (tests), a temporary one is set."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[.*\])?$", sc.master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines share; {sc.master} needs one")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        named = sc.getCheckpointDir()
    return f"{named.rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"


def dealt(rows: DataFrame) -> DataFrame:
    """Rows whose join deals out both sides by key. A side that grows with the input may be small when compressed, and would else go through the driver whole."""
    return rows.hint("merge")


class Folder:
    """A folder of the file system that its URI names, as the driver sees it."""

    def __init__(self, spark: SparkSession, uri: str):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(uri).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.uri = re.sub(r"^file:/+", "file:///", self._fs.makeQualified(self._path(uri)).toString()).rstrip("/")

    def names(self, below: str = "") -> list[str]:
        path = self._path(f"{self.uri}/{below}")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.uri}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Makes a file with all its text, unless there is one."""
        draft = self._path(f"{self.uri}/.{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        target = self._path(f"{self.uri}/{name}")
        self._fs.mkdirs(target.getParent())
        if self._fs.getScheme() == "file":  # whose rename would replace a file
            try:
                os.link(draft.toUri().getPath(), target.toUri().getPath())
                return True
            except FileExistsError:
                return False
            finally:
                self._fs.delete(draft, False)
        won = not self._fs.exists(target) and self._fs.rename(draft, target)
        if not won:
            self._fs.delete(draft, False)
        return won

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.uri}/{name}"), True)


class Store:
    """A store at a place; what its commits say is up to its kind."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark = spark
        self.folder = Folder(spark, uri)

    def last(self) -> tuple[int, Content]:
        """Number and content of the last commit; 0 and an empty one of a new store."""
        numbers = self.folder.names("commits")
        return (int(numbers[-1].split(".")[0]), json.loads(self.folder.read(f"commits/{numbers[-1]}"))) if numbers else (0, {})

    def commit(self, after: int, content: Content) -> bool:
        """Makes the next commit; False if another writer has made one since ``after``."""
        return self.folder.create(f"commits/{after + 1:012d}.json", json.dumps(content, sort_keys=True))

    def write(self, rows: DataFrame, *by: str) -> str:
        """Writes rows below a name of its own, in a folder for each value of ``by``; they count once a commit names them."""
        name = uuid.uuid4().hex
        writer = rows.write.partitionBy(*by) if by else rows.write
        writer.parquet(f"{self.folder.uri}/data/{name}")
        return name

    def read(self, names: Sequence[str], schema: str | StructType) -> DataFrame:
        """Rows of the folders named, and of no others."""
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder.uri}/data/{n}" for n in names))

    def sweep(self) -> list[str]:
        """Deletes data that the last commit does not name; not while anybody writes or reads an earlier one."""
        named = json.dumps(self.last()[1])
        unnamed = [n for n in self.folder.names("data") if n not in named]
        for name in unnamed:
            self.folder.delete(f"data/{name}")
        return unnamed


def done(content: Content, batch: int | None) -> bool:
    """Whether a numbered batch, of which each store gets all in order, is in the store already."""
    return batch is not None and content.get("batch", -1) >= batch


class Appended(Store):
    """A table that only grows. A batch with a number is added once, however often it is written, and can be read alone."""

    def __init__(self, spark: SparkSession, uri: str, schema: str):
        super().__init__(spark, uri)
        self.schema = schema

    def append(self, rows: DataFrame, batch: int | None = None) -> None:
        name = None
        while True:
            number, content = self.last()
            if done(content, batch):
                return
            name = name or self.write(rows)
            parts = [*content.get("parts", []), [name, batch]]
            if self.commit(number, content | {"parts": parts} | ({} if batch is None else {"batch": batch})):
                return

    def rows(self, batch: int | None = None) -> DataFrame:
        """All rows, or those of one batch."""
        parts = self.last()[1].get("parts", [])
        return self.read([name for name, of in parts if batch is None or of == batch], self.schema)
