"""Shared working storage of the operators.

Everything that one Spark job leaves for a later one is a table or file below the
folder that the cluster names in ``spark.checkpoint.dir``, so a lost executor costs
at most the tasks it was running.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 1000
_WITHIN: ContextVar[str | None] = ContextVar("within", default=None)


def shared_root(spark: SparkSession) -> str:
    """URI of the cluster's shared folder; a temporary one only where none is configured and all runs in one process (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines share; {sc.master} needs one")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        named = sc.getCheckpointDir()
    path = sc._jvm.org.apache.hadoop.fs.Path(named)
    uri = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()  # a bare path is on Spark's default file system
    return re.sub(r"^file:/+", "file:///", uri).rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_ROWS`` rows in this session, since a row may be a very long text."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)


def release(cache: dict) -> None:
    """Empties a cache of this Python worker at the end of a task and returns free memory: workers outlive their tasks."""
    cache.clear()
    pa.default_memory_pool().release_unused()


class Workspace:
    """A folder of its own for one run of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.uri = f"{_WITHIN.get() or shared_root(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
        self._tables = 0
        bound_batches(spark)

    def save(self, df: DataFrame) -> DataFrame:
        """Writes ``df`` as Parquet and returns the table, which cuts its lineage."""
        self._tables += 1
        path = f"{self.uri}/table-{self._tables}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def folder(self, name: str) -> str:
        """URI of a subfolder that tasks can write files to."""
        uri = f"{self.uri}/{name}"
        filesystem, path = open_fs(uri)
        filesystem.create_dir(path, recursive=True)
        return uri

    def drop(self, df: DataFrame) -> None:
        """Deletes a table made by ``save`` that nothing reads any more."""
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            self._delete(folder)

    def close(self) -> None:
        """Deletes the folder, once nothing reads its tables and files any more."""
        self._delete(self.uri)

    @contextmanager
    def around(self) -> Iterator[None]:
        """Within it, the workspaces of operators are made inside this one, and so go when it is closed."""
        token = _WITHIN.set(self.uri)
        try:
            yield
        finally:
            _WITHIN.reset(token)

    def _delete(self, folder: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; a bare path is a local one."""
    if urlparse(uri).scheme:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri
