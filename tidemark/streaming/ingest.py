"""Ingest that follows a folder: every new file becomes fetches, blobs, observations, verdicts and listing states.

A file ``source_id=<id>/run=<n>/<any name>`` is the whole feed of one run, a JSON array of records. The files of a micro-batch go to five
stores one after the other. Each store commits the number of the batch with its rows, so a batch that is run again after a crash, from the
checkpoint of the stream, skips the stores that have it, and later stores read what the earlier ones hold of that batch.
Runs of a source land in order; several may share a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.text import wanted_status
from tidemark.operators import archive, health
from tidemark.operators.lifecycle import GONE_AFTER
from tidemark.plans.ingest import record_hash
from tidemark.plans.schemas import RECORD
from tidemark.sources.json_files import file_records
from tidemark.stores.blobs import BlobStore
from tidemark.stores.commits import Appended
from tidemark.stores.listings import BUCKETS, ListingStore

FILES = "path string, modificationTime timestamp, length long, content binary"
FETCHES = "fetch_id long, source_id string, run long, url string, content_type string, fetched_at timestamp_ntz, sha256 string"
OBSERVATIONS = f"source_id string, run long, seq long, content_hash string, {RECORD}"
RUNS = "source_id string, run long, status string, n long, recent_median double, healthy boolean, problems string, error string"

Sink = Callable[[DataFrame, int], object]


def landed_fetches(files: DataFrame) -> DataFrame:
    """Files as fetches: fetch_id (a hash of the path), source_id, run, url, body, content_type, fetched_at."""
    part = lambda name: F.url_decode(F.regexp_extract("path", f"{name}=([^/]*)/", 1))
    return files.select(
        F.xxhash64("path").alias("fetch_id"), part("source_id").alias("source_id"), part("run").cast("long").alias("run"), F.col("path").alias("url"), F.col("content").alias("body"),
        F.lit("application/json").alias("content_type"), F.col("modificationTime").cast("timestamp_ntz").alias("fetched_at"),
    )


def feed_records(fetches: DataFrame) -> DataFrame:
    """Records of fetched feeds with their run, content_hash and ``bad``: the place of the first record of the run that has no URL."""
    records = file_records(fetches, keep=("source_id", "run")).withColumn("content_hash", record_hash())
    missing = F.when(F.coalesce("url", F.lit("")) == "", F.struct("seq", "external_id"))
    return records.withColumn("bad", F.min(missing).over(Window.partitionBy("source_id", "run")))


class Ingest:
    """The stores below one place, and what feeds them. sources: source_id, expected_min, expected_max; others have no limits."""

    def __init__(self, spark: SparkSession, home: str, sources: DataFrame | None = None, gone_after: int = GONE_AFTER, buckets: int = BUCKETS):
        self.spark = spark
        self.sources = sources if sources is not None else spark.createDataFrame([], "source_id string, expected_min int, expected_max int")
        self.blobs = BlobStore(spark, f"{home}/blobs")
        self.fetches = Appended(spark, f"{home}/fetches", FETCHES)
        self.observations = Appended(spark, f"{home}/observations", OBSERVATIONS)
        self.runs = Appended(spark, f"{home}/runs", RUNS)
        self.listings = ListingStore(spark, f"{home}/listings", buckets, gone_after)

    def sinks(self) -> list[Sink]:
        return [self.keep_blobs, self.log_fetches, self.observe, self.judge, self.update]

    def batch(self, files: DataFrame, batch: int) -> None:
        """Takes a numbered batch of files through all stores."""
        for sink in self.sinks():
            sink(files, batch)

    def follow(self, path: str, checkpoint: str, files_per_batch: int | None = None, **trigger) -> StreamingQuery:
        """Starts a stream over the files below ``path``. ``trigger`` as ``DataStreamWriter.trigger`` takes it; by default what is there now."""
        reader = self.spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true")
        files = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)
        return files.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def keep_blobs(self, files: DataFrame, batch: int) -> None:
        self.blobs.put(landed_fetches(files), batch)

    def log_fetches(self, files: DataFrame, batch: int) -> None:
        self.fetches.append(archive.fetch_log(landed_fetches(files)).select(*(c.split()[0] for c in FETCHES.split(", "))), batch)

    def observe(self, files: DataFrame, batch: int) -> None:
        """Records before the first of their run that has no URL, at which the run fails."""
        records = feed_records(landed_fetches(files)).where("bad IS NULL OR seq < bad.seq")
        self.observations.append(records.select(*self.observations.read([], OBSERVATIONS).columns), batch)

    def judge(self, files: DataFrame, batch: int) -> None:
        """Runs with their counts; verdicts go on from the runs of earlier batches."""
        key = ["source_id", "run"]
        counted = self.observations.rows(batch).groupBy(*key).agg(F.count_distinct("external_id").alias("n"))
        no_url = F.format_string("ValueError: listing '%s' from %s has no URL", F.coalesce("bad.external_id", F.lit("?")), "source_id")
        failed = feed_records(landed_fetches(files)).where("bad IS NOT NULL").select(*key, no_url.alias("error")).distinct()
        runs = self.fetches.rows(batch).select(*key).distinct().join(counted, key, "left").join(failed, key, "left").join(self.sources, "source_id", "left")
        runs = runs.withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
        verdicts = health.assess_runs(runs.where("error IS NULL"), health.recent_counts(self.runs.rows())).drop("n")
        judged = runs.join(verdicts, key, "left").withColumns({"status": F.when(F.col("error").isNull(), "ok").otherwise("failed"), "healthy": F.coalesce("healthy", F.lit(False))})
        self.runs.append(judged.select(*(c.split()[0] for c in RUNS.split(", "))), batch)

    def update(self, files: DataFrame, batch: int) -> None:
        """States of the listings seen; misses count after healthy runs."""
        pending = wanted_status(F.get_json_object("extra", "$.status")) == "pending"
        seen = self.observations.rows(batch).select("source_id", F.col("external_id").alias("listing"), "run", "seq", pending.alias("pending"), "content_hash")
        self.listings.upsert(seen, self.runs.rows(batch).select("source_id", "run", F.col("healthy").alias("counts")), batch)
