"""The job queue as transformations of a job log.

Job rows: id, kind, source_id, params (JSON text), status, done, total, created_at, started_at, finished_at,
heartbeat_at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.collections import canonical_json
from tidemark.functions.dates import seconds_between
from tidemark.functions.numbers import eta_seconds, percent
from tidemark.stores.commits import Store, shared_folder

ACTIVE = ("queued", "running", "cancel_requested")
STALE_MINUTES, BACKUP_HOURS, MESSAGE = 15, 24, 4000


def _identity(source_id: Column | str = "source_id", params: Column | str = "params") -> list[Column]:
    params = F.col(params) if isinstance(params, str) else params
    return [F.col("kind"), F.col("source_id"), canonical_json(F.coalesce(params, F.lit("{}"))).alias("same_params")]


def enqueue(requests: DataFrame, jobs: DataFrame, kinds: Sequence[str] = ()) -> DataFrame:
    """Requests (request_id, kind, source_id, params) with the id of the active job that they repeat, null to queue anew.

    Jobs are the same if kind, source (null too) and the JSON value of params are; the oldest is reused. With ``kinds``
    a request of any other kind is an error.
    """
    if kinds:
        unknown = F.raise_error(F.concat(F.lit("unknown job kind: "), F.coalesce("kind", F.lit("?")))).cast("string")
        requests = requests.withColumn("kind", F.when(F.coalesce(F.col("kind").isin(*kinds), F.lit(False)), F.col("kind")).otherwise(unknown))
    active = jobs.where(F.col("status").isin(*ACTIVE)).groupBy(*_identity()).agg(F.min("id").alias("job_id"))
    asked = requests.withColumns({"same_params": _identity()[2]})
    same = asked["kind"].eqNullSafe(active["kind"]) & asked["source_id"].eqNullSafe(active["source_id"]) & asked["same_params"].eqNullSafe(active["same_params"])
    return asked.join(active, same, "left").select(*(asked[c] for c in requests.columns), "job_id")


def new_jobs(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """The requests to queue: no active job repeats them, and of equal requests the first."""
    fresh = enqueue(requests, jobs).where("job_id IS NULL").drop("job_id").withColumns({"same_params": _identity()[2]})
    first = Window.partitionBy("kind", "source_id", "same_params").orderBy("request_id")
    return fresh.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*requests.columns)


def enqueue_ids(requests: DataFrame, jobs: DataFrame, kinds: Sequence[str] = ()) -> DataFrame:
    """``requests`` with the ``job_id`` that each got and ``created``: whether that job is a new one.

    A request that repeats an active job gets its id. Equal requests of the batch get one new job together. New jobs are numbered
    on from the last job in the order of their first requests, without gaps: the groups are dealt by ranges of that order and written, each
    range is numbered by itself, and begins where those before it end.
    """
    spark = requests.sparkSession
    scratch = Store(spark, shared_folder(spark, "jobs"))
    asked = enqueue(requests, jobs, kinds).withColumns({"same_params": _identity()[2]})
    asked = scratch.read([scratch.write(asked)], asked.schema)
    same = ["kind", "source_id", "same_params"]
    groups = asked.where("job_id IS NULL").groupBy(*same).agg(F.min("request_id").alias("first")).repartitionByRange("first")
    groups = groups.withColumn("range", F.spark_partition_id())
    groups = scratch.read([scratch.write(groups)], groups.schema)
    sizes = {r["range"]: r["count"] for r in groups.groupBy("range").count().collect()}  # a row for each partition of a shuffle
    base, bases = jobs.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0], {}
    for k in sorted(sizes):
        bases[k] = base
        base += sizes[k]
    starts = spark.createDataFrame(list(bases.items()), "range int, base long")
    numbered = groups.join(F.broadcast(starts), "range").withColumn("new_id", F.col("base") + F.row_number().over(Window.partitionBy("range").orderBy("first")))
    mine = [asked[c].eqNullSafe(numbered[c]) for c in same]
    joined = asked.join(numbered.select(*same, "new_id"), mine, "left")
    return joined.select(*(asked[c] for c in requests.columns), F.coalesce("job_id", "new_id").alias("job_id"), asked["job_id"].isNull().alias("created"))


def queue_due(due: DataFrame, jobs: DataFrame, kind: str) -> DataFrame:
    """Requests for the due sources (source_id) that no active job of the kind serves."""
    requests = due.select(F.col("source_id").cast("string").alias("request_id"), F.lit(kind).alias("kind"), F.col("source_id").cast("string").alias("source_id"), F.lit("{}").alias("params"))
    return new_jobs(requests, jobs).drop("request_id")


def report(jobs: DataFrame, events: DataFrame, n: int, now: Column) -> DataFrame:
    """``jobs`` with their progress and ``events``, an array of the last n messages (id, job_id, message), oldest first."""
    last = last_events(events, n, "job_id", ["id"]).groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("id", "message"))).alias("events"))
    joined = progress(jobs, now).join(last.withColumnRenamed("job_id", "id"), "id", "left")
    return joined.withColumn("events", F.coalesce(F.transform("events", lambda e: e["message"]), F.array().cast("array<string>")))


def progress(jobs: DataFrame, now: Column) -> DataFrame:
    """``jobs`` with percent, elapsed_seconds and eta_seconds; open jobs run until ``now``."""
    elapsed = F.bround(seconds_between("started_at", F.coalesce("finished_at", now)), 1)
    timed = jobs.withColumns({"percent": percent("status", "done", "total"), "elapsed_seconds": elapsed})
    return timed.withColumn("eta_seconds", eta_seconds("status", "done", "total", "elapsed_seconds"))


def cancel(jobs: DataFrame, ids: Sequence[int] | DataFrame, now: Column) -> DataFrame:
    """A queued job asked to stop is cancelled, a running one is told to; others stay as they are.

    The requests are a few ids, or a table (id) of any size in which ids may repeat or name no job.
    """
    columns, asked = jobs.columns, F.col("id").isin(*ids) if not isinstance(ids, DataFrame) else F.col("_asked").isNotNull()
    if isinstance(ids, DataFrame):
        jobs = jobs.join(ids.select("id", F.lit(True).alias("_asked")).distinct(), "id", "left")
    queued, running = asked & (F.col("status") == "queued"), asked & (F.col("status") == "running")
    status = F.when(queued, "cancelled").when(running, "cancel_requested").otherwise(F.col("status"))
    return jobs.withColumns({"finished_at": F.when(queued, now).otherwise(F.col("finished_at")), "status": status}).select(*columns)


def stale(jobs: DataFrame, now: Column, minutes: int = STALE_MINUTES) -> DataFrame:
    """Running jobs without a sign of life for ``minutes``."""
    sign = F.coalesce("heartbeat_at", "started_at", "created_at")
    return jobs.where(F.col("status").isin("running", "cancel_requested") & (sign < now - F.make_dt_interval(mins=F.lit(minutes))))


def interrupt_stale(jobs: DataFrame, now: Column) -> DataFrame:
    """``jobs`` with the stale ones interrupted."""
    gone = stale(jobs, now).select("id", F.lit(True).alias("_gone"))
    marked = jobs.join(gone, "id", "left")
    return marked.withColumns({"status": F.when(F.col("_gone"), "interrupted").otherwise(F.col("status")), "finished_at": F.when(F.col("_gone"), now).otherwise(F.col("finished_at"))}).select(*jobs.columns)


def recent(jobs: DataFrame, limit: int, statuses: Sequence[str] = (), kind: str | None = None) -> DataFrame:
    """The newest jobs by id, of some statuses or kind if asked."""
    if statuses:
        jobs = jobs.where(F.col("status").isin(*statuses))
    if kind is not None:
        jobs = jobs.where(F.col("kind") == kind)
    return jobs.orderBy(F.desc("id")).limit(limit)


def active_of(page: DataFrame) -> DataFrame:
    """Active jobs of a page that is limited already."""
    return page.where(F.col("status").isin(*ACTIVE))


def next_queued(jobs: DataFrame) -> DataFrame:
    return jobs.where("status = 'queued'").orderBy("id").limit(1)


def last_events(events: DataFrame, n: int, key: str, order: Sequence[str]) -> DataFrame:
    """The last n events of each job, numbered from the newest (column nth)."""
    newest = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return events.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= n)


def log_rows(messages: DataFrame) -> DataFrame:
    """Rows for the job log: messages are cut to what it stores."""
    return messages.withColumn("message", F.substring("message", 1, MESSAGE))


def backup_due(jobs: DataFrame, now: Column) -> DataFrame:
    """One row, ``due``: no backup succeeded or is on its way, or the last succeeded a day ago. A failed one does not count."""
    counted = jobs.where((F.col("kind") == "backup") & F.col("status").isin("succeeded", "queued", "running"))
    last = counted.agg(F.max_by(F.struct("status", F.coalesce("finished_at", "created_at").alias("at")), "id").alias("last"))
    old = (F.col("last.status") == "succeeded") & (now - F.col("last.at") >= F.make_dt_interval(hours=F.lit(BACKUP_HOURS)))
    return last.select((F.col("last").isNull() | F.coalesce(old, F.lit(False))).alias("due"))
