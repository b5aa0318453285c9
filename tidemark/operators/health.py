"""Run health, source state and schedule."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from statistics import median

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import iso_z, plus_minutes
from tidemark.functions.numbers import DROP_MIN_MEDIAN, DROP_RATIO, backoff_minutes

HISTORY, STALE_AFTER = 5, 3
PROBLEM_STATES = ("failing", "degraded", "stale")
#: Sources that the overall view names at most.
MOST_NAMED = 1_000


def run_counts(sightings: DataFrame) -> DataFrame:
    """Distinct listings and sightings of each run: source_id, run, listings, sightings."""
    return sightings.groupBy("source_id", "run").agg(F.count_distinct("listing").alias("listings"), F.count("*").alias("sightings"))


def assess_runs(runs: DataFrame, recent: DataFrame | None = None) -> DataFrame:
    """Verdict on each completed run: source_id, run, n, recent_median, healthy, problems (text, null if none).

    runs: source_id, run, n, expected_min, expected_max. A run is healthy if n is within the expected
    range and not below half the median of the counts of the last five healthy runs before it (tested from a
    median of 4). A healthy run without a count is one of the five and has no part in the median. A verdict depends on earlier
    verdicts, so tasks go through the runs of their sources in order, row by row, and hold five counts, however long a history is.
    ``recent`` (source_id, recent: the counts of up to five healthy runs before these, newest first) continues an earlier history.
    """
    kind = runs.schema["source_id"].dataType.simpleString()
    rows = runs.select("source_id", *(F.col(c).cast("long") for c in ("run", "n", "expected_min", "expected_max")))
    if recent is not None:
        rows = rows.join(recent.select("source_id", F.col("recent").cast("array<long>").alias("recent")), "source_id", "left")
    else:
        rows = rows.withColumn("recent", F.lit(None).cast("array<long>"))
    ordered = rows.repartition("source_id").sortWithinPartitions("source_id", "run")
    names, types = ("recent_median", "healthy", "problems"), (pa.float64(), pa.bool_(), pa.string())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, known, counts = None, deque(maxlen=HISTORY), []
        for batch in batches:
            out = []
            for here, n, low, high, before in zip(*(batch.column(c).to_pylist() for c in ("source_id", "n", "expected_min", "expected_max", "recent")), strict=True):
                if here != source:
                    source, known = here, deque(reversed((before or [])[:HISTORY]), maxlen=HISTORY)
                    counts = [c for c in known if c is not None]
                middle = float(median(counts)) if counts else None
                problems = run_problems(n, low, high, middle)
                out.append((middle, not problems, "; ".join(problems) or None))
                if not problems:
                    known.append(n)
                    counts = [c for c in known if c is not None]
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["source_id", "run", "n", *names])

    return ordered.mapInArrow(judge, f"source_id {kind}, run long, n long, recent_median double, healthy boolean, problems string")


def run_problems(n: int | None, low: int | None, high: int | None, middle: float | None) -> list[str]:
    """What is wrong with a count: outside of the expected range, or far below the median of recent ones."""
    if n is None:
        return []
    found = []
    if n < (low or 0):
        found.append(f"count {n} below expected minimum {low or 0}")
    if high is not None and n > high:
        found.append(f"count {n} above expected maximum {high}")
    if middle is not None and middle >= DROP_MIN_MEDIAN and n < DROP_RATIO * middle:
        found.append(f"sudden drop: {n} vs recent median {middle:g}")
    return found


def recent_counts(judged: DataFrame) -> DataFrame:
    """What ``assess_runs`` needs to go on after ``judged`` (source_id, run, n, healthy): source_id, recent."""
    newest = Window.partitionBy("source_id").orderBy(F.desc("run"))
    last = judged.where("healthy").withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= HISTORY)
    return last.groupBy("source_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "n"))), lambda x: x["n"]).alias("recent"))


def run_summary(runs: DataFrame, snapshots: DataFrame, history: DataFrame) -> DataFrame:
    """``runs`` with what became of each: snapshots_created, missed and gone, 0 where there is nothing.

    snapshots: source_id, run (a row per snapshot). history: as ``lifecycle.listing_history`` gives it.
    """
    key = ["source_id", "run"]
    made = snapshots.groupBy(*key).agg(F.count("*").alias("snapshots_created"))
    moved = history.where("NOT seen").groupBy(*key).agg(F.count("*").alias("missed"), F.count_if(F.col("status") == "gone").alias("gone"))
    return runs.join(made, key, "left").join(moved, key, "left").fillna(0, ["snapshots_created", "missed", "gone"])


#: What is told of a run.
RUN_FIELDS = ("run", "job_id", "status", "healthy", "health_notes", "listings_found", "error", "started_at", "finished_at")


def source_runs(runs: DataFrame, source_id: object, limit: int) -> DataFrame:
    """The newest runs of one source, newest first."""
    return runs.where(F.col("source_id") == F.lit(source_id)).orderBy(F.desc("run")).limit(limit)


def run_reports(runs: DataFrame, source_id: object, limit: int) -> DataFrame:
    """The nine fields told of each of the newest runs of one source, times as ISO text with a Z."""
    told = source_runs(runs, source_id, limit)
    return told.select(*(iso_z(c).alias(c) if c.endswith("_at") else F.col(c) for c in RUN_FIELDS))


def consecutive_failures(runs: DataFrame) -> DataFrame:
    """Failures of each source since its last completed run, which a judgement of unhealthy is too.

    runs: source_id, run, status (ok or failed).
    """
    after = Window.partitionBy("source_id").orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    islands = runs.withColumn("completed", F.sum((F.col("status") != "failed").cast("int")).over(after))
    return islands.groupBy("source_id").agg(F.sum((F.col("completed") == 0).cast("int")).alias("consecutive_failures"))


def state_columns(now: Column, stale_after: int = STALE_AFTER) -> tuple[Column, Column]:
    """State and reasons of a source row: enabled, disabled_reason, last_run_at, last_status, last_error, last_success_at, interval_minutes."""
    base = (
        F.when(~F.col("enabled"), "disabled")
        .when(F.col("last_run_at").isNull(), "never_run")
        .when(F.col("last_status") == "failed", "failing")
        .when(F.col("last_status") == "unhealthy", "degraded")
        .otherwise("ok")
    )
    limit = plus_minutes("last_success_at", F.col("interval_minutes") * stale_after)
    old = ~base.isin("disabled", "never_run") & F.coalesce(now > limit, F.lit(True))
    state = F.when((base == "ok") & old, "stale").otherwise(base)
    why = (
        F.when(base == "disabled", F.coalesce(F.nullif("disabled_reason", F.lit("")), F.lit("kill switch off")))
        .when(base == "failing", F.coalesce(F.nullif("last_error", F.lit("")), F.lit("last run failed")))
        .when(base == "degraded", F.coalesce(F.nullif("last_error", F.lit("")), F.lit("last run failed health checks")))
    )
    since = F.when(old, F.concat(F.lit("no successful run since "), F.coalesce(iso_z("last_success_at"), F.lit("ever"))))
    return state, F.array_compact(F.array(why, since))


def next_due(now: Column) -> Column:
    """When a source should run next: never if disabled, now if it never ran, else after its backed-off interval."""
    later = plus_minutes("last_run_at", backoff_minutes("interval_minutes", "consecutive_failures"))
    return F.when(F.col("enabled"), F.coalesce(later, now))


def source_health(sources: DataFrame, now: Column) -> DataFrame:
    """``sources`` with state, reasons and next_due_at."""
    state, reasons = state_columns(now)
    return sources.withColumns({"state": state, "reasons": reasons, "next_due_at": next_due(now)})


def due_sources(sources: DataFrame, now: Column) -> DataFrame:
    """Enabled sources whose time has come."""
    return sources.where(F.col("enabled") & (next_due(now) <= now)).select("source_id")


def overall(health: DataFrame, backups: DataFrame, jobs: DataFrame, most: int = MOST_NAMED) -> DataFrame:
    """One row: ok, problem_sources, n_problems, active_jobs. ok: no source has a problem and the last backup did not fail.

    health: source_id, state. backups and jobs: id, status. Of the sources with a problem all are counted, and the first ``most`` named:
    a row that names sources without bound would grow with them.
    """
    bad = health.where(F.col("state").isin(*PROBLEM_STATES)).select("source_id")
    named = bad.orderBy("source_id").limit(most).agg(F.sort_array(F.collect_list("source_id")).alias("problem_sources"))
    counted = bad.agg(F.count("*").alias("n_problems"))
    last = backups.agg(F.max_by("status", "id").alias("last_backup"))
    active = jobs.agg(F.count_if(F.col("status").isin("queued", "running", "cancel_requested")).alias("active_jobs"))
    one = counted.withColumn("_", F.lit(1)).join(named.withColumn("_", F.lit(1)), "_").join(last.withColumn("_", F.lit(1)), "_").join(active.withColumn("_", F.lit(1)), "_")
    ok = (F.col("n_problems") == 0) & F.coalesce(F.col("last_backup") != "failed", F.lit(True))
    return one.select(ok.alias("ok"), "problem_sources", "n_problems", "active_jobs")
