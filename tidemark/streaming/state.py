"""State that outlives a batch: counts of recent runs, deadlines of jobs, details that were fetched.

All are keyed operators of ``transformWithState``, so they need the RocksDB state store. Their rules are those of the batch operators.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.collections import canonical_json
from tidemark.operators.freshness import REFRESH_HOURS
from tidemark.operators.health import HISTORY, run_problems
from tidemark.operators.jobs import STALE_MINUTES

VERDICTS = "source_id string, run long, n long, recent_median double, healthy boolean, problems string, counts boolean"
INTERRUPTED = "id long, status string, finished_at timestamp"
FRESHNESS = "listing string, url string, at timestamp, fresh boolean"
#: Groups that URLs are dealt into, each with a map of its own.
CACHES = 1_024


def _whole(value: object) -> int | None:
    return None if pd.isna(value) else int(value)


class HealthGate(StatefulProcessor):
    """Judges the runs of a source against the counts of the last healthy ones, which are all it keeps."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._recent = handle.getListState("recent", "n long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for row in initialState.itertuples():
            self._recent.put([(_whole(n),) for n in list(row.recent)[:HISTORY]])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        recent = [_whole(r[0]) for r in self._recent.get()] if self._recent.exists() else []  # newest first
        out = []
        for row in pd.concat(rows, ignore_index=True).sort_values("run").itertuples():
            counts = [n for n in recent if n is not None]
            middle, n = float(median(counts)) if counts else None, _whole(row.n)
            problems = run_problems(n, _whole(row.expected_min), _whole(row.expected_max), middle)
            out.append((key[0], row.run, n, middle, not problems, "; ".join(problems) or None, not problems and bool(row.complete_feed)))
            if not problems:
                recent = [n, *recent][:HISTORY]
        if recent:
            self._recent.put([(n,) for n in recent])
        yield pd.DataFrame(out, columns=[c.split()[0] for c in VERDICTS.split(", ")]).astype({"n": "Int64"})

    def close(self) -> None:
        pass


def stream_verdicts(runs: DataFrame, recent: DataFrame | None = None) -> DataFrame:
    """Verdicts on a stream of completed runs (source_id, run, n, expected_min, expected_max, complete_feed), as ``health.assess_runs`` gives them.

    ``counts`` says whether misses count after the run, as the lifecycle asks. Runs of a source come in order over batches.
    ``recent`` (a table, as ``health.recent_counts`` makes it of the history) is where sources go on from.
    """
    before = recent.select("source_id", F.col("recent").cast("array<long>").alias("recent")).groupBy("source_id") if recent is not None else None
    return runs.groupBy("source_id").transformWithStateInPandas(HealthGate(), VERDICTS, "Append", "None", before)


class StaleJobs(StatefulProcessor):
    """A deadline for each running job, which every sign of life moves on."""

    def __init__(self, minutes: float, event_time: bool):
        self._delay, self._event_time = int(minutes * 60_000), event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._job = handle.getValueState("job", "status string, deadline long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        status, deadline = self._job.get() if self._job.exists() else (None, None)
        before, seen = deadline, None
        for row in pd.concat(rows, ignore_index=True).sort_values("at", kind="stable").itertuples():
            status = row.status if row.status is not None else status  # a heartbeat leaves it as it is
            seen = row.at
        running = status in ("running", "cancel_requested")
        if running:
            base = int(pd.Timestamp(seen).timestamp() * 1000) if self._event_time else timerValues.getCurrentProcessingTimeInMs()
            deadline = max(base + self._delay, deadline or 0)
        if before is not None and (not running or deadline != before):
            self._handle.deleteTimer(before)
        if running and deadline != before:
            self._handle.registerTimer(deadline)
        if running or status == "queued":
            self._job.update((status, deadline if running else None))
        else:
            self._job.clear()
        yield pd.DataFrame({"id": pd.Series(dtype="int64"), "status": pd.Series(dtype="object"), "finished_at": pd.Series(dtype="datetime64[ns]")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._job.clear()
        at = pd.to_datetime(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        yield pd.DataFrame({"id": [key[0]], "status": ["interrupted"], "finished_at": [at]})

    def close(self) -> None:
        pass


def stream_interruptions(signs: DataFrame, minutes: float = STALE_MINUTES, delay: str | None = "0 seconds") -> DataFrame:
    """Jobs that a stream of signs of life (id, status, null for a heartbeat, at: timestamp) shows to be stale: id, status, finished_at.

    A running job is interrupted ``minutes`` after its last sign, without a row of its own: when the event time, ``delay`` behind the latest
    sign of any job, has come so far; with ``delay=None`` when the clock has, by the time at which signs arrived.
    """
    event_time = delay is not None
    timed = signs.withWatermark("at", delay) if event_time else signs
    return timed.groupBy("id").transformWithStateInPandas(StaleJobs(minutes, event_time), INTERRUPTED, "Append", "EventTime" if event_time else "ProcessingTime")


class DetailCache(StatefulProcessor):
    """Which details are still good: the summary that each URL had when its detail was fetched, forgotten when that is too long ago."""

    def __init__(self, seconds: float):
        self._ttl = int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._fetched = handle.getMapState("fetched", "url string", "summary string", self._ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            ordered, fresh = batch.sort_values("at", kind="stable"), []
            for row in ordered.itertuples():
                known = self._fetched.containsKey((row.url,)) and self._fetched.getValue((row.url,))[0] == row.summary
                fresh.append(bool(known and row.summary is not None))
                if not fresh[-1]:  # it is fetched now
                    self._fetched.updateValue((row.url,), (row.summary,))
            yield ordered[["listing", "url", "at"]].assign(fresh=fresh)

    def close(self) -> None:
        pass


def stream_freshness(records: DataFrame, hours: float = REFRESH_HOURS, caches: int = CACHES) -> DataFrame:
    """Of a stream of records (listing, url, summary as JSON text, at: timestamp) which need no new detail: listing, url, at, fresh.

    A detail is fresh if the summary is that of its last fetch, and that less than ``hours`` ago by the clock; else it counts as fetched with
    this record. State holds the URLs fetched in that time only. URLs are dealt into ``caches`` groups, so no source is one group.
    """
    rows = records.select("listing", "url", canonical_json("summary").alias("summary"), "at").withColumn("cache", F.pmod(F.xxhash64("url"), F.lit(caches)))
    return rows.groupBy("cache").transformWithStateInPandas(DetailCache(hours * 3600), FRESHNESS, "Append", "ProcessingTime")
