"""Change capture and lifecycle on streams, with the same rules as the batch operators.

State is kept per listing by ``transformWithState``, so it needs the RocksDB state store. A batch of
rows may hold several runs; within a listing they are taken in order of (run, seq), a miss first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.lifecycle import GONE_AFTER

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "source_id string, listing string, run long, seq long, content_hash string"
EVENTS = "source_id string, listing string, run long, seq long, step int, from_status string, to_status string"


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(rows, ignore_index=True).sort_values(["run", "seq"], na_position="first", kind="stable")


class ChangeCapture(StatefulProcessor):
    """Passes on an observation whose content differs from the one before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "content_hash string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ordered = _in_order(rows)
        before = ordered["content_hash"].shift(1)
        known = self._last.exists()
        if known:
            before.iloc[0] = self._last.get()[0]
        changed = ordered["content_hash"] != before
        changed.iloc[0] = not known or ordered["content_hash"].iloc[0] != before.iloc[0]
        self._last.update((ordered["content_hash"].iloc[-1],))
        yield ordered[changed][["source_id", "listing", "run", "seq", "content_hash"]]

    def close(self) -> None:
        pass


class Lifecycle(StatefulProcessor):
    """Turns sightings and counted misses of a listing into changes of its status."""

    def __init__(self, gone_after: int = GONE_AFTER):
        self._gone_after = max(gone_after, 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("state", "status string, misses int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        status, misses = self._state.get() if self._state.exists() else (None, 0)
        out = []
        for row in _in_order(rows).itertuples(index=False):
            steps = []
            if not row.seen:
                if status in (None, "gone"):
                    continue
                misses += 1
                if misses >= self._gone_after:
                    steps.append((1, "gone"))
            else:
                misses = 0
                wanted = "pending" if row.pending else "available"
                if status is None:
                    steps.append((0, "available"))
                if status == "gone":
                    steps.append((1, "relisted"))
                elif status != "relisted" or wanted == "pending":
                    steps.append((1, wanted))
            for step, new in steps:
                if new != status:
                    out.append((row.source_id, row.listing, row.run, row.seq, step, status, new))
                    status = new
        if status is not None:
            self._state.update((status, misses))
        yield pd.DataFrame(out, columns=["source_id", "listing", "run", "seq", "step", "from_status", "to_status"]).astype({"seq": "Int64"})

    def close(self) -> None:
        pass


def stream_changes(observations: DataFrame) -> DataFrame:
    """Snapshots of a stream of observations (source_id, listing, run, seq, content_hash)."""
    keyed = observations.groupBy("source_id", "listing")
    return keyed.transformWithStateInPandas(ChangeCapture(), CHANGES, "Append", "None")


def stream_status_events(events: DataFrame, gone_after: int = GONE_AFTER) -> DataFrame:
    """Status changes of a stream of sightings and counted misses (source_id, listing, run, seq, seen, pending)."""
    keyed = events.groupBy("source_id", "listing")
    return keyed.transformWithStateInPandas(Lifecycle(gone_after), EVENTS, "Append", "None")


def run_misses(active: DataFrame, sightings: DataFrame, run: int) -> DataFrame:
    """Misses of one counting run: active listings (source_id, listing) that it did not see."""
    missed = active.join(sightings.select("source_id", "listing").distinct(), ["source_id", "listing"], "left_anti")
    none = {"run": F.lit(run).cast("long"), "seq": F.lit(None).cast("long"), "seen": F.lit(False), "pending": F.lit(False)}
    return missed.select("source_id", "listing").withColumns(none)
