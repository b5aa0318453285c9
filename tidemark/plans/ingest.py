"""The ingest of observations: from normalized records to every derived view."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.collections import content_hash
from tidemark.functions.text import wanted_status
from tidemark.operators import health, lifecycle
from tidemark.plans.schemas import CONTENT


class Views(NamedTuple):
    snapshots: DataFrame
    runs: DataFrame
    listings: DataFrame
    events: DataFrame


def checked_url(observations: DataFrame) -> DataFrame:
    """``observations``, failing on a record without a URL."""
    missing = F.coalesce(F.col("url"), F.lit("")) == ""
    message = F.concat(F.lit("listing without a URL: "), F.coalesce("external_id", F.lit("?")))
    return observations.withColumn("url", F.when(missing, F.raise_error(message).cast("string")).otherwise(F.col("url")))


def record_hash() -> Column:
    return content_hash(CONTENT)


def derive(observations: DataFrame, runs: DataFrame, gone_after: int = lifecycle.GONE_AFTER) -> Views:
    """Derives every view from append-only tables.

    observations: source_id, run, seq and a record. runs: source_id, run, status (ok or failed), complete_feed,
    expected_min, expected_max. The view of runs counts listings, snapshots created, misses and listings gone. Sightings count whatever became of their run; misses count only after
    a completed, healthy run of a complete feed.
    """
    observations = checked_url(observations)
    counts = health.run_counts(observations.withColumnRenamed("external_id", "listing"))
    summed = runs.join(counts, ["source_id", "run"], "left").withColumn("n", F.coalesce("listings", F.lit(0)).cast("long"))
    verdicts = health.assess_runs(summed.where("status = 'ok'")).select("source_id", "run", "recent_median", "healthy", "problems")
    judged = summed.drop("listings", "sightings").join(verdicts, ["source_id", "run"], "left").withColumn("healthy", F.coalesce("healthy", F.col("status") != "failed"))
    pending = wanted_status(F.get_json_object("extra", "$.status")) == "pending"
    sightings = observations.select("source_id", F.col("external_id").alias("listing"), "run", "seq", pending.alias("pending"))
    history = lifecycle.listing_history(sightings, judged.select("source_id", "run", (F.col("healthy") & F.col("complete_feed")).alias("counts")), gone_after)
    snapshots = lifecycle.snapshots_on_change(observations.withColumn("content_hash", record_hash()), ["source_id", "external_id"], ["run", "seq"], "content_hash")
    judged = health.run_summary(judged, snapshots, history)
    return Views(snapshots, judged, lifecycle.current_listings(history), lifecycle.status_events(history))
