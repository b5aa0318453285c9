"""Which detail pages must be fetched again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.collections import canonical_json

REFRESH_HOURS = 24


def last_fetched(fetches: DataFrame) -> DataFrame:
    """Time of the last successful fetch of each URL, by fetch id. fetches: id, url, http_status, fetched_at."""
    return fetches.where("http_status = 200").groupBy("url").agg(F.max_by("fetched_at", "id").alias("fetched_at"))


def detail_freshness(records: DataFrame, previous: DataFrame, fetches: DataFrame, now: Column, hours: int = REFRESH_HOURS) -> DataFrame:
    """``records`` (listing, url, summary as JSON text) with ``fresh``: unchanged since ``previous`` (listing, summary) and fetched lately."""
    before = previous.select("listing", canonical_json("summary").alias("_before"))
    joined = records.join(before, "listing", "left").join(last_fetched(fetches).withColumnRenamed("fetched_at", "_fetched"), "url", "left")
    recent = now - F.col("_fetched") < F.make_dt_interval(hours=F.lit(hours))
    fresh = (canonical_json("summary") == F.col("_before")) & recent
    return joined.withColumn("fresh", F.coalesce(fresh, F.lit(False))).select(*records.columns, "fresh")
