"""Content-addressed archive of raw payloads, and retention of backups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import iso_week

KEEP_DAILY, KEEP_WEEKLY = 14, 8


def new_blobs(fetches: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Payloads not stored yet, one per hash: sha256, size, content_type (of the first fetch), body.

    fetches: fetch_id, body (binary), content_type. stored: sha256. A null body is no blob. The first
    fetch is found on hashes; bodies move once, and equal bodies are combined before they do.
    """
    hashed = fetches.where("body IS NOT NULL").withColumn("sha256", F.sha2("body", 256))
    if stored is not None:
        hashed = hashed.join(stored.select("sha256"), "sha256", "left_anti")
    first = F.min_by(F.struct("content_type", "body"), "fetch_id")
    blobs = hashed.groupBy("sha256").agg(first.alias("f"))
    return blobs.select("sha256", F.octet_length("f.body").cast("long").alias("size"), "f.content_type", "f.body")


def fetch_log(fetches: DataFrame) -> DataFrame:
    """The log of fetches, with the hash in place of the body; null for a fetch without one."""
    return fetches.withColumn("sha256", F.sha2("body", 256)).drop("body")


def load_blobs(blobs: DataFrame, hashes: DataFrame) -> DataFrame:
    """Stored payloads of the hashes asked for (sha256)."""
    return blobs.join(hashes.select("sha256").distinct(), "sha256", "left_semi")


def retention(items: DataFrame, ts: str = "ts", name: str = "name", days: int = KEEP_DAILY, weeks: int = KEEP_WEEKLY) -> DataFrame:
    """``items`` with ``keep``: the newest of each of the last days and ISO weeks that have any.

    Of equal times the greatest name is the newest. Days and weeks are ranked among themselves first, so
    the rows are never sorted in one task.
    """
    day, week = F.to_date(ts), iso_week(ts)
    marked = items.withColumns({"_day": day, "_week": week, "_newest": F.struct(ts, name)})

    def newest(unit: str, n: int) -> DataFrame:
        units = marked.groupBy(unit).agg(F.max("_newest").alias("_newest")).orderBy(F.desc(unit)).limit(n)
        return units.select("_newest").withColumn(f"_by{unit}", F.lit(True))

    kept = marked.join(F.broadcast(newest("_day", days)), "_newest", "left").join(F.broadcast(newest("_week", weeks)), "_newest", "left")
    keep = F.coalesce("_by_day", "_by_week", F.lit(False))
    return kept.withColumn("keep", keep).select(*items.columns, "keep")
