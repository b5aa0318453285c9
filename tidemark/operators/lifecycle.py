"""Change capture and the lifecycle of listings, derived from append-only observations.

A listing is a key that sources report run after run. Nothing is updated in place: every view is a
window over observations, so it can be derived again and distributes by listing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GONE_AFTER = 3


def _before(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def snapshots_on_change(observations: DataFrame, keys: Sequence[str], order: Sequence[str], content: Column | str) -> DataFrame:
    """Observations whose content differs from the one before of the same key; a key's first is always kept."""
    content = F.col(content) if isinstance(content, str) else content
    seen = observations.withColumn("_content", content).withColumns(
        {"_earlier": F.lag("_content").over(_before(keys, order)), "_at": F.row_number().over(_before(keys, order))}
    )
    return seen.where((F.col("_at") == 1) | ~F.col("_content").eqNullSafe(F.col("_earlier"))).drop("_content", "_earlier", "_at")


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key. A maximum is combined before the shuffle, so history is not moved."""
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(last.alias("_last")).select(*keys, "_last.*").select(*rows.columns)


def _misses(sightings: DataFrame, runs: DataFrame, most: int) -> DataFrame:
    """The misses after each sighted run of a listing, up to its next one and ``most`` at most, as rows of ``listing_history``.

    Counting runs are numbered within their source, so a miss is the next number: rows are bounded by the sightings.
    """
    key = ["source_id", "listing"]
    known = runs.select("source_id", "run", "counts").unionByName(sightings.select("source_id", "run", F.lit(False).alias("counts")).distinct())
    known = known.groupBy("source_id", "run").agg(F.max(F.coalesce("counts", F.lit(False)).cast("int")).alias("counts"))
    upto = Window.partitionBy("source_id").orderBy("run").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = known.withColumns({"number": F.sum("counts").over(upto), "of_source": F.sum("counts").over(Window.partitionBy("source_id"))})
    sighted = sightings.select(*key, "run").distinct().join(numbered, ["source_id", "run"])
    following = Window.partitionBy(*key).orderBy("run")
    until = F.coalesce(F.lead(F.col("number") - F.col("counts")).over(following), "of_source")
    gaps = sighted.withColumn("until", F.least(until, F.col("number") + most)).where("until > number")
    missed = gaps.select(*key, F.posexplode(F.sequence(F.col("number") + 1, F.col("until"))).alias("nth", "number"))
    counting = numbered.where("counts = 1").select("source_id", "number", "run")
    rest = {"seq": F.lit(None).cast("long"), "seen": F.lit(False), "pending": F.lit(False), "misses": (F.col("nth") + 1).cast("long")}
    return missed.join(counting, ["source_id", "number"]).withColumns(rest).select(*key, "run", *rest)


def listing_history(sightings: DataFrame, runs: DataFrame, gone_after: int = GONE_AFTER) -> DataFrame:
    """Every sighting and every counted miss of each listing, in order, with the status after it.

    sightings: source_id, listing, run, seq (order within a run), pending. runs: source_id, run, counts
    (healthy and from a complete feed). A listing that a counting run lacks has a miss; after
    ``gone_after`` misses in a row it is gone and has no more until it is seen again. Seen again it
    is relisted until a later sighting says pending, after which it follows its sightings.

    Returns source_id, listing, run, seq (null for a miss), seen, pending, misses, status, previous
    (null at the first), first_of_listing.
    """
    threshold = max(gone_after, 1)
    key, order = ["source_id", "listing"], ["run", "seq"]
    events = sightings.select(*key, "run", "seq", F.lit(True).alias("seen"), F.coalesce("pending", F.lit(False)).alias("pending"), F.lit(0).cast("long").alias("misses"))
    events = events.unionByName(_misses(sightings, runs, threshold))
    upto = _before(key, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    ended = (F.col("misses") == threshold).cast("int")
    earlier = _before(key, order).rowsBetween(Window.unboundedPreceding, -1)
    events = events.withColumn("life", F.coalesce(F.sum(ended).over(earlier), F.lit(0)))
    in_life = Window.partitionBy(*key, "life").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    events = events.withColumn("idx", F.sum(F.col("seen").cast("int")).over(in_life))
    again = F.col("seen") & F.col("pending") & (F.col("idx") >= 2)
    events = events.withColumn("had_pending", F.max(again).over(in_life))

    wanted = F.when(F.col("pending"), "pending").otherwise("available")
    sighted = F.when((F.col("life") == 0) | F.col("had_pending"), wanted).otherwise("relisted")
    own = F.when(F.col("seen"), sighted).when(F.col("misses") == threshold, "gone")
    events = events.withColumn("status", F.last(own, ignorenulls=True).over(upto))
    events = events.withColumns({"previous": F.lag("status").over(_before(key, order)), "first_of_listing": F.row_number().over(_before(key, order)) == 1})
    return events.select(*key, "run", "seq", "seen", "pending", "misses", "status", "previous", "first_of_listing")


def current_listings(history: DataFrame) -> DataFrame:
    """State of each listing after its last event: status, misses, first, last seen and last verified run."""
    last = F.struct("run", "seq")
    return history.groupBy("source_id", "listing").agg(
        F.max_by("status", last).alias("status"),
        F.max_by("misses", last).alias("misses"),
        F.min("run").alias("first_seen"),
        F.max(F.when(F.col("seen"), F.col("run"))).alias("last_seen"),
        F.max("run").alias("last_verified"),
    )


def status_events(history: DataFrame) -> DataFrame:
    """Changes of status: source_id, listing, run, seq, step, from_status, to_status.

    A listing begins as available, so one that is pending at its first sighting has two changes there.
    """
    born = F.struct(F.lit(0).alias("step"), F.lit(None).cast("string").alias("from_status"), F.lit("available").alias("to_status"))
    moved = F.struct(
        F.lit(1).alias("step"),
        F.when(F.col("first_of_listing"), F.lit("available")).otherwise(F.col("previous")).alias("from_status"),
        F.col("status").alias("to_status"),
    )
    changes = F.filter(
        F.array(F.when(F.col("first_of_listing"), born), F.when(moved["from_status"] != moved["to_status"], moved)),
        lambda c: c.isNotNull(),
    )
    return history.select("source_id", "listing", "run", "seq", F.explode(changes).alias("c")).select("source_id", "listing", "run", "seq", "c.*")
