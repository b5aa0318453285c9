"""The state of listings, kept up to date run by run.

``operators.lifecycle`` derives states from the whole history; this store holds, for each listing, what its next sighting needs, in buckets by
a hash of the listing. An update reads and writes the buckets of the listings that it brings, and no others. Misses touch no
listing: a source's ledger numbers its counting runs, and a listing has missed those numbered after its last sighting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.lifecycle import GONE_AFTER
from tidemark.stores.commits import Store, dealt, done, shared_folder

BUCKETS = 64
STATE = "source_id string, listing string, status string, number long, first_seen long, last_seen long, seq long, content_hash string"
LEDGER = "source_id string, run long, number long, counts boolean"
SNAPSHOTS = "source_id string, listing string, run long, seq long, content_hash string"
KEY = ["source_id", "listing"]


class ListingStore(Store):
    """Listings of any number of sources; a store keeps the number of buckets and misses that it was made with."""

    def __init__(self, spark: SparkSession, uri: str, buckets: int = BUCKETS, gone_after: int = GONE_AFTER):
        super().__init__(spark, uri)
        content = self.last()[1]
        self.buckets, self.threshold = content.get("buckets", buckets), content.get("gone_after", max(gone_after, 1))

    def _bucket(self):
        return F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int")

    def ledger(self) -> DataFrame:
        """Every run, with the number of counting runs of its source up to it: source_id, run, number, counts."""
        return self.read(self.last()[1].get("ledger", []), LEDGER)

    def snapshots(self) -> DataFrame:
        """Sightings whose content differed from the one before: source_id, listing, run, seq, content_hash."""
        return self.read(self.last()[1].get("snapshots", []), SNAPSHOTS)

    def state(self, buckets: list[int] | None = None) -> DataFrame:
        """What is kept of each listing as of its last sighting, of all buckets or some."""
        return self._state(self.last()[1], buckets)

    def _state(self, content: dict, buckets: list[int] | None = None) -> DataFrame:
        held = content.get("state", {})
        return self.read([f"{held[b]}/bucket={b}" for b in held if buckets is None or int(b) in buckets], STATE)

    def current(self) -> DataFrame:
        """State of each listing after the last run, as ``lifecycle.current_listings`` gives it."""
        ledger = self.ledger()
        totals = ledger.groupBy("source_id").agg(F.max("number").alias("total"))
        missed = self.state().join(dealt(totals), "source_id").withColumn("misses", F.least(F.col("total") - F.col("number"), F.lit(self.threshold).cast("long")))
        counting = ledger.where("counts").select("source_id", F.col("number").alias("nth"), "run")
        dated = missed.withColumn("nth", F.col("number") + F.col("misses")).join(dealt(counting), ["source_id", "nth"], "left")
        gone = F.col("misses") >= self.threshold
        return dated.select(*KEY, F.when(gone, "gone").otherwise(F.col("status")).alias("status"), "misses", "first_seen", "last_seen", F.when(F.col("misses") > 0, F.col("run")).otherwise(F.col("last_seen")).alias("last_verified"))

    def upsert(self, sightings: DataFrame, runs: DataFrame, batch: int | None = None) -> list[int]:
        """Adds the next runs and their sightings; the buckets that were written.

        sightings: source_id, listing, run, seq, pending, content_hash. runs: source_id, run, counts (healthy and from a
        complete feed); a run that only sightings name does not count. Runs of a source come in order over updates; one that is not later
        than those already there is an error. An update that another overtakes is made again.
        """
        while True:
            number, content = self.last()
            if done(content, batch):
                return []
            ledger = self._numbered(sightings, runs, content)
            merged, touched = self._merged(sightings, ledger, content)
            key = F.struct(F.col("fresh"), "run", "seq")
            state = merged.groupBy(*KEY).agg(F.max_by(F.struct("status", "number", F.col("run").alias("last_seen"), "seq", "content_hash"), key).alias("last"), F.min("first_seen").alias("first_seen"))
            state = state.select(*KEY, "last.status", "last.number", "first_seen", "last.last_seen", "last.seq", "last.content_hash")
            stay = self._state(content, touched).join(dealt(state.select(*KEY)), KEY, "left_anti")
            whole = state.unionByName(stay).withColumn("bucket", self._bucket())
            names = {
                "state": self.write(whole.repartition("bucket"), "bucket"),
                "ledger": self.write(ledger),
                "snapshots": self.write(merged.where("fresh AND changed").select(*KEY, "run", "seq", "content_hash")),
            }
            update = {"state": content.get("state", {}) | {str(b): names["state"] for b in touched}, "buckets": self.buckets, "gone_after": self.threshold}
            update |= {k: [*content.get(k, []), names[k]] for k in ("ledger", "snapshots")}
            if self.commit(number, content | update | ({} if batch is None else {"batch": batch})):
                return touched

    def _numbered(self, sightings: DataFrame, runs: DataFrame, content: dict) -> DataFrame:
        """The new part of the ledger."""
        told = runs.select("source_id", "run", F.coalesce("counts", F.lit(False)).alias("counts"))
        known = told.unionByName(sightings.select("source_id", "run", F.lit(False).alias("counts")).distinct()).groupBy("source_id", "run").agg(F.max("counts").alias("counts"))
        before = self.read(content.get("ledger", []), LEDGER).groupBy("source_id").agg(F.max("number").alias("total"), F.max("run").alias("latest"))
        upto = Window.partitionBy("source_id").orderBy("run").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        late = F.raise_error(F.concat(F.lit("run "), F.col("run"), F.lit(" of "), F.col("source_id"), F.lit(" comes after run "), F.col("latest")))
        numbered = known.join(before, "source_id", "left").withColumn("number", F.coalesce("total", F.lit(0)) + F.sum(F.col("counts").cast("long")).over(upto))
        return numbered.select("source_id", F.when(F.coalesce(F.col("run") <= F.col("latest"), F.lit(False)), late.cast("long")).otherwise(F.col("run")).alias("run"), "number", "counts")

    def _merged(self, sightings: DataFrame, ledger: DataFrame, content: dict) -> tuple[DataFrame, list[int]]:
        """What was kept of the sighted listings and their new sightings, each with the status after it, written for the uses it has; and their buckets."""
        spark = self.spark
        scratch = Store(spark, shared_folder(spark, "listings"))
        seen = sightings.join(dealt(ledger), ["source_id", "run"]).select(*KEY, "run", "seq", F.coalesce("pending", F.lit(False)).alias("pending"), "content_hash", "number", (F.col("number") - F.col("counts").cast("long")).alias("before"))
        seen = seen.withColumns({"first_seen": F.col("run"), "fresh": F.lit(True), "was": F.lit(None).cast("string")})
        touched = sorted(r["b"] for r in seen.select(self._bucket().alias("b")).distinct().collect())  # at most as many as there are buckets
        kept = self._state(content, touched).join(dealt(seen.select(*KEY).distinct()), KEY, "left_semi")
        kept = kept.select(*KEY, F.col("last_seen").alias("run"), "seq", F.lit(False).alias("pending"), "content_hash", "number", F.col("number").alias("before"), "first_seen", F.lit(False).alias("fresh"), F.col("status").alias("was"))
        order = ["fresh", "run", "seq"]
        by_key = Window.partitionBy(*KEY).orderBy(*order)
        upto = by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = seen.unionByName(kept).withColumns({"ended": F.coalesce(F.col("before") - F.lag("number").over(by_key) >= self.threshold, F.lit(False)), "changed": (F.row_number().over(by_key) == 1) | ~F.col("content_hash").eqNullSafe(F.lag("content_hash").over(by_key))})
        rows = rows.withColumns({"life": F.sum(F.col("ended").cast("int")).over(upto), "resumed": F.first("was").over(upto) == "relisted"})
        in_life = Window.partitionBy(*KEY, "life").orderBy(*order)
        rows = rows.withColumn("nth", F.row_number().over(in_life))
        rows = rows.withColumn("again", F.max(F.col("pending") & (F.col("nth") > 1)).over(in_life.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        back = (F.col("life") > 0) | F.coalesce(F.col("resumed"), F.lit(False))
        status = F.when(~F.col("fresh"), F.col("was")).when(back & ~F.col("again"), "relisted").when(F.col("pending"), "pending").otherwise("available")
        named = rows.select(*KEY, "run", "seq", "content_hash", "number", "first_seen", "fresh", "changed", status.alias("status"))
        return scratch.read([scratch.write(named)], named.schema), touched
