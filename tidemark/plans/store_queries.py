"""Registered queries of sources that are followed and of stores, each beside its DuckDB counterpart.

What they write goes below ``spark.checkpoint.dir``, under a name of its own for each call.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import archive
from tidemark.plans.queries import _HISTORY_SQL, _VERDICTS_SQL, _runs, query, table
from tidemark.sources import json_api, paged
from tidemark.stores.blobs import BlobStore
from tidemark.stores.commits import dealt, shared_folder
from tidemark.stores.listings import ListingStore
from tidemark.streaming.ingest import Ingest
from tidemark.streaming.lifecycle import ROCKSDB
from tidemark.streaming.state import VERDICTS, stream_verdicts


@query("""
    SELECT c_custkey // 40 + 1 AS page, c_custkey % 40 AS seq, 'c' || c_custkey AS listing, c_name AS name FROM customer
    WHERE c_custkey % 11 <> 0 AND (c_custkey // 40 + 1) % 5 <> 2 AND c_custkey // 40 + 1 <= (SELECT max(c_custkey) // 40 FROM customer)""")
def paged_source(spark, sf_dir):
    """Landed pages with gaps, of which the last is past the end that the API tells."""
    customer = table(spark, sf_dir, "customer").withColumn("page", F.expr("c_custkey div 40 + 1"))
    record = F.expr("named_struct('listingID', concat('c', c_custkey), 'isActive', if(c_custkey % 11 = 0, '0', '1'), 'name', c_name)")
    last = customer.agg(F.max("page").alias("last")).withColumn("_", F.lit(1))
    made = F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", record.alias("r")))), lambda x: x["r"])
    pages = customer.where("page % 5 <> 2").groupBy("page").agg(made.alias("listings")).withColumn("_", F.lit(1)).join(last, "_")
    body = F.to_json(F.struct("listings", F.struct((F.col("last") - 1).alias("total_pages")).alias("pagination")))
    landed = shared_folder(spark, "pages")
    paged.land(pages.select("page", body.alias("body")), landed)
    active = json_api.active(paged.read_pages(spark, landed))
    return active.select("page", "seq", F.try_variant_get("record", "$.listingID", "string").alias("listing"), F.try_variant_get("record", "$.name", "string").alias("name"))


@query(_HISTORY_SQL + """
    SELECT listing, last(status ORDER BY run, seq NULLS FIRST) AS status, last(misses ORDER BY run, seq NULLS FIRST)::BIGINT AS misses,
        min(run) AS first_seen, max(run) FILTER (WHERE seen) AS last_seen, max(run) AS last_verified FROM h GROUP BY listing""")
def listing_updates(spark, sf_dir):
    """The states of ``listing_lifecycle``, kept up to date in three updates."""
    events = table(spark, sf_dir, "events")
    dated = events.select("*", F.date_diff(F.to_date("ts"), F.lit("2020-01-01").cast("date")).cast("long").alias("run"), F.lit("all").alias("source_id"))
    seen = dated.where(F.col("event_type").isin("view", "error"))
    seen = seen.select("source_id", F.col("user_id").cast("string").alias("listing"), "run", F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("pending"), F.col("event_type").alias("content_hash"))
    runs = dated.select("source_id", "run", F.lit(True).alias("counts")).distinct()
    low, high = dated.agg(F.min("run"), F.max("run")).first()
    store, cuts = ListingStore(spark, shared_folder(spark, "store"), 16), [low, (2 * low + high) // 3, (low + 2 * high) // 3, high + 1]
    for k, (start, end) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = (F.col("run") >= start) & (F.col("run") < end)
        store.upsert(seen.where(part), runs.where(part), k)
    return store.current().drop("source_id").withColumn("listing", F.col("listing").cast("long"))


@query("""
    WITH b AS (SELECT sha256(text) AS sha256, octet_length(encode(first(text)))::BIGINT AS size, min(doc_id % 10) AS least FROM documents WHERE text IS NOT NULL GROUP BY 1)
    SELECT sha256, size FROM b WHERE sha256 IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 < 7 AND doc_id % 3 = 0)""")
def blob_store(spark, sf_dir):
    """Texts stored in two writes that overlap, and those of some documents read back."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("fetch_id"), F.col("text").cast("binary").alias("body"), F.lit("text").alias("content_type"))
    store = BlobStore(spark, shared_folder(spark, "blobs"))
    store.put(docs.where("fetch_id % 10 < 5"))
    store.put(docs.where("fetch_id % 10 >= 3"))
    return store.get(archive.fetch_log(docs.where("fetch_id % 10 < 7 AND fetch_id % 3 = 0")).where("sha256 IS NOT NULL").select("sha256")).select("sha256", F.octet_length("body").cast("long").alias("size"))


@query("""
    SELECT 's' || (c_custkey - 1) // 1500 AS source_id, 'c' || c_custkey AS listing,
        CASE WHEN c_custkey % 6 = 0 THEN 'gone' WHEN c_mktsegment = 'BUILDING' THEN 'pending' ELSE 'available' END AS status, greatest(0, 3 - c_custkey % 6) AS misses,
        1 AS first_seen, c_custkey % 6 + 1 AS last_seen, greatest(4, c_custkey % 6 + 1) AS last_verified, (c_custkey % 6) // 2 + 1 AS snapshots FROM customer""")
def streamed_ingest(spark, sf_dir):
    """Feeds of six runs land in two deliveries, which the stream follows; a listing is in fewer runs than the next, so the last two runs drop too far and are unhealthy."""
    customer = table(spark, sf_dir, "customer").withColumn("source_id", F.expr("concat('s', (c_custkey - 1) div 1500)"))
    fields = "named_struct('external_id', concat('c', c_custkey), 'url', concat('https://h.org/', c_custkey), 'rent', c_nationkey + (run - 1) div 2, 'status', if(c_mktsegment = 'BUILDING', 'pending', ''))"
    feeds = customer.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(6)))).where("c_custkey % 6 >= run - 1")
    feeds = feeds.groupBy("source_id", "run").agg(F.to_json(F.collect_list(F.expr(fields))).alias("value"))  # a feed is one file, of 1,500 records at most
    home = shared_folder(spark, "ingest")
    ingest = Ingest(spark, home)
    for runs in ("run <= 3", "run > 3"):
        feeds.where(runs).write.mode("append").partitionBy("source_id", "run").text(f"{home}-landed")
        ingest.follow(f"{home}-landed", f"{home}/checkpoint").awaitTermination()
    changed = ingest.listings.snapshots().groupBy("source_id", "listing").agg(F.count("*").alias("snapshots"))
    return ingest.listings.current().join(dealt(changed), ["source_id", "listing"])


@query(_VERDICTS_SQL + " SELECT source_id, run, n, recent_median, healthy FROM fold")
def streamed_verdicts(spark, sf_dir):
    """The verdicts of ``run_health``, from a stream that gets the runs in two deliveries."""
    runs = _runs(spark, sf_dir).select("source_id", "run", F.expr("if(run % 7 = 0, null, listings)").alias("n"), F.lit(2).alias("expected_min"), F.lit(40).alias("expected_max"), F.lit(True).alias("complete_feed"))
    home, provider = shared_folder(spark, "verdicts"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, ROCKSDB)
    try:
        for early in (True, False):
            middle = runs.agg(F.expr("(min(run) + max(run)) div 2").alias("middle")).first()["middle"]
            runs.where((F.col("run") < middle) == early).write.mode("append").parquet(f"{home}/runs")
            judged = stream_verdicts(spark.readStream.schema(runs.schema).parquet(f"{home}/runs"))
            judged.writeStream.format("parquet").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start(f"{home}/verdicts").awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(VERDICTS).parquet(f"{home}/verdicts").select("source_id", "run", "n", "recent_median", "healthy")
