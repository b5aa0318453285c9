"""Paged sources and followed folders: gaps, ends, crashes between stores and replays."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemark.plans.ingest import derive
from tidemark.sources import json_api, paged
from tidemark.stores.commits import Store
from tidemark.streaming.ingest import Ingest, feed_records, landed_fetches


def response(page, total, n=3):
    return json.dumps({"listings": [{"listingID": f"{page}-{k}", "isActive": "0" if k == 1 else "1", "note": "é "} for k in range(n)], "pagination": {"total_pages": total}})


def collected(df):
    return sorted((r.page, r.seq, json.loads(r.record)["listingID"]) for r in df.select("page", "seq", F.to_json("record").alias("record")).collect())


def test_pages_equal_api_records(spark, tmp_path):
    rows = [(p, response(p, 6)) for p in (4, 1, 6, 2, 9)]  # out of order, with gaps and one past the end
    paged.land(spark.createDataFrame(rows, "page long, body string"), str(tmp_path / "p"))
    read = paged.read_pages(spark, str(tmp_path / "p"))
    table = spark.createDataFrame([(p, p, b) for p, b in rows if p <= 6], "fetch_id long, page long, body string").withColumn("body", F.col("body").cast("binary"))
    assert collected(json_api.active(read)) == collected(json_api.api_records(table)) and len(collected(read)) == 12
    assert read.rdd.getNumPartitions() == 4  # a partition a page


def test_pages_without_listings_fail_and_no_pages_are_no_rows(spark, tmp_path):
    assert paged.read_pages(spark, str(tmp_path / "none")).collect() == []
    paged.land(spark.createDataFrame([(1, '{"error": 1}')], "page long, body string"), str(tmp_path / "p"))
    with pytest.raises(Exception, match="page 1 has no listings"):
        paged.read_pages(spark, str(tmp_path / "p")).collect()


def test_a_stream_of_pages_waits_at_gaps_and_stops_at_the_end(spark, tmp_path):
    out, landed = [], str(tmp_path / "p")

    def step(*pages):
        if pages:
            paged.land(spark.createDataFrame([(p, response(p, 4, 2)) for p in pages], "page long, body string"), landed)
        before = len(out)
        stream = paged.stream_pages(spark, landed).select("page", "seq").writeStream.foreachBatch(lambda df, _: out.extend(r.page for r in df.collect()))
        stream.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
        return sorted(set(out[before:]))

    assert [step(2), step(1), step(4, 5), step(3), step()] == [[], [1, 2], [], [3, 4], []]


def feeds():
    """Two sources over six runs: listings that come, change, go and come back, a drop and a run that fails."""
    for run in range(1, 7):
        a = [{"external_id": f"a{k}", "url": f"u{k}", "rent": 1000 + (run > 3) * (k % 2), "status": "pending" if (k + run) % 5 == 0 else None} for k in range(12) if not (k == 3 and 2 <= run <= 4) and not (run == 5 and k > 2)]
        yield "a", run, a
        yield "b", run, [{"external_id": f"b{k}", "url": "" if run == 3 and k == 2 else "u", "title": f"t{run // 4}"} for k in range(4 if run != 6 else 0)]


def land(path, run):
    for source, r, records in feeds():
        if r == run:
            folder = path / f"source_id={source}" / f"run={r}"
            folder.mkdir(parents=True)
            (folder / "feed.json").write_text(json.dumps(records))


SOURCES = "source_id string, expected_min int, expected_max int"
COLUMNS = ["source_id", "listing", "status", "misses", "first_seen", "last_seen", "last_verified"]


def contents(ingest):
    blobs = sorted((r.sha256, hashlib.sha256(bytes(r.body)).hexdigest()) for r in ingest.blobs.blobs().collect())
    fetches = sorted(map(tuple, ingest.fetches.rows().select("source_id", "run", "sha256").collect()))
    runs = sorted((tuple(r) for r in ingest.runs.rows().collect()), key=str)
    listings = sorted(map(tuple, ingest.listings.current().select(COLUMNS).collect()))
    snapshots = sorted((tuple(r) for r in ingest.listings.snapshots().collect()), key=str)
    return blobs, fetches, runs, listings, snapshots


def test_crashes_between_stores_change_nothing(spark, tmp_path, monkeypatch):
    landed, sources = tmp_path / "landed", spark.createDataFrame([("b", 1, None)], SOURCES)
    ingest = Ingest(spark, str(tmp_path / "home"), sources, gone_after=2, buckets=3)
    for sink in ("keep_blobs", "log_fetches", "observe", "judge", "update"):  # each crashes once, before and after its commit
        for after in (False, True):
            whole = getattr(Ingest, sink)

            def crash(self, files, batch, whole=whole, after=after):
                if after:
                    whole(self, files, batch)
                raise RuntimeError("crashed here")

            monkeypatch.setattr(Ingest, sink, crash)
            if not after and sink in ("keep_blobs", "observe", "update"):
                done = 2 * ("keep_blobs", "observe", "update").index(sink)
                land(landed, done + 1), land(landed, done + 2)
            with pytest.raises(Exception, match="crashed here"):
                ingest.follow(str(landed), str(tmp_path / "ck")).awaitTermination(200)
            monkeypatch.setattr(Ingest, sink, whole)
        ingest.follow(str(landed), str(tmp_path / "ck")).awaitTermination(200) if sink in ("log_fetches", "judge", "update") else None
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(landed))
    once = Ingest(spark, str(tmp_path / "once"), sources, gone_after=2, buckets=3)
    once.batch(files, 0)
    got = contents(ingest)
    assert got == contents(once)

    by_run = {(r[0], r[1]): r for r in got[2]}
    assert by_run["b", 3][2:4] == ("failed", 2) and "'b2' from b has no URL" in by_run["b", 3][-1]
    assert by_run["a", 5][6] == "sudden drop: 3 vs recent median 11" and by_run["b", 6][6] == "count 0 below expected minimum 1; sudden drop: 0 vs recent median 4"
    observations = once.observations.rows()
    runs = once.runs.rows().select("source_id", "run", "status", F.lit(True).alias("complete_feed")).join(sources, "source_id", "left")
    views = derive(observations, runs, 2)
    assert sorted(map(tuple, views.listings.select(COLUMNS).collect())) == got[3]
    key = ("source_id", "external_id", "run", "seq", "content_hash")
    assert sorted((tuple(r) for r in views.snapshots.select(*key).collect()), key=str) == got[4]


def test_records_are_dealt_out_and_never_sent_through_the_driver(spark, tmp_path, monkeypatch):
    def final(df):
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]

    for run in (1, 2):
        land(tmp_path / "landed", run)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path / "landed"))
    assert "Broadcast" not in final(feed_records(landed_fetches(files)))
    joins, write = {}, Store.write

    def watched(self, rows, *by):
        if by == ("bucket",) or "fresh" in rows.columns:
            joins[by] = final(rows).count("SortMergeJoin")
        return write(self, rows, *by)

    monkeypatch.setattr(Store, "write", watched)
    ingest = Ingest(spark, str(tmp_path / "home"), buckets=3)
    for run in (1, 2):
        ingest.batch(files.where(F.col("path").contains(f"run={run}/")), run)
    assert len(joins) == 2 and all(joins.values())  # the sightings with their runs, and the states that stay
    assert "Broadcast" not in final(ingest.listings.current())


def test_a_task_reads_many_pages(spark, tmp_path):
    rows = [(p, response(p, 450, 1)) for p in range(1, 451)]
    paged.land(spark.createDataFrame(rows, "page long, body string").coalesce(1), str(tmp_path))
    read = paged.read_pages(spark, str(tmp_path))
    assert sorted(r.page for r in read.select("page").collect()) == list(range(1, 451)) and read.rdd.getNumPartitions() == 150
    assert [p.value for p in paged.planned(range(0))] == [[]] and [len(p.value) for p in paged.planned(range(100_000))] == [256] * 390 + [160]
