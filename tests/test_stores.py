"""Stores against full derivation, with splits, replays, crashes and competing writers."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests.test_lifecycle import RUNS, random_history
from tidemark.operators import lifecycle as L
from tidemark.stores.blobs import BlobStore
from tidemark.stores.commits import Appended, Store
from tidemark.stores.listings import ListingStore

SIGHTINGS = "source_id string, listing string, run long, seq long, pending boolean, content_hash string"
FETCHES = "fetch_id long, body binary, content_type string"


def with_content(seen, seed):
    rng = random.Random(seed)
    return [(*s, rng.choice(("x", "x", "y", None))) for s in seen]


@pytest.mark.parametrize(("seed", "threshold", "cuts"), [(1, 3, [1, 2, 3, 9, 10]), (2, 1, [5]), (3, 2, [4, 8, 12])])
def test_updates_equal_full_derivation_after_any_split(spark, tmp_path, seed, threshold, cuts):
    seen, runs = random_history(seed, listings=25, runs=14)
    seen = with_content(seen, seed)
    sightings, every = spark.createDataFrame(seen, SIGHTINGS), spark.createDataFrame(runs, RUNS)
    history = L.listing_history(sightings.drop("content_hash"), every, threshold)
    store = ListingStore(spark, str(tmp_path / "s"), 5, threshold)
    for k, (low, high) in enumerate(zip([0, *cuts], [*cuts, 14], strict=True)):
        for _ in (0, 1):  # a batch that comes again changes nothing
            part = f"run >= {low} AND run < {high}"
            store.upsert(sightings.where(part), every.where(part), batch=k)
    wanted = L.current_listings(history)
    assert sorted(map(tuple, ListingStore(spark, str(tmp_path / "s")).current().select(*wanted.columns).collect())) == sorted(map(tuple, wanted.collect()))
    changed = L.snapshots_on_change(sightings, ["source_id", "listing"], ["run", "seq"], "content_hash").drop("pending")
    assert sorted(map(tuple, store.snapshots().collect()), key=str) == sorted(map(tuple, changed.collect()), key=str)


def test_an_update_writes_the_buckets_of_its_listings_only(spark, tmp_path):
    store = ListingStore(spark, str(tmp_path / "s"), 16)
    rows = [("a", f"l{k}", 1, k, False, "x") for k in range(200)]
    runs = spark.createDataFrame([("a", r, True) for r in range(1, 4)], RUNS)
    assert len(store.upsert(spark.createDataFrame(rows, SIGHTINGS), runs.where("run = 1"))) == 16
    before = store.last()[1]["state"]
    touched = store.upsert(spark.createDataFrame([("a", "l7", 2, 1, False, "y"), ("a", "l7", 2, 2, True, "y")], SIGHTINGS), runs.where("run = 2"))
    after = store.last()[1]["state"]
    assert len(touched) == 1 and [b for b in after if after[b] != before[b]] == [str(touched[0])]
    read = store.state(touched)
    assert {f.split("/bucket=")[1].split("/")[0] for f in read.inputFiles()} == {str(touched[0])} and read.count() < 40
    got = {r.listing: r for r in store.current().collect()}
    assert (got["l7"].status, got["l7"].misses, got["l8"].misses, got["l8"].last_verified, len(got)) == ("pending", 0, 1, 2, 200)
    with pytest.raises(Exception, match="run 2 of a comes after run 2"):
        store.upsert(spark.createDataFrame([("a", "l7", 2, 1, False, "y")], SIGHTINGS), runs.where("run = 2"))
    assert store.upsert(spark.createDataFrame([], SIGHTINGS), runs.where("run = 3")) == []  # misses of all touch no bucket
    assert {r.listing: r.misses for r in store.current().collect()}["l8"] == 2
    assert store.sweep() and store.current().count() == 200


def test_one_writer_of_a_commit_wins(spark, tmp_path):
    a, b = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    assert a.last() == (0, {}) and a.commit(0, {"x": 1}) and not b.commit(0, {"x": 2})
    assert b.last() == (1, {"x": 1}) and b.commit(1, {"x": 3}) and a.last() == (2, {"x": 3})


def test_appended_batches_count_once(spark, tmp_path):
    table = Appended(spark, str(tmp_path / "s"), "id long")
    for batch in (0, 0, 1, 0, 1):
        table.append(spark.range(batch, batch + 3), batch)
    table.write(spark.range(50))  # a writer that died before its commit
    assert sorted(r.id for r in table.rows().collect()) == [0, 1, 1, 2, 2, 3] and [r.id for r in table.rows(1).orderBy("id").collect()] == [1, 2, 3]
    assert len(table.sweep()) == 1 and table.rows().count() == 6
    assert Appended(spark, str(tmp_path / "none"), "id long").rows().collect() == []


def bodies(*texts):
    return [(k, None if t is None else bytearray(t.encode()), f"t{k}") for k, t in enumerate(texts)]


def test_blobs_are_stored_once_over_writes(spark, tmp_path):
    store = BlobStore(spark, str(tmp_path / "s"))
    texts = [f"page {k % 60}" for k in range(200)] + [None, ""]
    assert store.put(spark.createDataFrame(bodies(*texts), FETCHES)) == 61
    assert store.put(spark.createDataFrame(bodies(*texts, "new", "new"), FETCHES)) == 1
    wanted = {hashlib.sha256(t.encode()).hexdigest(): t.encode() for t in {*texts, "new"} - {None}}
    assert {r.sha256: bytes(r.body) for r in store.blobs().collect()} == wanted and store.blobs().count() == len(wanted)
    assert store.put(spark.createDataFrame([], FETCHES)) == 0


def test_reads_go_to_the_prefixes_asked_for(spark, tmp_path):
    store = BlobStore(spark, str(tmp_path / "s"))
    store.put(spark.createDataFrame(bodies(*(f"page {k}" for k in range(3000))), FETCHES))
    asked = [hashlib.sha256(f"page {k}".encode()).hexdigest() for k in range(10)] + ["00" * 32]
    for got in (store.get(asked), store.get(spark.createDataFrame([(h,) for h in asked], "sha256 string"))):
        prefixes = {f.split("prefix=")[1][:2] for f in got.inputFiles()}
        assert prefixes <= {h[:2] for h in asked} and len(prefixes) <= 11
        assert sorted(bytes(r.body).decode() for r in got.collect()) == sorted(f"page {k}" for k in range(10))
    store.put(spark.createDataFrame(bodies("other"), FETCHES))
    count = store.blobs().count()
    store.compact(0)
    assert store.blobs().count() == count and all(len(n) == 1 for n in store.last()[1]["parts"].values()) and store.sweep()


def test_concurrent_writers_store_a_hash_once(spark, tmp_path, monkeypatch):
    """The second writer commits after the first has staged its rows and before it commits them."""
    one, two = BlobStore(spark, str(tmp_path / "s")), BlobStore(spark, str(tmp_path / "s"))
    stage, overtaken = one._staged, []

    def staged(blobs):
        name = stage(blobs)
        if not overtaken:
            overtaken.append(two.put(spark.createDataFrame(bodies(*(f"p{k}" for k in range(5, 25))), FETCHES)))
        return name

    monkeypatch.setattr(one, "_staged", staged)
    assert one.put(spark.createDataFrame(bodies(*(f"p{k}" for k in range(15))), FETCHES)) == 5 and overtaken == [20]
    assert one.blobs().groupBy("sha256").count().where("count > 1").isEmpty() and two.blobs().count() == 25


def test_a_batch_of_blobs_counts_once(spark, tmp_path):
    store = BlobStore(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame(bodies("a", "b"), FETCHES)
    assert [store.put(rows, 0), store.put(rows, 0), store.put(rows.union(rows.withColumn("body", F.lit(b"c"))), 1)] == [2, 0, 1]
