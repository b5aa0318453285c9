"""Lifecycle and change capture against a sequential simulation, in batch and on a stream."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import lifecycle as L
from tidemark.streaming import lifecycle as S

SIGHTINGS = "source_id string, listing string, run long, seq long, pending boolean"
RUNS = "source_id string, run long, counts boolean"


def simulate(sightings, runs, threshold):
    """Row by row, as a poller with a mutable table would."""
    state, events = {}, []

    def move(key, new, run, seq, step=1):
        if state[key][0] != new:
            events.append((*key, run, seq, step, state[key][0], new))
            state[key][0] = new

    for source, run, counts in sorted(runs, key=lambda r: r[1]):
        seen = set()
        for _, listing, _, seq, pending in sorted(s for s in sightings if s[0] == source and s[2] == run):
            key = (source, listing)
            seen.add(key)
            if key not in state:
                state[key] = [None, 0]
                move(key, "available", run, seq, 0)
            state[key][1] = 0
            wanted = "pending" if pending else "available"
            if state[key][0] == "gone":
                move(key, "relisted", run, seq)
            elif state[key][0] != "relisted" or wanted == "pending":
                move(key, wanted, run, seq)
        if counts:
            for key, row in state.items():
                if key[0] == source and key not in seen and row[0] != "gone":
                    row[1] += 1
                    if row[1] >= threshold:
                        move(key, "gone", run, None)
    return state, events


def random_history(seed, listings=60, runs=25):
    rng = random.Random(seed)
    table = [(s, r, rng.random() < 0.8) for s in ("a", "b") for r in range(runs)]
    seen, seq = [], 0
    for source, run, _ in table:
        for k in range(listings):
            for _ in range(rng.choice((0, 0, 0, 1, 1, 2)) if rng.random() < 0.7 else 0):
                seq += 1
                seen.append((source, f"l{k}", run, seq, rng.random() < 0.3))
    rng.shuffle(seen)
    return sorted(seen, key=lambda s: (s[0], s[2], s[3])), table


@pytest.mark.parametrize("threshold", [0, 3])
def test_history_equals_the_simulation(spark, threshold):
    seen, runs = random_history(threshold)
    state, events = simulate(seen, runs, max(threshold, 1))
    history = L.listing_history(spark.createDataFrame(seen, SIGHTINGS), spark.createDataFrame(runs, RUNS), threshold).cache()
    got = {(r["source_id"], r["listing"]): r["status"] for r in L.current_listings(history).collect()}
    assert got == {k: v[0] for k, v in state.items()}
    assert {tuple(r) for r in L.status_events(history).collect()} == set(events)
    assert len(events) > 200


def test_gone_after_the_third_miss_and_back(spark):
    seen = [("a", "x", 1, 1, False), ("a", "y", 1, 2, False), ("a", "x", 6, 3, False), ("a", "x", 7, 4, True)]
    runs = [("a", r, r != 3) for r in range(1, 8)]
    history = L.listing_history(spark.createDataFrame(seen, SIGHTINGS), spark.createDataFrame(runs, RUNS))
    events = [(r["run"], r["from_status"], r["to_status"]) for r in L.status_events(history).where("listing = 'x'").orderBy("run", "step").collect()]
    assert events == [(1, None, "available"), (5, "available", "gone"), (6, "gone", "relisted"), (7, "relisted", "pending")]
    x, y = (L.current_listings(history).where(f"listing = '{k}'").first() for k in "xy")
    assert (x["last_seen"], x["last_verified"], y["status"], y["misses"], y["last_verified"]) == (7, 7, "gone", 3, 5)


def test_first_sighting_that_is_pending_has_two_events(spark):
    history = L.listing_history(spark.createDataFrame([("a", "x", 1, 1, True)], SIGHTINGS), spark.createDataFrame([("a", 1, True)], RUNS))
    events = L.status_events(history).orderBy("step").collect()
    assert [(r["from_status"], r["to_status"]) for r in events] == [(None, "available"), ("available", "pending")]


def test_no_rows(spark):
    history = L.listing_history(spark.createDataFrame([], SIGHTINGS), spark.createDataFrame([], RUNS))
    assert L.current_listings(history).count() == L.status_events(history).count() == 0


def test_snapshots_keep_changes_back_and_forth(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("a", 4, "x"), ("a", 5, None), ("a", 6, None), ("b", 1, None)], "k string, n int, v string")
    kept = L.snapshots_on_change(rows, ["k"], ["n"], "v").orderBy("k", "n").collect()
    assert [(r["k"], r["n"]) for r in kept] == [("a", 1), ("a", 3), ("a", 4), ("a", 5), ("b", 1)]
    assert [(r["k"], r["n"], r["v"]) for r in L.latest_per_key(rows, ["k"], ["n"]).orderBy("k").collect()] == [("a", 6, None), ("b", 1, None)]


def run_stream(spark, tmp_path, schema, batches, transform):
    out, rows = [], tmp_path / "in"
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(rows))
        query = (
            transform(spark.readStream.schema(schema).parquet(str(rows)))
            .writeStream.option("checkpointLocation", str(tmp_path / "ck"))
            .foreachBatch(lambda df, _: out.extend(tuple(r) for r in df.collect()))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination(120)
    return out


def test_stream_of_events_equals_the_batch(spark, tmp_path):
    seen, runs = random_history(7, listings=8, runs=8)
    history = L.listing_history(spark.createDataFrame(seen, SIGHTINGS), spark.createDataFrame(runs, RUNS), 2)
    rows = [tuple(r) for r in history.select("source_id", "listing", "run", "seq", "seen", "pending").collect()]
    schema = "source_id string, listing string, run long, seq long, seen boolean, pending boolean"
    halves = [[r for r in rows if (r[2] < 4) == early] for early in (True, False)]
    got = run_stream(spark, tmp_path, schema, halves, lambda df: S.stream_status_events(df, 2))
    assert sorted(got, key=str) == sorted((tuple(r) for r in L.status_events(history).collect()), key=str)


def test_stream_of_changes_equals_the_batch(spark, tmp_path):
    schema = "source_id string, listing string, run long, seq long, content_hash string"
    rng = random.Random(1)
    rows = [("a", f"l{k % 5}", n // 10, n, rng.choice("xy")) for n, k in enumerate(rng.choices(range(10), k=60))]
    got = run_stream(spark, tmp_path, schema, [rows[:30], rows[30:]], S.stream_changes)
    kept = L.snapshots_on_change(spark.createDataFrame(rows, schema), ["source_id", "listing"], ["run", "seq"], "content_hash")
    assert sorted(got) == sorted(tuple(r) for r in kept.collect())


def test_misses_of_a_run(spark):
    active = spark.createDataFrame([("a", "x"), ("a", "y")], "source_id string, listing string")
    seen = spark.createDataFrame([("a", "x", 3, 1, False)] * 2, SIGHTINGS)
    assert [tuple(r) for r in S.run_misses(active, seen, 3).collect()] == [("a", "y", 3, None, False, False)]
