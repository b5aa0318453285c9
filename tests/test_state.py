"""Keyed state on streams and schema versions, against the batch operators."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from tests.test_lifecycle import run_stream
from tidemark.operators import health, jobs
from tidemark.stores.versions import Add, Drop, Rename, Versioned, Widen
from tidemark.streaming import state as S

RUNS = "source_id string, run long, n long, expected_min int, expected_max int, complete_feed boolean"
SIGNS = "id long, status string, at timestamp"
START = dt.datetime(2025, 1, 1, 12)


@pytest.fixture(autouse=True)
def one_partition(spark):
    """Each partition of a state has a worker of its own, which small tables do not need."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def run_table(seed=4):
    rng = random.Random(seed)
    return [(f"s{s}", r, rng.choice((0, 3, 5, 8, 9, 10, 20, None)), 1 if s % 2 else None, 15 if s % 3 else None, s != 2) for s in range(4) for r in range(16)]


@pytest.mark.parametrize("cuts", [[3, 11]])
def test_verdicts_of_a_stream_equal_the_batch(spark, tmp_path, cuts):
    rows = run_table()
    batches = [[r for r in rows if low <= r[1] < high] for low, high in zip([0, *cuts], [*cuts, 16], strict=True)]
    got = run_stream(spark, tmp_path, RUNS, batches, S.stream_verdicts)
    wanted = health.assess_runs(spark.createDataFrame(rows, RUNS))
    assert sorted((r[:6] for r in got), key=str) == sorted(map(tuple, wanted.collect()), key=str)
    assert all(r[6] == (r[4] and r[0] != "s2") for r in got)


def test_verdicts_go_on_from_a_history(spark, tmp_path):
    rows = run_table(5)
    whole = health.assess_runs(spark.createDataFrame(rows, RUNS))
    recent = health.recent_counts(whole.where("run < 9")).cache()
    got = run_stream(spark, tmp_path, RUNS, [[r for r in rows if r[1] in (9, 10)], [r for r in rows if r[1] > 10]], lambda df: S.stream_verdicts(df, recent))
    assert sorted((r[:6] for r in got), key=str) == sorted(map(tuple, whole.where("run >= 9").collect()), key=str)


def test_jobs_without_a_sign_are_interrupted(spark, tmp_path):
    at = lambda m: START + dt.timedelta(minutes=m)
    first = [(1, "running", at(0)), (2, "running", at(0)), (3, "queued", at(0)), (4, "running", at(0)), (5, "cancel_requested", at(1)), (9, "queued", at(2))]
    later = [[(2, None, at(10)), (4, "succeeded", at(11))], [(9, None, at(22))], [(9, None, at(60))]]
    got = run_stream(spark, tmp_path, SIGNS, [first, *later], S.stream_interruptions)
    assert sorted((r[0], r[1]) for r in got) == [(1, "interrupted"), (2, "interrupted"), (5, "interrupted")]
    assert {r[0]: r[2] for r in got} == {1: at(15), 2: at(25), 5: at(16)}
    log = spark.createDataFrame([(1, "running", at(0)), (2, "running", at(10)), (3, "queued", None), (4, "succeeded", None), (5, "cancel_requested", at(1)), (9, "queued", None)], "id long, status string, heartbeat_at timestamp")
    log = log.withColumns({"started_at": F.lit(None).cast("timestamp"), "created_at": F.lit(at(0))})
    assert sorted(r.id for r in jobs.stale(log, F.lit(at(60))).collect()) == [1, 2, 5]


def run_by_clock(spark, folder, schema, batches, transform):
    """Results of a stream whose time is the clock; such a stream has no end, so it is stopped when each batch has given its rows."""
    out, rows = [], str(folder / "in")
    spark.createDataFrame([], schema).write.parquet(rows)
    stream = transform(spark.readStream.schema(schema).parquet(rows)).writeStream.option("checkpointLocation", str(folder / "ck"))
    query = stream.foreachBatch(lambda df, _: out.extend(tuple(r) for r in df.collect())).trigger(processingTime="200 milliseconds").start()
    try:
        for batch, wanted in batches:
            wanted += len(out)
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(rows)
            for _ in range(600):
                if len(out) >= wanted:
                    break
                time.sleep(0.1)
    finally:
        query.stop()
    return out


def test_jobs_are_interrupted_by_the_clock_without_rows(spark, tmp_path):
    signs = [([(1, "running", START), (2, "queued", START)], 1)]
    got = run_by_clock(spark, tmp_path, SIGNS, signs, lambda df: S.stream_interruptions(df, minutes=0.02, delay=None))
    assert [r[:2] for r in got] == [(1, "interrupted")]


def test_details_are_fresh_until_they_expire(spark, tmp_path):
    schema = "listing string, url string, summary string, at timestamp"
    row = lambda k, summary: (f"l{k}", f"u{k}", summary, START)
    hour = [[row(1, '{"a":1,"b":2}'), row(2, "{}")], [row(1, '{"b": 2, "a": 1}'), row(2, '{"x":1}'), row(3, None)], [row(2, '{"x":1}'), row(3, None)]]
    (tmp_path / "hour").mkdir(), (tmp_path / "short").mkdir()
    got = run_by_clock(spark, tmp_path / "hour", schema, [(b, len(b)) for b in hour], lambda df: S.stream_freshness(df, 1, 2))
    told = [[(r[0], r[3]) for r in sorted(got[low:high])] for low, high in ((0, 2), (2, 5), (5, 7))]
    assert told == [[("l1", False), ("l2", False)], [("l1", True), ("l2", False), ("l3", False)], [("l2", True), ("l3", False)]]
    got = run_by_clock(spark, tmp_path / "short", schema, [([row(1, "{}")], 1)] * 2, lambda df: S.stream_freshness(df, 0.001 / 3600, 2))
    assert [r[3] for r in got] == [False, False]  # fetched longer ago than that


def test_earlier_versions_are_read_as_the_newest(spark, tmp_path):
    uri, first = str(tmp_path / "t"), "id int, name string, n int, old string"
    steps = [[Add("kind", "string", "concat('k', n)"), Widen("n", "bigint")], [Rename("name", "title"), Drop("old")]]
    v1 = Versioned(spark, uri, first)
    v1.append(spark.createDataFrame([(1, "a", 5, "x")], first))
    v2 = Versioned(spark, uri, first, steps[:1])
    assert v2.rows().columns == ["id", "name", "n", "old"] and v2.migrate() == 1 and v2.migrate() == 0
    v2.append(spark.createDataFrame([(2, "b", 2**40, "y", "own")], "id int, name string, n long, old string, kind string"))
    assert sorted(map(tuple, v2.rows().collect())) == [(1, "a", 5, "x", "k5"), (2, "b", 2**40, "y", "own")]
    with pytest.raises(ValueError, match="version 2; version 1 is the last"):
        Versioned(spark, uri, first)
    v3 = Versioned(spark, uri, first, steps)
    assert v3.migrate() == 1 and v3.rows().dtypes == [("id", "int"), ("title", "string"), ("n", "bigint"), ("kind", "string")]
    wanted = [(1, "a", 5, "k5"), (2, "b", 2**40, "own")]
    assert sorted(map(tuple, v3.rows().collect())) == wanted and v3.rewrite() == 2 and v3.rewrite() == 0
    assert sorted(map(tuple, v3.rows().collect())) == wanted and len(v3.last()[1]["parts"]) == 1 and len(v3.sweep()) == 2
    with pytest.raises(ValueError, match="cannot become"):
        Versioned(spark, uri, first, [[Widen("n", "tinyint")]])
