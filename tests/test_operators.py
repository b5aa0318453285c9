"""Health, archive, retention, reconciliation, jobs and freshness on small tables."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.operators import archive, freshness, health, jobs, reconcile

NOW = dt.datetime(2025, 6, 1, 12)
now = lambda: F.lit(NOW).cast("timestamp_ntz")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_assess_runs_equals_a_loop(spark):
    rng = random.Random(3)
    runs = [(s, r, rng.choice((0, 3, 5, 8, 9, 10, 20, None)), 1 if s % 2 else None, 15 if s % 3 else None) for s in range(12) for r in range(25)]
    wanted = []
    for s in range(12):
        recent = []
        for _, r, n, low, high in (x for x in runs if x[0] == s):
            counts = [c for c in recent if c is not None]  # the last five first, then those with a count
            median = statistics.median(counts) if counts else None
            healthy = n is None or (n >= (low or 0) and not (high is not None and n > high) and not (median is not None and median >= 4 and n < 0.5 * median))
            wanted.append((str(s), r, n, median, healthy))
            if healthy:
                recent = [n, *recent][:5]
    table = spark.createDataFrame([(str(s), *x) for s, *x in runs], "source_id string, run long, n long, expected_min int, expected_max int")
    assert sorted(rows(health.assess_runs(table).drop("problems"), "run")) == sorted(wanted)
    one = health.assess_runs(spark.createDataFrame([("a", 1, 10, 0, 9), ("a", 2, 1, 2, 9)], table.schema))
    assert [r["problems"] for r in one.orderBy("run").collect()] == ["count 10 above expected maximum 9", "count 1 below expected minimum 2"]
    assert health.assess_runs(table.limit(0)).count() == 0
    early = health.assess_runs(table.where("run < 9"))  # judged in two parts, the second going on from the first
    late = health.assess_runs(table.where("run >= 9"), health.recent_counts(early))
    assert sorted(rows(early.unionByName(late).drop("problems"), "run")) == sorted(wanted)
    drop = spark.createDataFrame([("a", 1, 10, None, None), ("a", 2, 13, None, None), ("a", 3, 2, None, None)], table.schema)
    assert [r["problems"] for r in health.assess_runs(drop).orderBy("run").collect()] == [None, None, "sudden drop: 2 vs recent median 11.5"]


def test_run_reports_tell_nine_fields(spark):
    at = dt.datetime(2025, 1, 2, 3, 4, 5)
    runs = spark.createDataFrame([("a", r, 7, "ok", True, None, 10 + r, None, at, None, "v1") for r in range(3)], "source_id string, run long, job_id long, status string, healthy boolean, health_notes string, listings_found int, error string, started_at timestamp_ntz, finished_at timestamp_ntz, parser_version string")
    got = health.run_reports(runs, "a", 2)
    assert got.columns == list(health.RUN_FIELDS) and [tuple(r) for r in got.collect()][0] == (2, 7, "ok", True, None, 12, None, "2025-01-02T03:04:05Z", None)


def test_equal_requests_get_one_new_id(spark):
    log = spark.createDataFrame([(5, "scrape", "a", '{"x": 1}', "queued"), (9, "scrape", "b", "{}", "failed")], "id long, kind string, source_id string, params string, status string")
    asked = [(1, "scrape", "b", None), (2, "scrape", "a", '{"x":1}'), (3, "scrape", "b", "{}"), (4, "scrape", None, "{}"), (5, "scrape", None, "{ }"), (6, "scrape", "a", '{"x":2}')]
    requests = spark.createDataFrame(asked, "request_id long, kind string, source_id string, params string")
    got = jobs.enqueue_ids(requests, log, ["scrape"])
    assert rows(got.select("request_id", "job_id", "created"), "request_id") == [(1, 10, True), (2, 5, False), (3, 10, True), (4, 11, True), (5, 11, True), (6, 12, True)]
    assert got.columns == [*requests.columns, "job_id", "created"]
    assert rows(jobs.enqueue_ids(requests.where("request_id = 4"), log.limit(0)).select("job_id", "created"), "job_id") == [(1, True)]
    assert jobs.enqueue_ids(requests.limit(0), log).count() == 0


def test_failures_since_the_last_completed_run(spark):
    runs = [("a", 1, "failed"), ("a", 2, "ok"), ("a", 3, "failed"), ("a", 4, "failed"), ("b", 1, "failed"), ("c", 1, "failed"), ("c", 2, "unhealthy")]
    got = health.consecutive_failures(spark.createDataFrame(runs, "source_id string, run long, status string"))
    assert rows(got, "source_id") == [("a", 2), ("b", 1), ("c", 0)]


SOURCES = """source_id string, enabled boolean, disabled_reason string, last_run_at timestamp_ntz, last_status string, last_error string,
    last_success_at timestamp_ntz, interval_minutes int, consecutive_failures int"""


def test_source_state_reasons_and_schedule(spark):
    old, fresh = NOW - dt.timedelta(days=2), NOW - dt.timedelta(minutes=30)
    table = spark.createDataFrame(
        [
            ("disabled", False, None, old, "ok", None, old, 60, 0),
            ("never", True, None, None, None, None, None, 60, 0),
            ("failing", True, None, old, "failed", "boom", old, 60, 2),
            ("degraded", True, None, fresh, "unhealthy", None, fresh, 60, 0),
            ("ok", True, None, fresh, "ok", None, fresh, 60, 0),
            ("stale", True, None, old, "ok", None, old, 60, 0),
            ("first", True, None, fresh, None, None, None, 60, 0),
        ],
        SOURCES,
    )
    got = {r["source_id"]: r for r in health.source_health(table, now()).collect()}
    assert {k: r["state"] for k, r in got.items()} == {"disabled": "disabled", "never": "never_run", "failing": "failing", "degraded": "degraded", "ok": "ok", "stale": "stale", "first": "stale"}
    assert got["disabled"]["reasons"] == ["kill switch off"]
    assert got["failing"]["reasons"] == ["boom", "no successful run since 2025-05-30T12:00:00Z"]
    assert got["first"]["reasons"] == ["no successful run since ever"]
    assert got["never"]["next_due_at"] == NOW and got["disabled"]["next_due_at"] is None
    assert got["failing"]["next_due_at"] == old + dt.timedelta(minutes=240)
    assert rows(health.due_sources(table, now()), "source_id") == [("failing",), ("never",), ("stale",)]


def test_overall_health(spark):
    states = spark.createDataFrame([("a", "ok"), ("b", "stale")], "source_id string, state string")
    log = spark.createDataFrame([(1, "failed"), (2, "succeeded"), (3, "queued")], "id long, status string")
    assert tuple(health.overall(states, log, log).first()) == (False, ["b"], 1, 1)
    assert tuple(health.overall(states.where("state = 'ok'"), log.where("id <= 2"), log.limit(0)).first()) == (True, [], 0, 0)
    assert tuple(health.overall(states.where("state = 'ok'"), log.where("id = 1"), log).first())[0] is False


def test_blobs_are_stored_once(spark):
    fetches = spark.createDataFrame([(1, bytearray(b"x"), "a"), (2, bytearray(b"x"), "b"), (3, None, "c"), (4, bytearray(b""), "d")], "fetch_id long, body binary, content_type string")
    blobs = archive.new_blobs(fetches)
    assert sorted((r["size"], r["content_type"]) for r in blobs.collect()) == [(0, "d"), (1, "a")]
    assert archive.new_blobs(fetches, blobs).count() == 0
    log = archive.fetch_log(fetches)
    assert [r["sha256"] is None for r in log.orderBy("fetch_id").collect()] == [False, False, True, False]
    assert archive.load_blobs(blobs, log.where("fetch_id = 2")).first()["body"] == b"x"


def test_retention_equals_a_loop(spark):
    rng = random.Random(5)
    items = sorted({(NOW - dt.timedelta(minutes=rng.randrange(60 * 24 * 120)), f"n{k}") for k in range(150)}, reverse=True)
    days, weeks, keep = [], [], set()
    for ts, name in items:
        for seen, unit, most in ((days, ts.date(), 14), (weeks, ts.isocalendar()[:2], 8)):
            if unit not in seen and len(seen) < most:
                seen.append(unit)
                keep.add(name)
    got = archive.retention(spark.createDataFrame(items, "ts timestamp_ntz, name string"))
    assert {r["name"] for r in got.where("keep").collect()} == keep and got.count() == len(items)


def test_reconcile(spark):
    schema = "id string, v string"
    defined, stored = spark.createDataFrame([("a", "1"), ("b", None), ("c", "3")], schema), spark.createDataFrame([("b", None), ("c", "x"), ("d", "4")], schema)
    assert rows(reconcile.config_diff(defined, stored, "id", ["v"]), "id") == [("a", "created"), ("b", "unchanged"), ("c", "updated"), ("d", "orphaned")]
    assert rows(reconcile.synced(defined, stored, "id", ["v"]), "id") == [("a", "1"), ("b", None), ("c", "3"), ("d", "4")]
    settings = spark.createDataFrame([("x", "1", 1), ("x", "2", 2), ("unknown", "3", 1)], "key string, value string, changed int")
    merged = reconcile.overlay(spark.createDataFrame([("x", "0"), ("y", "0")], "key string, value string"), reconcile.last_settings(settings))
    assert rows(merged, "key") == [("x", "2"), ("y", "0")]


@pytest.mark.parametrize(("key", "given", "wanted"), [("near_miss_days", "7", 7), ("target_move_in", "2027-01-02", "2027-01-02")])
def test_settings_are_validated(key, given, wanted):
    assert reconcile.validate_setting(key, given) == wanted


@pytest.mark.parametrize(("key", "given", "error"), [("no", 1, KeyError), ("near_miss_days", -1, ValueError), ("target_move_in", "soon", ValueError), ("gone_after_misses", "x", ValueError)])
def test_bad_settings_are_refused(key, given, error):
    with pytest.raises(error):
        reconcile.validate_setting(key, given)


def test_kill_switch(spark):
    table = spark.createDataFrame([("a", True, None), ("b", False, "old")], "source_id string, enabled boolean, disabled_reason string")
    assert rows(reconcile.set_enabled(table, "a", False), "source_id")[0] == ("a", False, "disabled manually")
    assert rows(reconcile.set_enabled(table, "b", True), "source_id")[1] == ("b", True, None)


JOB = """id long, kind string, source_id string, params string, status string, done long, total long, created_at timestamp_ntz,
    started_at timestamp_ntz, finished_at timestamp_ntz, heartbeat_at timestamp_ntz"""


def job(id, kind="scrape", source_id=None, params="{}", status="queued", done=0, total=None, created_at=NOW, started_at=None, finished_at=None, heartbeat_at=None):
    return id, kind, source_id, params, status, done, total, created_at, started_at, finished_at, heartbeat_at


def test_equal_active_jobs_are_reused(spark):
    log = spark.createDataFrame([job(1, params='{"a": 1, "b": 2}'), job(2, params='{"b":2,"a":1}'), job(3, source_id="s", status="failed"), job(4, kind="backup", params=None)], JOB)
    asked = spark.createDataFrame(
        [(1, "scrape", None, '{"b": 2, "a": 1}'), (2, "scrape", "s", "{}"), (3, "backup", None, "{}"), (4, "scrape", "s", None)],
        "request_id long, kind string, source_id string, params string",
    )
    assert [(r["request_id"], r["job_id"]) for r in jobs.enqueue(asked, log).orderBy("request_id").collect()] == [(1, 1), (2, None), (3, 4), (4, None)]
    assert [r["request_id"] for r in jobs.new_jobs(asked, log).collect()] == [2]


def test_job_transitions(spark):
    hour = dt.timedelta(hours=1)
    log = spark.createDataFrame(
        [
            job(1),
            job(2, status="running", done=2, total=10, started_at=NOW - dt.timedelta(seconds=4), heartbeat_at=NOW),
            job(3, status="running", started_at=NOW - hour),
            job(4, status="succeeded", done=1, total=9, started_at=NOW - hour, finished_at=NOW),
        ],
        JOB,
    )
    assert [r["status"] for r in jobs.cancel(log, [1, 2, 4], now()).orderBy("id").collect()] == ["cancelled", "cancel_requested", "running", "succeeded"]
    requests = log.select("id").where("id IN (1, 2, 4)").union(log.selectExpr("id + 1000")).union(log.select("id").where("id = 1"))
    assert jobs.cancel(log, requests, now()).columns == log.columns
    assert [r["status"] for r in jobs.cancel(log, requests, now()).orderBy("id").collect()] == ["cancelled", "cancel_requested", "running", "succeeded"]
    assert [r["id"] for r in jobs.stale(log, now()).collect()] == [3]
    assert [r["status"] for r in jobs.interrupt_stale(log, now()).orderBy("id").collect()] == ["queued", "running", "interrupted", "succeeded"]
    timed = jobs.progress(log, now()).orderBy("id").collect()
    assert [(r["percent"], r["elapsed_seconds"], r["eta_seconds"]) for r in timed] == [(None, None, None), (20.0, 4.0, 16.0), (None, 3600.0, None), (100.0, 3600.0, None)]
    page = jobs.recent(log, 3)
    assert [r["id"] for r in page.collect()] == [4, 3, 2] and [r["id"] for r in jobs.active_of(page).collect()] == [3, 2]
    assert [r["id"] for r in jobs.recent(log, 9, ["queued"], "scrape").collect()] == [1]
    assert jobs.next_queued(log).first()["id"] == 1
    assert len(jobs.log_rows(spark.createDataFrame([("x" * 5000,)], "message string")).first()["message"]) == 4000


@pytest.mark.parametrize(
    ("log", "due"),
    [
        ([], True),
        ([job(1, "backup", status="failed")], True),
        ([job(1, "backup", status="queued")], False),
        ([job(1, "backup", status="succeeded", finished_at=NOW - dt.timedelta(hours=23))], False),
        ([job(1, "backup", status="succeeded", finished_at=NOW - dt.timedelta(hours=24))], True),
        ([job(1, "backup", status="succeeded", finished_at=NOW - dt.timedelta(hours=30)), job(2, "backup", status="failed")], True),
    ],
)
def test_backup_due(spark, log, due):
    assert jobs.backup_due(spark.createDataFrame(log, JOB), now()).first()["due"] is due


def test_last_events(spark):
    events = spark.createDataFrame([("a", n) for n in range(4)] + [("b", 1)], "job string, id int")
    assert sorted((r["job"], r["id"], r["nth"]) for r in jobs.last_events(events, 2, "job", ["id"]).collect()) == [("a", 2, 2), ("a", 3, 1), ("b", 1, 1)]


def test_detail_freshness(spark):
    records = spark.createDataFrame([(k, f"u{k}", '{"a":1,"b":2}') for k in "abcd"], "listing string, url string, summary string")
    previous = spark.createDataFrame([("a", '{"b": 2, "a": 1}'), ("b", '{"a":1}'), ("c", '{"a":1,"b":2}')], "listing string, summary string")
    at = lambda h: NOW - dt.timedelta(hours=h)
    fetches = spark.createDataFrame([(1, "ua", 200, at(23)), (2, "ub", 200, at(1)), (3, "uc", 200, at(24)), (4, "uc", 500, at(1)), (5, "ud", 200, at(1))], "id long, url string, http_status int, fetched_at timestamp_ntz")
    got = freshness.detail_freshness(records, previous, fetches, now())
    assert [(r["listing"], r["fresh"]) for r in got.orderBy("listing").collect()] == [("a", True), ("b", False), ("c", False), ("d", False)]
