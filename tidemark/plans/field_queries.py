"""More registered queries, each beside its DuckDB counterpart: fields of records, sources, settings and job reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import collections as C
from tidemark.functions import dates as D
from tidemark.functions import numbers as M
from tidemark.functions import text as T
from tidemark.operators import archive, health, jobs, lifecycle, reconcile
from tidemark.plans.queries import _HISTORY_SQL, _JOBS_SQL, _RUNS_SQL, _SOURCES_SQL, _VERDICTS_SQL, _history, _jobs, _runs, _sources, _verdicts, now, query, table
from tidemark.sources import embedded_state, json_api, json_files

# Functions of records


@query("""
    SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size END::DOUBLE AS beds, p_size + 0.5::DOUBLE AS baths, CASE p_size % 3 WHEN 0 THEN 'pending' ELSE 'available' END AS status,
        CASE WHEN p_size % 2 = 0 THEN 'https://h.org/img/' || p_partkey ELSE 'https://x.org/' || p_partkey END AS image,
        'https://h.org/d?name=' || replace(p_name, ' ', '+') || '&type=&n=' || p_partkey AS url,
        CASE WHEN contains(p_name || ' ' || p_type, p_type) AND p_size % 2 = 0 THEN p_name || ' ' || p_type ELSE p_name || chr(10) || chr(10) || p_type END AS description,
        nullif(concat_ws('; ', CASE WHEN p_size % 3 = 0 THEN 'cats ok' WHEN p_size % 3 = 1 THEN 'no cats' END), '') AS pets FROM part""")
def listing_fields(spark, sf_dir):
    part, base = table(spark, sf_dir, "part"), F.lit("https://h.org//")
    beds = F.expr("if(p_size % 5 = 0, 'Studio, 1 bath', concat(p_size, ' bed'))")
    said = F.expr("CASE p_size % 3 WHEN 0 THEN 'Pending' WHEN 1 THEN 'x' END")
    image = F.expr("if(p_size % 2 = 0, concat('/img/', p_partkey), concat('https://x.org/', p_partkey))")
    url = T.with_query(F.concat(T.base_url(base), F.lit("/d")), [("name", "p_name"), ("type", F.lit(None).cast("string")), ("n", F.col("p_partkey").cast("string"))])
    text = F.expr("if(p_size % 2 = 0, concat(p_name, ' ', p_type), p_name)")
    cats = F.expr("CASE p_size % 3 WHEN 0 THEN 'yes' WHEN 1 THEN '0' END")
    pets = F.nullif(F.concat_ws("; ", F.when(cats.isNotNull(), F.when(T.truthy(cats), "cats ok").otherwise("no cats"))), F.lit(""))
    return part.select(
        "p_partkey", T.bedrooms(beds).alias("beds"), T.first_number(F.concat(F.lit("about "), "p_size", F.lit(".5 baths"))).alias("baths"), T.wanted_status(said).alias("status"),
        T.absolute_url(image, base).alias("image"), url.alias("url"), T.append_unless_within(text, "p_type").alias("description"), pets.alias("pets"),
    )


@query("""
    SELECT event_id, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) <> 0 THEN json_extract_string(props, '$.k') END AS k,
        CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) <> 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS number FROM events""")
def variant_fields(spark, sf_dir):
    value = F.try_variant_get(F.parse_json("props"), "$.k", "variant")
    return table(spark, sf_dir, "events").select("event_id", T.clean_variant(value).alias("k"), M.variant_number(value).alias("number"))


@query("""
    SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name || '|' || c_mktsegment END AS strings, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE 2 END::BIGINT AS n,
        CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name || '|' || c_mktsegment END AS last_two FROM customer""")
def arrays(spark, sf_dir):
    strings = C.json_strings(F.expr("if(c_custkey % 7 = 0, 'oops', concat('[\"', c_name, '\", 5, null, \"', c_mktsegment, '\"]'))"))
    items = C.filled_items(F.expr("array(if(c_custkey % 3 = 0, null, c_name), '', c_mktsegment)"))
    last = C.last_items(F.concat(F.when(F.col("c_custkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("dropped"))), items), 2)
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("|", strings).alias("strings"), F.size(strings).cast("long").alias("n"), F.concat_ws("|", last).alias("last_two"))


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') END AS advertised, round_even(o_totalprice * 1e5 / 1e9, 1) AS gigabytes,
        CASE WHEN o_orderkey % 4 <> 0 THEN date_trunc('second', o_orderdate) END AS stamp FROM orders""")
def stamps_and_sizes(spark, sf_dir):
    seconds = F.expr("if(o_orderkey % 9 = 0, 0L, unix_micros(cast(o_orderdate AS timestamp)) div 1000000)")
    name = F.concat(F.expr("if(o_orderkey % 4 = 0, 'other', 'db')"), F.lit("-"), F.date_format("o_orderdate", "yyyyMMdd-HHmmss"), F.lit(".sqlite.gz"))
    return table(spark, sf_dir, "orders").select("o_orderkey", D.epoch_iso(seconds).alias("advertised"), M.gigabytes(F.col("o_totalprice") * 1e5).alias("gigabytes"), T.backup_stamp(name, "db").alias("stamp"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'SHORT' ELSE left(text, 4000) END AS message FROM documents")
def job_messages(spark, sf_dir):
    message = F.expr("if(doc_id % 5 = 0, 'SHORT', text)")
    return jobs.log_rows(table(spark, sf_dir, "documents").select("doc_id", message.alias("message")))


# Sources


@query("""
    SELECT 'c' || c_custkey AS external_id, 'https://h.org/' || c_custkey AS url, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS title, CAST(c_nationkey AS INT) AS rent,
        c_mktsegment AS status, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END::BIGINT AS photos, c_custkey % 50 AS seq, c_custkey // 50 AS raw_fetch_id FROM customer""")
def file_listings(spark, sf_dir):
    fields = """named_struct('external_id', concat('c', c_custkey), 'url', concat('https://h.org/', c_custkey), 'title', if(c_custkey % 4 = 0, null, c_name), 'rent', c_nationkey,
        'status', c_mktsegment, 'photos', if(c_custkey % 2 = 0, array('a', 'b'), null))"""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", F.expr(fields).alias("r")))), lambda x: x["r"])
    files = table(spark, sf_dir, "customer").groupBy(F.expr("c_custkey div 50").alias("fetch_id")).agg(F.to_json(ordered).cast("binary").alias("body"))
    records = json_files.file_records(files)
    return records.select("external_id", "url", "title", "rent", F.get_json_object("extra", "$.status").alias("status"), F.size("photos").cast("long").alias("photos"), "seq", "raw_fetch_id")


@query("""
    SELECT 'c' || c_custkey AS external_id, 'https://h.org/_system/listings/c' || c_custkey || '/x' AS url, CAST(c_nationkey AS INT) + 1 AS rent, c_name || ', ' || c_mktsegment AS address_raw,
        CASE WHEN c_custkey % 3 = 0 THEN '4B' END AS unit_raw, CASE WHEN c_custkey % 2 = 0 THEN 'water, gas' ELSE 'none included' END AS utilities,
        CASE WHEN c_custkey % 5 = 0 THEN 'no cats; dogs ok' ELSE 'dogs ok' END AS pets, DATE '2026-10-01' AS avail_structured_date, 'one' || chr(10) || 'two' AS description,
        CASE WHEN c_custkey % 2 = 0 THEN 'https://h.org/img/' || c_custkey || '|https://x.org/' || c_custkey ELSE '' END AS photos
    FROM customer WHERE c_custkey % 11 <> 0""")
def api_listings(spark, sf_dir):
    fields = """named_struct('listingID', concat('c', c_custkey), 'url', 'x', 'isActive', if(c_custkey % 11 = 0, '0', '1'), 'rent', concat(c_nationkey + 1, '.00'),
        'address', if(c_custkey % 3 = 0, concat(c_name, ' - 4B'), c_name), 'city', c_mktsegment, 'isWaterIncluded', if(c_custkey % 2 = 0, '1', '0'), 'isGasIncluded', if(c_custkey % 2 = 0, 'true', null),
        'noUtilitiesIncluded', '1', 'acceptCats', if(c_custkey % 5 = 0, '0', null), 'acceptDogs', '1', 'dateAvailable', '2026-10-01', 'description', 'one<br/>two')"""
    made = F.to_json(F.struct(F.collect_list(F.expr(fields)).alias("listings")))
    pages = table(spark, sf_dir, "customer").groupBy(F.expr("c_custkey div 50").alias("page")).agg(made.cast("binary").alias("body")).withColumn("fetch_id", F.col("page"))
    images = "named_struct('images', array(named_struct('url', concat('/img/', c_custkey)), named_struct('url', ''), named_struct('url', concat('https://x.org/', c_custkey))))"
    details = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.expr("concat('c', c_custkey)").alias("listing"), F.to_json(F.expr(images)).cast("binary").alias("body"))
    records = json_api.normalize(json_api.api_records(pages), json_api.detail_photos(details, "https://h.org/"), "https://h.org/", "api")
    return records.select("external_id", "url", "rent", "address_raw", "unit_raw", "utilities", "pets", "avail_structured_date", "description", F.concat_ws("|", "photos").alias("photos"))


@query("""
    SELECT 'c' || c_custkey AS external_id, c_name || ' & "co"' AS title, CAST(c_nationkey AS INT) * 100 AS rent, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_nationkey END::DOUBLE AS beds,
        DATE '2025-06-01' AS avail_structured_date, c_mktsegment || ' St, Town, VT 05401' AS address_raw, 'Heat|Lift' AS amenities,
        CASE WHEN c_custkey % 3 = 0 THEN 'https://h.org/t?a=1&k=' || c_custkey || '|https://v.org/' || c_custkey ELSE '' END AS photos FROM customer""")
def embedded_listings(spark, sf_dir):
    pair = lambda k, v: F.struct(F.lit(k).alias("Key"), v.alias("Value"))
    record = F.array(
        pair("listingid", F.expr("concat('c', c_custkey)")), pair("buildingname", F.concat("c_name", F.lit(' & "co"'))), pair("listingrent", F.expr("concat('$', format_number(c_nationkey * 100, 2))")),
        pair("bedtypedesc", F.expr("if(c_custkey % 5 = 0, 'Studio', concat(c_nationkey, ' Bed'))")), pair("availabilitydate", F.lit("Sunday, June 1, 2025")),
        pair("line1", F.concat("c_mktsegment", F.lit(" St"))), pair("city", F.lit("Town")), pair("state", F.lit("VT")), pair("postalcode", F.lit("05401")), pair("imageUrl", F.lit("volatile")),
    )

    def page(model):
        escaped = F.to_json(F.struct(model.alias("viewModel")))
        for plain, entity in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), ("'", "&#39;")):
            escaped = F.replace(escaped, F.lit(plain), F.lit(entity))
        return F.concat(F.lit(f'<html><input type="hidden" value="no"><input value="'), escaped, F.lit(f'" id="{embedded_state.STATE_ID}" type="hidden"></html>')).cast("binary")

    customer = table(spark, sf_dir, "customer")
    listings = customer.groupBy(F.expr("c_custkey div 50").alias("fetch_id")).agg(page(F.struct(F.struct(F.collect_list(record).alias("Listings")).alias("ContentViewModel"))).alias("body"))
    details = customer.select(F.expr("concat('c', c_custkey)").alias("listing"), page(F.struct(F.array(pair("rentalFeaturesList", F.lit("<ul><li>Heat</li><li> <b>Lift</b></li><li></li></ul>"))).alias("HtmlContainer"))).alias("body"))
    image = lambda video, url, thumb: F.struct(F.lit(video).alias("IsVideo"), url.alias("VideoUrl"), thumb.alias("LargeThumbUrl"))
    images = F.array(image(False, F.lit("no"), F.expr("concat('https://h.org/t?a=1&k=', c_custkey)")), image(True, F.expr("concat('https://v.org/', c_custkey)"), F.lit("no")), image(False, F.lit("no"), F.lit("")))
    photos = embedded_state.image_urls(customer.where("c_custkey % 3 = 0").select(F.expr("concat('c', c_custkey)").alias("listing"), page(F.struct(images.alias("Images"))).alias("body")))
    records = embedded_state.search_records(listings.withColumn("url", F.lit("https://h.org/search")))
    got = embedded_state.normalize(records, embedded_state.detail_fields(details), photos, "https://h.org/", "pages")
    return got.select("external_id", "title", "rent", "beds", "avail_structured_date", "address_raw", F.concat_ws("|", "amenities").alias("amenities"), F.concat_ws("|", "photos").alias("photos"))


@query("""
    SELECT c_custkey, c_name || ' caf' || chr(233) || ' ' || chr(8217) || c_mktsegment || chr(8230) || ' ' || chr(8212) || ' &lt; ' || chr(163) || c_nationkey || ' & Co' AS text FROM customer""")
def html_entities(spark, sf_dir):
    html = F.concat(F.lit("<p>"), "c_name", F.lit(" caf&eacute; &#8217;"), "c_mktsegment", F.lit("&hellip; &#x2014; &amp;lt; &pound;"), "c_nationkey", F.lit(" &amp; Co</p>"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.html_to_text(html).alias("text"))


@query("""
    WITH stored AS (SELECT DISTINCT sha256(text) AS sha256 FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL)
    SELECT sha256(text) AS sha256, octet_length(encode(first(text)))::BIGINT AS size FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256 FROM stored) GROUP BY 1""")
def blobs_not_stored(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("fetch_id"), F.col("text").cast("binary").alias("body"), F.lit("text").alias("content_type"))
    return archive.new_blobs(docs, archive.fetch_log(docs.where("fetch_id % 2 = 0")).select("sha256")).select("sha256", "size")


# Settings and sources as stored


@query("""
    SELECT 'k' || c_nationkey AS key, c_name AS value, TRY_CAST(right(c_name, 9) AS INT) AS number FROM customer
    QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) = 1""")
def last_setting_values(spark, sf_dir):
    changes = table(spark, sf_dir, "customer").select(F.expr("concat('k', c_nationkey)").alias("key"), F.col("c_name").alias("value"), F.col("c_custkey").alias("changed"))
    return reconcile.last_settings(changes).select("key", "value", F.right("value", F.lit(9)).try_cast("int").alias("number"))


@query("SELECT 'k7' AS key, CAST(right(c_name, 9) AS INT) AS value FROM customer WHERE c_nationkey = 7 QUALIFY row_number() OVER (ORDER BY c_custkey DESC) = 1")
def one_setting(spark, sf_dir):
    changes = table(spark, sf_dir, "customer").select(F.expr("concat('k', c_nationkey)").alias("key"), F.expr("right(c_name, 9)").alias("value"), F.col("c_custkey").alias("changed"))
    return reconcile.typed_setting(reconcile.last_settings(changes), "k7", "int")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 5 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment, c_name FROM customer")
def config_sync(spark, sf_dir):
    stored = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name")
    defined = stored.where("c_custkey % 3 <> 0").withColumn("c_mktsegment", F.expr("if(c_custkey % 5 = 0, 'CHANGED', c_mktsegment)"))
    return reconcile.synced(defined, stored, "c_custkey", ["c_mktsegment", "c_name"])


@query("""
    SELECT 's' || s_suppkey AS source_id, s_suppkey <> 7 AND s_acctbal > 0 AS enabled,
        CASE WHEN s_suppkey = 7 THEN 'disabled manually' WHEN s_acctbal <= 0 THEN 'debt' END AS disabled_reason FROM supplier ORDER BY s_suppkey""")
def kill_switch(spark, sf_dir):
    sources = table(spark, sf_dir, "supplier").selectExpr("concat('s', s_suppkey) AS source_id", "s_acctbal > 0 AS enabled", "if(s_acctbal > 0, null, 'debt') AS disabled_reason")
    return reconcile.set_enabled(sources, "s7", False)


# Runs and jobs


@query(f"WITH {_RUNS_SQL} SELECT source_id, run, listings, sightings FROM runs WHERE source_id = 'view' ORDER BY run DESC LIMIT 50")
def runs_of_source(spark, sf_dir):
    return health.source_runs(_runs(spark, sf_dir), "view", 50)


@query(_VERDICTS_SQL + """ SELECT run, run % 1000 AS job_id, 'ok' AS status, healthy, CASE WHEN NOT healthy THEN concat_ws('; ', CASE WHEN n < 2 THEN 'count ' || n || ' below expected minimum 2' END,
        CASE WHEN n > 40 THEN 'count ' || n || ' above expected maximum 40' END, CASE WHEN recent_median >= 4 AND n < 0.5 * recent_median THEN 'sudden drop: ' || n || ' vs recent median ' || format('{:g}', recent_median) END) END AS health_notes,
        n AS listings_found, NULL::VARCHAR AS error, strftime(make_timestamp(run * 10800000000), '%Y-%m-%dT%H:%M:%SZ') AS started_at, strftime(make_timestamp(run * 10800000000 + 90000000), '%Y-%m-%dT%H:%M:%SZ') AS finished_at
    FROM fold WHERE source_id = 'view' ORDER BY run DESC LIMIT 50""")
def run_reports(spark, sf_dir):
    judged = _verdicts(spark, sf_dir).withColumns({"job_id": F.col("run") % 1000, "status": F.lit("ok"), "error": F.lit(None).cast("string"), "health_notes": F.col("problems"), "listings_found": F.col("n")})
    started = F.timestamp_micros(F.col("run") * 10_800_000_000).cast("timestamp_ntz")
    return health.run_reports(judged.withColumns({"started_at": started, "finished_at": started + F.expr("interval 90 seconds")}), "view", 50)


@query(_HISTORY_SQL + """,
    changes AS (SELECT run, event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 AS changed FROM e WHERE event_type IN ('view', 'error') WINDOW w AS (PARTITION BY user_id ORDER BY run, event_id)),
    made AS (SELECT run, count(*) FILTER (WHERE changed) AS n FROM changes GROUP BY run),
    moved AS (SELECT run, count(*) FILTER (WHERE NOT seen) AS missed, count(*) FILTER (WHERE NOT seen AND status = 'gone') AS gone FROM h GROUP BY run)
    SELECT run, coalesce(made.n, 0) AS snapshots_created, coalesce(missed, 0) AS missed, coalesce(gone, 0) AS gone FROM (SELECT DISTINCT run FROM e) LEFT JOIN made USING (run) LEFT JOIN moved USING (run)""")
def run_summary(spark, sf_dir):
    run = F.date_diff(F.to_date("ts"), F.lit("2020-01-01").cast("date")).cast("long")
    events = table(spark, sf_dir, "events").select(F.lit("all").alias("source_id"), "user_id", run.alias("run"), "event_id", "event_type")
    snapshots = lifecycle.snapshots_on_change(events.where("event_type IN ('view', 'error')"), ["user_id"], ["run", "event_id"], "event_type")
    return health.run_summary(events.select("source_id", "run").distinct(), snapshots, _history(spark, sf_dir)).drop("source_id")


@query(_SOURCES_SQL + """, b AS (SELECT max_by(o_orderstatus, o_orderkey) AS last FROM orders),
    p AS (SELECT count(*) AS n FROM d WHERE enabled AND (last_status IN ('failed', 'unhealthy') OR old))
    SELECT p.n = 0 AND last <> 'F' AS ok, p.n AS problem_sources, (SELECT count(*) FROM orders WHERE o_orderstatus IN ('O', 'P')) AS active_jobs FROM p, b""")
def overall_health(spark, sf_dir):
    backups = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "if(o_orderstatus = 'F', 'failed', 'succeeded') AS status")
    states = health.source_health(_sources(spark, sf_dir), now()).select("source_id", "state")
    one = health.overall(states, backups, _jobs(spark, sf_dir).select("id", "status"))
    return one.select("ok", F.col("n_problems").alias("problem_sources"), "active_jobs")


@query(f"WITH {_JOBS_SQL}" + """, last AS (SELECT * FROM jobs WHERE kind = '1-URGENT' ORDER BY id DESC LIMIT 1)
    SELECT status = 'succeeded' AND made + INTERVAL 90 SECOND + INTERVAL 24 HOUR <= TIMESTAMP '2025-02-15 00:00:00' AS due FROM last""")
def backup_due(spark, sf_dir):
    log = _jobs(spark, sf_dir).withColumn("kind", F.expr("if(kind = '1-URGENT', 'backup', kind)"))
    return jobs.backup_due(log, now())


@query(_SOURCES_SQL + """, busy AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS source_id FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 40 = 0)
    SELECT 'scrape' AS kind, CAST(source_id AS VARCHAR) AS source_id, '{}' AS params FROM d WHERE enabled AND last_run_at
        + to_minutes(CAST(least(interval_minutes * 2 ** least(consecutive_failures, 4), 1440) AS BIGINT)) <= TIMESTAMP '2025-02-15 00:00:00' AND CAST(source_id AS VARCHAR) NOT IN (SELECT source_id FROM busy)""")
def queue_due_sources(spark, sf_dir):
    log = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "if(o_orderkey % 40 = 0, 'scrape', 'backup') AS kind", "cast(o_custkey AS string) AS source_id", "'{ }' AS params",
        "CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'succeeded' END AS status",
    )
    return jobs.queue_due(health.due_sources(_sources(spark, sf_dir), now()), log, "scrape")


@query(f"WITH {_JOBS_SQL}" + """,
    lines AS (SELECT l_orderkey AS id, l_partkey * 100 + l_linenumber AS n, l_returnflag || l_linenumber AS m FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey * 100 + l_linenumber DESC, l_returnflag || l_linenumber DESC) <= 3),
    told AS (SELECT id, string_agg(m, '|' ORDER BY n, m) AS events FROM lines GROUP BY id)
    SELECT id, status, CASE WHEN status = 'succeeded' THEN 90.0 ELSE epoch(TIMESTAMP '2025-02-15 00:00:00' - made) END::DOUBLE AS elapsed_seconds, coalesce(events, '') AS events FROM jobs LEFT JOIN told USING (id)""")
def job_reports(spark, sf_dir):
    log = _jobs(spark, sf_dir).withColumns({"total": F.lit(1).cast("long"), "done": F.lit(1).cast("long")})
    messages = F.concat("l_returnflag", F.col("l_linenumber").cast("string"))
    events = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.struct((F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("n"), messages.alias("m")).alias("id"), messages.alias("message"))
    return jobs.report(log, events, 3, now()).select("id", "status", F.col("elapsed_seconds").cast("double"), F.concat_ws("|", "events").alias("events"))
