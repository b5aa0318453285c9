"""Schemas: the normalized record and the tables of the change-tracking store.

Times are zone-less UTC. Tables marked as schema only have no operator in this library.
"""

from __future__ import annotations

RECORD = """external_id string, url string, title string, address_raw string, unit_raw string, rent int, beds double, baths double, sqft int,
    avail_structured_raw string, avail_structured_date date, description string, pets string, parking string, utilities string,
    amenities array<string>, photos array<string>, contact_raw string, extra string, raw_fetch_id bigint"""

#: Fields of a record that make its content: all but the fetch it came from.
CONTENT = tuple(field.split()[0] for field in RECORD.replace("\n", " ").split(", ") if not field.strip().startswith("raw_fetch_id"))

TABLES: dict[str, str] = {
    "settings": "key string, value string, updated_at timestamp_ntz",
    "sources": """source_id string, name string, platform string, config string, enabled boolean, disabled_reason string, interval_minutes int,
        expected_min int, expected_max int, last_run_at timestamp_ntz, last_success_at timestamp_ntz, last_status string, last_error string,
        last_count int, consecutive_failures int""",
    "jobs": """id bigint, kind string, source_id string, params string, status string, total bigint, done bigint, step string, error string,
        result string, pid int, created_at timestamp_ntz, started_at timestamp_ntz, finished_at timestamp_ntz, heartbeat_at timestamp_ntz""",
    "job_events": "id bigint, job_id bigint, at timestamp_ntz, level string, message string",
    "scrape_runs": """run bigint, source_id string, job_id bigint, status string, healthy boolean, health_notes string, listings_found int,
        error string, parser_version string, started_at timestamp_ntz, finished_at timestamp_ntz""",
    "raw_blobs": "sha256 string, size bigint, content_type string, body binary",
    "raw_fetches": "fetch_id bigint, run bigint, url string, http_status int, sha256 string, via string, fetched_at timestamp_ntz",
    "observations": f"source_id string, run bigint, seq bigint, observed_at timestamp_ntz, parser_version string, {RECORD}",
    "listing_snapshots": f"source_id string, run bigint, seq bigint, observed_at timestamp_ntz, parser_version string, content_hash string, {RECORD}",
    "source_listings": "source_id string, listing string, status string, misses bigint, first_seen bigint, last_seen bigint, last_verified bigint",
    "status_events": "source_id string, listing string, run bigint, seq bigint, step int, from_status string, to_status string",
}

#: Schema only.
SCHEMA_ONLY: dict[str, str] = {
    "buildings": "id bigint, norm_key string, address string, city string, state string, postal_code string, lat double, lon double, name string",
    "units": "id bigint, building_id bigint, norm_unit string, unit string, merged_into_id bigint",
    "merge_log": "id bigint, kind string, subject string, from_id bigint, into_id bigint, reason string, at timestamp_ntz",
    "companies": "id bigint, name string, norm string, website string, notes string, merged_into_id bigint",
    "contacts": "id bigint, company_id bigint, name string, role string, notes string, merged_into_id bigint",
    "contact_names": "id bigint, contact_id bigint, name string, norm string",
    "contact_points": "id bigint, contact_id bigint, kind string, value string",
    "contact_mentions": "id bigint, contact_id bigint, snapshot_id bigint, raw string, at timestamp_ntz",
    "outreach_log": "id bigint, contact_id bigint, unit_id bigint, channel string, summary string, follow_up_on date, at timestamp_ntz",
    "unit_prefs": "unit_id bigint, rating int, hidden boolean, notes string, updated_at timestamp_ntz",
    "unit_tags": "unit_id bigint, tag string, created_at timestamp_ntz",
}
