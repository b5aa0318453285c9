"""Sources on payloads of the formats' shapes, and the ingest plan from end to end."""

import datetime as dt
import html
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.plans import ingest
from tidemark.plans.schemas import CONTENT, RECORD, SCHEMA_ONLY, TABLES
from tidemark.sources import embedded_state, json_api, json_files, registry

FETCHES = "fetch_id long, body binary"


def payload(value):
    return bytearray(json.dumps(value).encode())


def listing(k, **fields):
    return {"external_id": str(k), "url": f"https://example.org/{k}", "rent": 1500, **fields}


def test_schemas_parse(spark):
    for ddl in (RECORD, *TABLES.values(), *SCHEMA_ONLY.values()):
        assert spark.createDataFrame([], ddl).columns
    assert len(CONTENT) == 19


def test_file_records(spark):
    body = payload([listing(1, beds=2.5, status="pending", amenities=["a"], avail_structured_date="2026-10-01", extra={"lost": 1}), listing(2, rent=None, contact_raw={"name": "n"})])
    a, b = json_files.file_records(spark.createDataFrame([(7, body)], FETCHES)).orderBy("seq").collect()
    assert (a["external_id"], a["rent"], a["beds"], a["amenities"], a["photos"], a["raw_fetch_id"]) == ("1", 1500, 2.5, ["a"], [], 7)
    assert a["avail_structured_date"] == dt.date(2026, 10, 1) and json.loads(a["extra"]) == {"status": "pending"}
    assert (b["rent"], json.loads(b["contact_raw"]), b["seq"]) == (None, {"name": "n"}, 1)
    kept = json_files.file_records(spark.createDataFrame([(7, body)], FETCHES), keep_extra=True).orderBy("seq").first()
    assert json.loads(kept["extra"]) == {"status": "pending", "extra": {"lost": 1}}


def test_files_are_landed_whole(spark, tmp_path):
    (tmp_path / "a.json").write_bytes(b'[\n {"external_id": "\xff"}\n]')
    one = json_files.landed(spark, str(tmp_path)).withColumn("fetch_id", F.lit(1)).collect()
    assert len(one) == 1 and one[0]["body"].startswith(b"[\n")
    text = json_files.landed(spark, str(tmp_path)).select(json_files.body_text().alias("t")).first()["t"]
    assert "�" in text


API = {
    "listingID": "208", "isActive": "1", "address": "133 Elm Avenue - 4", "address2": None, "city": "Burlington", "stateID": "VT", "postalCode": "05401",
    "latitude": "44.5", "rent": "1600.00", "deposit": "$1,600", "beds": "1", "baths": "1.00", "size": "600", "dateAvailable": "2026-10-01", "advertisedDate": "1787016624",
    "description": "One<br/>two", "features": "[\"Heat\", 3]", "parkingTypeName": False, "parkingSpaces": "2", "acceptDogs": None, "acceptCats": "1",
    "isWaterIncluded": "1", "isGasIncluded": "0", "isFurnished": None, "phone": " 555 ", "url": "elm-4", "headline": "Nice",
}


def test_api_records(spark):
    off, gone = {**API, "listingID": 2, "isActive": "0"}, {**API, "listingID": 3, "isActive": None}
    unsaid = {k: v for k, v in API.items() if k != "isActive"} | {"listingID": 4, "features": ["a list"], "beds": 0, "isWaterIncluded": None, "noUtilitiesIncluded": "1"}
    pages = spark.createDataFrame([(1, 1, payload({"listings": [API, off]})), (2, 2, payload({"listings": [gone, unsaid], "pagination": {"total_pages": 2}}))], "fetch_id long, page int, body binary")
    details = spark.createDataFrame([("208", payload({"images": [{"url": "/i/1"}, {"url": ""}, {"url": "https://x/2"}]}))], "listing string, body binary")
    records = json_api.api_records(pages)
    a, b = json_api.normalize(records, json_api.detail_photos(details, "https://h/"), "https://h/", "api").orderBy("page", "seq").collect()
    assert (a["external_id"], a["url"], a["title"]) == ("208", "https://h/_system/listings/208/elm-4", "Nice")
    assert (a["address_raw"], a["unit_raw"], a["rent"], a["beds"], a["sqft"]) == ("133 Elm Avenue, Burlington, VT 05401", "4", 1600, 1.0, 600)
    assert (a["pets"], a["parking"], a["utilities"], a["amenities"]) == ("cats ok", "2 spaces", "water", ["Heat"])
    assert (a["photos"], a["description"], a["avail_structured_date"]) == (["https://h/i/1", "https://x/2"], "One\ntwo", dt.date(2026, 10, 1))
    extra = json.loads(a["extra"])
    assert (extra["deposit"], extra["lat"], extra["furnished"], extra["advertised_at"][:4]) == (1600, 44.5, None, "2026")
    assert "advertisedDate" not in extra["summary"] and json.loads(a["contact_raw"]) == {"phone": "555"}
    assert (b["external_id"], b["amenities"], b["beds"], b["utilities"], b["photos"]) == ("4", [], None, "none included", [])


def test_api_without_listings_is_an_error(spark):
    pages = spark.createDataFrame([(1, 1, payload({"error": "x"}))], "fetch_id long, page int, body binary")
    with pytest.raises(PySparkException):
        json_api.api_records(pages).collect()


def state_page(model):
    return bytearray(f'<html><input type="hidden" id="__dot_viewmodel_root" value="{html.escape(json.dumps({"viewModel": model}))}"></html>'.encode())


def pairs(**fields):
    return [{"Key": k, "Value": v} for k, v in fields.items()]


def test_embedded_state(spark):
    record = pairs(listingid="5", unitid="6", line1="1 Main St", line2=" ", city="Town", state="VT", postalcode="05401", unitnumber="2", listingrent="$1,250.00", bedtypedesc="Studio",
                   bathtypedesc="1.5 Bath", squarefootage="500", availabilitydate="Sunday, June 1, 2025", unitdescription="Big &amp; bright", propertydescription="bright", imageUrl="volatile", contactphone="555")
    search = spark.createDataFrame([(1, "https://h/search", state_page({"ContentViewModel": {"Listings": [record]}}))], "fetch_id long, url string, body binary")
    detail = spark.createDataFrame([("5", state_page({"HtmlContainer": pairs(rentalFeaturesList="<ul><li>Heat</li><li></li></ul>", BuildingFeaturesList="<li>Lift</li>", leaseTerms="1 year")}))], "listing string, body binary")
    images = spark.createDataFrame([("5", state_page({"Images": [{"IsVideo": True, "VideoUrl": "v"}, {"IsVideo": False, "LargeThumbUrl": "i"}, {"IsVideo": False, "LargeThumbUrl": ""}]}))], "listing string, body binary")
    records = embedded_state.search_records(search)
    r = embedded_state.normalize(records, embedded_state.detail_fields(detail), embedded_state.image_urls(images), "https://h/", "embedded").first()
    assert (r["external_id"], r["rent"], r["beds"], r["baths"], r["sqft"], r["unit_raw"]) == ("5", 1250, 0.0, 1.5, 500, "2")
    assert r["url"] == "https://h/Resident/PublicPages/apartmentdetail.aspx?listingId=5&unitid=6&buildingid="
    assert (r["address_raw"], r["avail_structured_date"], r["description"]) == ("1 Main St, Town, VT 05401", dt.date(2025, 6, 1), "Big & bright")
    assert (r["amenities"], r["photos"], json.loads(r["contact_raw"])) == (["Heat", "Lift"], ["v", "i"], {"phone": "555"})
    extra = json.loads(r["extra"])
    assert extra["lease_terms"] == "1 year" and "imageUrl" not in extra["summary"]


@pytest.mark.parametrize(("url", "body"), [("https://h/portal/login", state_page({"ContentViewModel": {"Listings": []}})), ("https://h/s", bytearray(b"<html>")), ("https://h/s", state_page({"ContentViewModel": {}}))])
def test_pages_without_listings_are_errors(spark, url, body):
    with pytest.raises(PySparkException):
        embedded_state.search_records(spark.createDataFrame([(1, url, body)], "fetch_id long, url string, body binary")).collect()


def test_registry_and_config(spark, tmp_path):
    @registry.register("test-platform")
    def read(spark):
        return spark.range(1)

    assert registry.reader("test-platform") is read
    with pytest.raises(KeyError):
        registry.reader("missing")
    toml = '[sources.a]\nname = "A"\nplatform = "file"\npath = "/x"\n[sources.b]\nenabled = false\ndisabled_reason = "off"\n'
    a, b = registry.source_table(spark, toml).orderBy("source_id").collect()
    assert (a["platform"], a["enabled"], json.loads(a["config"]), b["enabled"], b["disabled_reason"]) == ("file", True, {"path": "/x"}, False, "off")
    (tmp_path / "c.toml").write_text('port = 1\nother = "x"\n')
    assert registry.load_config(str(tmp_path / "c.toml"), {"port": 8, "host": "h"}, "T_", {"T_HOST": "g"}) == {"port": 1, "host": "g", "extra": {"other": "x"}}


def test_ingest_from_end_to_end(spark):
    """Ten listings; one is edited, one leaves for three runs and returns, and a bad run does not count as absence."""
    runs, observations = [], None
    for run in range(1, 7):
        items = [listing(k, rent=1600 if (k, run) == (1, 2) or (k == 1 and run > 2) else 1500, status="Pending" if k == 2 and run == 3 else None) for k in range(10) if not (k == 9 and 2 <= run <= 5)]
        items = items[:2] if run == 3 else items
        got = json_files.file_records(spark.createDataFrame([(run, payload(items))], FETCHES)).withColumns({"source_id": F.lit("s"), "run": F.lit(run).cast("long")})
        observations = got if observations is None else observations.unionByName(got)
        runs.append(("s", run, "ok", True, 1, None))
    table = spark.createDataFrame(runs, "source_id string, run long, status string, complete_feed boolean, expected_min int, expected_max int")
    views = ingest.derive(observations, table)
    assert [(r["run"], r["healthy"], r["problems"]) for r in views.runs.orderBy("run").collect()] == [(1, True, None), (2, True, None), (3, False, "sudden drop: 2 vs recent median 9.5"), (4, True, None), (5, True, None), (6, True, None)]
    assert [(r["run"], r["rent"]) for r in views.snapshots.where("external_id = '1'").orderBy("run").collect()] == [(1, 1500), (2, 1600)]
    assert [(r["run"], r["to_status"]) for r in views.events.where("listing = '9'").orderBy("run").collect()] == [(1, "available"), (5, "gone"), (6, "relisted")]
    assert {r["status"] for r in views.listings.where("listing <> '9'").collect()} == {"available"}


def test_a_record_without_url_fails(spark):
    bad = json_files.file_records(spark.createDataFrame([(1, payload([{"external_id": "1", "url": ""}]))], FETCHES))
    with pytest.raises(PySparkException):
        ingest.checked_url(bad).select("url").collect()
