"""Records from the pages of a JSON API, as landed by whoever fetches them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import collections as C
from tidemark.functions import dates as D
from tidemark.functions import numbers as M
from tidemark.functions import text as T
from tidemark.plans.schemas import CONTENT
from tidemark.sources.json_files import body_text, field
from tidemark.sources.registry import register

#: Flags of included utilities, fields of a contact, and fields that change while the listing does not.
UTILITIES = {
    "isWaterIncluded": "water",
    "isSewageIncluded": "sewer",
    "isGarbageIncluded": "trash",
    "isElectricIncluded": "electric",
    "isGasIncluded": "gas",
    "isInternetIncluded": "internet",
    "isCableIncluded": "cable",
    "isSnowRemovalIncluded": "snow removal",
    "isLandscapingIncluded": "landscaping",
}
CONTACT = {
    "name": "contactName",
    "phone": "phone",
    "email": "email",
    "secondary_name": "secondaryContactName",
    "secondary_phone": "secondaryPhone",
    "secondary_email": "secondaryEmail",
    "managing_agent": "managingAgent",
    "building_owner": "buildingOwner",
}
VOLATILE = ("advertisedDate", "isFeatured", "listingImageID", "imageUrl")
PAGE, DETAIL = "/_system/listings/", "/_system/api/listings/"


def _value(name: str) -> Column:
    return F.try_variant_get("record", f"$.{name}", "variant")


def _text(name: str) -> Column:
    return T.clean_variant(_value(name))


def _number(name: str) -> Column:
    return M.variant_number(_value(name))


def _integer(name: str) -> Column:
    return F.bround(_number(name)).try_cast("int")


def _flag(name: str) -> Column:
    return T.truthy(field("record", name))


def _given(name: str) -> Column:
    return _value(name).isNotNull() & ~F.is_variant_null(_value(name))


def api_records(pages: DataFrame) -> DataFrame:
    """Active records of landed pages (fetch_id, page, body): fetch_id, page, seq, record (variant).

    A body without ``listings`` is an error. A record is active unless its ``isActive`` says otherwise;
    a JSON null does, a missing one does not.
    """
    parsed = pages.select("fetch_id", "page", F.parse_json(body_text()).alias("data"))
    listings = F.try_variant_get("data", "$.listings", "array<variant>")
    checked = F.when(F.variant_get("data", "$.listings", "variant").isNull(), F.raise_error(F.lit("the response has no listings"))).otherwise(listings)
    records = parsed.select("fetch_id", "page", F.posexplode(checked).alias("seq", "record")).withColumn("seq", F.col("seq").cast("long"))
    return active(records)


def active(records: DataFrame) -> DataFrame:
    """Records (record: variant) that are active."""
    return records.where(_value("isActive").isNull() | _flag("isActive"))


def summary(record: str = "record") -> Column:
    """JSON text of a record without its volatile fields, by which details are found stale."""
    return F.to_json(C.without_keys(F.col(record).cast("map<string, variant>"), VOLATILE))


def detail_photos(details: DataFrame, base: str) -> DataFrame:
    """Absolute photo URLs of landed detail responses (listing, body): listing, photos."""
    images = F.try_variant_get(F.parse_json(body_text()), "$.images", "array<struct<url: string>>")
    urls = F.transform(C.filled_items(F.transform(F.coalesce(images, F.array().cast("array<struct<url: string>>")), lambda i: i["url"])), lambda u: T.absolute_url(u, F.lit(base)))
    return details.select("listing", urls.alias("photos"))


@register("json_api")
def normalize(records: DataFrame, photos: DataFrame, base: str, platform: str) -> DataFrame:
    """API records (fetch_id, page, seq, record) with their photos (listing, photos) in the schema RECORD, with seq.

    ``features`` counts only as JSON text, as the format's first reader had it.
    """
    address = T.split_unit(F.nullif(field("record", "address"), F.lit("")))
    street, unit = address["street"], address["unit"]
    city = T.compose(" ", _text("stateID"), _text("postalCode"))
    no = lambda name, word: F.when(_given(name), F.when(_flag(name), F.lit(f"{word} ok")).otherwise(F.lit(f"no {word}")))
    pets = F.concat_ws("; ", no("acceptCats", "cats"), no("acceptDogs", "dogs"), F.when(_text("petDescription").isNotNull(), T.html_to_text(field("record", "petDescription"))))
    spaces = F.when(_integer("parkingSpaces") != 0, F.concat(_integer("parkingSpaces").cast("string"), F.lit(" spaces")))
    included = F.concat_ws(", ", C.flag_names({word: field("record", name) for name, word in UTILITIES.items()}))
    contact = C.filled(F.create_map(*(x for k, name in CONTACT.items() for x in (F.lit(k), _text(name)))))
    features = F.when(F.schema_of_variant(_value("features")) == "STRING", field("record", "features"))
    listing = field("record", "listingID")
    page = F.coalesce(F.nullif(field("record", "pageUrl"), F.lit("")), F.concat(F.lit(PAGE), listing, F.lit("/"), F.coalesce(field("record", "url"), F.lit(""))))
    extra = F.to_json(F.struct(
        F.lit(platform).alias("platform"), F.parse_json(summary()).alias("summary"),
        _number("latitude").alias("lat"), _number("longitude").alias("lon"), _integer("deposit").alias("deposit"),
        F.when(_given("isFurnished"), _flag("isFurnished")).alias("furnished"),
        T.html_to_text(field("record", "leaseDescription")).alias("lease_terms"),
        _text("feedTypeName").alias("feed"), _text("feedSourceID").alias("feed_source_id"),
        D.epoch_iso(F.bround(_number("advertisedDate")).try_cast("bigint")).alias("advertised_at"),
    ), {"ignoreNullFields": "false"})
    columns = {
        "external_id": listing,
        "url": F.concat(T.base_url(F.lit(base)), page),
        "title": _text("headline"),
        "address_raw": T.compose(", ", street, _text("address2"), _text("city"), city),
        "unit_raw": unit,
        "rent": _integer("rent"),
        "beds": _number("beds"),
        "baths": _number("baths"),
        "sqft": _integer("size"),
        "avail_structured_raw": _text("dateAvailable"),
        "avail_structured_date": D.parse_date(field("record", "dateAvailable")),
        "description": T.html_to_text(field("record", "description")),
        "pets": F.nullif(pets, F.lit("")),
        "parking": F.nullif(F.concat_ws("; ", _text("parkingTypeName"), spaces), F.lit("")),
        "utilities": F.when(included != "", included).when(_flag("noUtilitiesIncluded"), F.lit("none included")),
        "amenities": C.json_strings(features),
        "photos": F.coalesce("photos", F.array().cast("array<string>")),
        "contact_raw": F.to_json(contact),
        "extra": extra,
    }
    joined = records.withColumn("listing", listing).join(photos, "listing", "left")
    return joined.select("page", "seq", *(columns[c].alias(c) for c in CONTENT), F.col("fetch_id").cast("long").alias("raw_fetch_id"))
