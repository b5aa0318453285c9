"""Files that hold a JSON array of records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.dates import parse_date
from tidemark.plans.schemas import CONTENT
from tidemark.sources.registry import register

_TEXT = ("external_id", "url", "title", "address_raw", "unit_raw", "avail_structured_raw", "description", "pets", "parking", "utilities", "contact_raw")


def field(record: Column | str, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(record) if isinstance(record, str) else record, f"$.{name}", kind)


def landed(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as fetched: url, body, fetched_at."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("url"), F.col("content").alias("body"), F.col("modificationTime").cast("timestamp_ntz").alias("fetched_at"))


def body_text(body: Column | str = "body") -> Column:
    """Bytes as text; what is not UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8((F.col(body) if isinstance(body, str) else body).cast("string"))


def array_items(fetches: DataFrame, body: str = "body") -> DataFrame:
    """Items of the JSON array in each body: the columns of ``fetches`` but the body, seq and record (variant)."""
    items = F.parse_json(body_text(body)).cast("array<variant>")
    rest = [c for c in fetches.columns if c != body]
    return fetches.select(*rest, F.posexplode(items).alias("seq", "record")).withColumn("seq", F.col("seq").cast("long"))


def unknown_fields(record: str, keep_extra: bool) -> Column:
    """JSON text of the fields that a record has besides the known ones."""
    known = [c for c in CONTENT if c != "extra" or not keep_extra]
    entries = F.col(record).cast("map<string, variant>")
    return F.to_json(F.map_filter(entries, lambda k, v: ~k.isin(*known)))


@register("json_file")
def file_records(fetches: DataFrame, keep_extra: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Normalized records of files (fetch_id, body): the schema RECORD, with seq.

    Fields that are not known go to ``extra``. A field of that name is itself known and so its content is
    lost, as in the format's first reader; ``keep_extra`` keeps it. Missing arrays are empty. ``keep`` names columns of
    ``fetches`` that come first, as they are.
    """
    items = array_items(fetches)
    arrays = {c: F.coalesce(field("record", c, "array<string>"), F.array().cast("array<string>")) for c in ("amenities", "photos")}
    columns = {c: field("record", c) for c in _TEXT}
    columns |= {"rent": field("record", "rent", "int"), "sqft": field("record", "sqft", "int"), "beds": field("record", "beds", "double"), "baths": field("record", "baths", "double")}
    columns |= arrays | {"avail_structured_date": parse_date(field("record", "avail_structured_date")), "extra": unknown_fields("record", keep_extra)}
    return items.select(*keep, "seq", *(columns[c].alias(c) for c in CONTENT), F.col("fetch_id").cast("long").alias("raw_fetch_id"))
