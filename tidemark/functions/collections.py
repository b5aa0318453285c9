"""Array, map, JSON and hash functions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, truthy


def entries_to_map(entries: Column | str) -> Column:
    """A map of an array of struct(Key, Value); of a repeated key the last value counts."""
    entries = _col(entries)
    keys = F.transform(entries, lambda e: e["Key"])
    last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["Key"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["Key"], e["Value"])))


def without_keys(values: Column | str, keys: Iterable[str]) -> Column:
    keys = list(keys)
    return F.map_filter(_col(values), lambda k, v: ~k.isin(keys))


def filled(values: Column | str) -> Column:
    """Map entries that hold text; null if there are none."""
    kept = F.map_filter(_col(values), lambda k, v: v.isNotNull() & (v != ""))
    return F.when(F.size(kept) > 0, kept)


def filled_items(values: Column | str) -> Column:
    return F.filter(_col(values), lambda v: v.isNotNull() & (v != ""))


def flag_names(flags: dict[str, Column | str]) -> Column:
    """Names of the flags that say yes, in the order given."""
    return F.array_compact(F.array(*(F.when(truthy(c), F.lit(name)) for name, c in flags.items())))


def json_strings(c: Column | str) -> Column:
    """The strings of a JSON array in a text; an empty array for anything else."""
    items = F.try_variant_get(F.try_parse_json(_col(c)), "$", "array<variant>")
    strings = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.transform(strings, lambda v: F.try_variant_get(v, "$", "string")), F.array().cast("array<string>"))


def canonical_json(c: Column | str) -> Column:
    """JSON text with sorted keys and no blanks, by which JSON values are compared."""
    return F.to_json(F.try_parse_json(_col(c)))


def content_hash(fields: Iterable[Column | str]) -> Column:
    """SHA-256 of the named fields, null ones included."""
    return F.sha2(F.to_json(F.struct(*map(_col, fields)), {"ignoreNullFields": "false"}), 256)


def last_items(values: Column | str, n: int) -> Column:
    """The last n items, or all if there are fewer."""
    values = _col(values)
    k = F.least(F.lit(n), F.size(values))
    return F.when(k > 0, F.slice(values, -k, k)).otherwise(F.slice(values, 1, 0))
