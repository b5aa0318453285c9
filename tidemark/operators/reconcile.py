"""Configuration against stored state: differences, overlays and validated settings."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Settings and their defaults.
DEFAULT_SETTINGS: Mapping[str, object] = {"target_move_in": "2027-06-01", "near_miss_days": 45, "gone_after_misses": 3}


def config_diff(defined: DataFrame, stored: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows by what a sync would do: key, change (created, updated, unchanged or orphaned)."""
    a = defined.select(F.col(key), F.struct(*columns).alias("new"), F.lit(True).alias("is_defined"))
    b = stored.select(F.col(key), F.struct(*columns).alias("old"), F.lit(True).alias("is_stored"))
    change = (
        F.when(F.col("is_stored").isNull(), "created")
        .when(F.col("is_defined").isNull(), "orphaned")
        .when(F.col("new").eqNullSafe(F.col("old")), "unchanged")
        .otherwise("updated")
    )
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def synced(defined: DataFrame, stored: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The table after a sync: defined values, and stored ones of orphans."""
    a, b = (df.select(F.col(key), F.struct(*columns).alias(n)) for df, n in ((defined, "new"), (stored, "old")))
    return a.join(b, key, "full_outer").select(key, F.coalesce("new", "old").alias("_row")).select(key, "_row.*")


def overlay(defaults: DataFrame, stored: DataFrame) -> DataFrame:
    """Defaults (key, value) with the stored values of the same keys; unknown stored keys are ignored."""
    kept = stored.select("key", F.struct("value").alias("own"))
    return defaults.join(kept, "key", "left").select("key", F.when(F.col("own").isNotNull(), F.col("own.value")).otherwise(F.col("value")).alias("value"))


def last_settings(changes: DataFrame) -> DataFrame:
    """Of a log of changes (key, value, changed) the last per key."""
    last = Window.partitionBy("key").orderBy(F.desc("changed"))
    return changes.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def _iso_day(value: object) -> str:
    return date.fromisoformat(str(value)).isoformat()


def _count(value: object) -> int:
    if (number := int(str(value))) < 0:
        raise ValueError(f"{number} is negative")
    return number


#: What a setting holds, by its key.
PARSERS: Mapping[str, Callable[[object], object]] = {key: _iso_day if isinstance(default, str) else _count for key, default in DEFAULT_SETTINGS.items()}


def validate_setting(key: str, value: object) -> object:
    """The value to store; raises KeyError for an unknown key and ValueError for a bad value."""
    try:
        parse = PARSERS[key]
    except KeyError:
        raise KeyError(f"no setting {key!r}; there are {', '.join(sorted(PARSERS))}") from None
    return parse(value)


def typed_setting(settings: DataFrame, key: str, kind: str = "string") -> DataFrame:
    """The value of one setting (key, value as text) as ``kind``, null if it is not one; no row if it is not set."""
    return settings.where(F.col("key") == key).select("key", F.col("value").try_cast(kind).alias("value"))


def set_enabled(sources: DataFrame, source_id: str, enabled: bool, reason: str | None = None) -> DataFrame:
    """``sources`` with one source switched; enabling clears the reason, disabling states one."""
    mine = F.col("source_id") == source_id
    why = F.lit(None if enabled else reason or "disabled manually").cast("string")
    return sources.withColumns({"enabled": F.when(mine, F.lit(enabled)).otherwise(F.col("enabled")), "disabled_reason": F.when(mine, why).otherwise(F.col("disabled_reason"))})
