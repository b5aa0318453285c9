"""Readers by platform, and source definitions in TOML."""

from __future__ import annotations

import json
import os
import tomllib
from collections.abc import Callable, Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

READERS: dict[str, Callable[..., DataFrame]] = {}
SOURCE_COLUMNS = ("name", "platform", "interval_minutes", "expected_min", "expected_max")
SOURCE_TABLE = "source_id string, name string, platform string, interval_minutes int, expected_min int, expected_max int, enabled boolean, disabled_reason string, config string"


def register(platform: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Makes a function the reader of a platform."""

    def add(reader: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        READERS[platform] = reader
        return reader

    return add


def reader(platform: str) -> Callable[..., DataFrame]:
    if platform not in READERS:
        raise KeyError(f"no reader for {platform!r}; there are {', '.join(sorted(READERS)) or 'none'}")
    return READERS[platform]


def source_table(spark: SparkSession, toml: str) -> DataFrame:
    """Definitions in TOML text as rows of sources; what is no column of its own goes to config as JSON."""
    definitions = tomllib.loads(toml).get("sources", {})
    return spark.createDataFrame([_source_row(name, given) for name, given in definitions.items()], SOURCE_TABLE)


def _source_row(source_id: str, given: Mapping[str, object]) -> tuple:
    enabled = given.get("enabled", True)
    own = {"source_id": source_id, **{c: given.get(c) for c in SOURCE_COLUMNS}, "enabled": enabled, "disabled_reason": None if enabled else given.get("disabled_reason")}
    rest = {k: v for k, v in given.items() if k not in own}
    return (*own.values(), json.dumps(rest, sort_keys=True, default=str))


def load_config(path: str | None, defaults: Mapping[str, object], prefix: str, environment: Mapping[str, str] | None = None) -> dict[str, object]:
    """Process settings: defaults, then the TOML file, then environment variables; keys without a default go to ``extra``."""
    environment = os.environ if environment is None else environment
    given = tomllib.loads(Path(path).read_text()) if path and Path(path).exists() else {}
    config: dict[str, object] = {**defaults, **{k: v for k, v in given.items() if k in defaults}}
    for key, value in defaults.items():
        if (text := environment.get(f"{prefix}{key.upper()}")) is not None:
            config[key] = text if value is None else type(value)(text)
    config["extra"] = {k: v for k, v in given.items() if k not in defaults}
    return config
