"""Sources of records."""

from tidemark.sources import embedded_state, json_api, json_files  # noqa: F401  (each registers its reader)
