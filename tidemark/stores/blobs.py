"""A content-addressed store of payloads: each hash once, in folders by the first digits of the hash.

Writers compare with what the store holds under the prefixes that they bring, by the column of hashes alone. A writer that another
overtakes compares with what that one added, and writes again without it. Reads go to the prefixes asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.archive import new_blobs
from tidemark.stores.commits import Content, Store, done

DIGITS = 2
BLOBS = "sha256 string, size long, content_type string, body binary"


class BlobStore(Store):
    def __init__(self, spark: SparkSession, uri: str, digits: int = DIGITS):
        """``digits`` hexadecimal digits make a prefix, so there are at most 16 ** digits folders in a write."""
        super().__init__(spark, uri)
        self.digits = digits

    def _prefix(self):
        return F.substring("sha256", 1, self.digits)

    def _held(self, content: Content, prefixes: Sequence[str] | None = None) -> DataFrame:
        """Blobs under some prefixes, of the commit with this content; no other folder is read."""
        parts = content.get("parts", {})
        wanted = parts if prefixes is None else [p for p in prefixes if p in parts]
        return self.read([f"{name}/prefix={p}" for p in wanted for name in parts[p]], BLOBS)

    def _prefixes(self, hashes: DataFrame) -> list[str]:
        return [r["prefix"] for r in hashes.select(self._prefix().alias("prefix")).distinct().collect()]  # at most 16 ** digits

    def put(self, fetches: DataFrame, batch: int | None = None) -> int:
        """Stores payloads (fetch_id, body, content_type) that are not there yet; how many. Null bodies are none."""
        number, content = self.last()
        if done(content, batch):
            return 0
        hashes = fetches.where("body IS NOT NULL").select(F.sha2("body", 256).alias("sha256"))
        blobs = new_blobs(fetches, self._held(content, self._prefixes(hashes)).select("sha256"))
        name = self._staged(blobs)
        while True:
            prefixes = [p.split("=")[1] for p in self.folder.names(f"data/{name}") if p.startswith("prefix=")]
            parts = content.get("parts", {}) | {p: [*content.get("parts", {}).get(p, []), name] for p in prefixes}
            if self.commit(number, content | {"parts": parts} | ({} if batch is None else {"batch": batch})):
                return self.read([f"{name}/prefix={p}" for p in prefixes], BLOBS).count()
            before, (number, content) = content, self.last()
            if done(content, batch):
                return 0
            added = {p: [n for n in content["parts"].get(p, []) if n not in before.get("parts", {}).get(p, [])] for p in prefixes}
            theirs = self._held({"parts": added})
            mine = self.read([f"{name}/prefix={p}" for p in prefixes], BLOBS)
            if not mine.join(theirs, "sha256", "left_semi").isEmpty():
                name = self._staged(mine.join(theirs.select("sha256"), "sha256", "left_anti"))

    def _staged(self, blobs: DataFrame) -> str:
        spread = blobs.withColumn("prefix", self._prefix()).repartitionByRange("sha256")  # even, and a task has few prefixes
        return self.write(spread, "prefix")

    def blobs(self) -> DataFrame:
        """Every blob: sha256, size, content_type, body."""
        return self._held(self.last()[1])

    def get(self, hashes: DataFrame | Sequence[str]) -> DataFrame:
        """The blobs of the hashes asked for, a few or a table (sha256), that the store has."""
        if isinstance(hashes, DataFrame):
            asked = hashes.select("sha256").distinct()
            return self._held(self.last()[1], self._prefixes(asked)).join(asked, "sha256", "left_semi")
        return self._held(self.last()[1], sorted({h[: self.digits] for h in hashes})).where(F.col("sha256").isin(*hashes))

    def compact(self, most: int = 8) -> None:
        """Writes prefixes of more than ``most`` folders anew, each into one."""
        number, content = self.last()
        many = {p: names for p, names in content.get("parts", {}).items() if len(names) > most}
        if many:
            name = self._staged(self._held({"parts": many}))
            self.commit(number, content | {"parts": content["parts"] | {p: [name] for p in many}})  # overtaken: nothing is lost, the folder is swept
