"""Tables whose schema changes: numbered versions, and steps from each to the next.

A table says which version it has, and each folder of it which it was written in. Folders of earlier versions are read through the steps, as
projections, so a migration rewrites nothing; ``rewrite`` brings them up to date when that is worth it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidemark.stores.commits import Store


@dataclass(frozen=True)
class Add:
    """A new column, with the value (a SQL expression of the others) that older rows have."""

    name: str
    type: str
    value: str = "NULL"

    def apply(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(self.name, F.expr(self.value).cast(self.type))


@dataclass(frozen=True)
class Rename:
    old: str
    new: str

    def apply(self, rows: DataFrame) -> DataFrame:
        return rows.withColumnRenamed(self.old, self.new)


@dataclass(frozen=True)
class Widen:
    """A column of a type that holds all values of the old one."""

    name: str
    type: str

    def apply(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(self.name, F.col(self.name).cast(self.type))


@dataclass(frozen=True)
class Drop:
    name: str

    def apply(self, rows: DataFrame) -> DataFrame:
        return rows.drop(self.name)


Step = Add | Rename | Widen | Drop
#: What a type may become.
WIDER = {"tinyint": "smallint int bigint", "smallint": "int bigint", "int": "bigint double", "float": "double", "bigint": "decimal(20,0)", "date": "timestamp_ntz", "timestamp_ntz": "string"}


class Versioned(Store):
    """A table with schema ``first`` as version 1, and the steps that make each next version."""

    def __init__(self, spark: SparkSession, uri: str, first: str, migrations: Sequence[Sequence[Step]] = ()):
        super().__init__(spark, uri)
        self.migrations = [tuple(steps) for steps in migrations]
        self.schemas = [StructType.fromDDL(first)]
        for steps in self.migrations:
            for step in steps:
                self._check(step, self.schemas[-1])
            after = spark.createDataFrame([], self.schemas[-1])
            for step in steps:
                after = step.apply(after)
            self.schemas.append(StructType([StructField(f.name, f.dataType, True) for f in after.schema]))
        self.version()

    @staticmethod
    def _check(step: Step, schema: StructType) -> None:
        kinds = {f.name: f.dataType.simpleString() for f in schema}
        if isinstance(step, Widen) and step.name in kinds and step.type not in WIDER.get(kinds[step.name], "").split():
            raise ValueError(f"{step.name} cannot become {step.type} from {kinds[step.name]}")

    @property
    def newest(self) -> int:
        return len(self.schemas)

    def version(self) -> int:
        """The version of the table as stored; an error if these migrations do not know it."""
        stored = self.last()[1].get("version", 1)
        if stored > self.newest:
            raise ValueError(f"the table has version {stored}; version {self.newest} is the last one known here")
        return stored

    def migrate(self) -> int:
        """Brings the table to the newest version; how many steps of version that took. What is written stays."""
        while True:
            number, content = self.last()
            before = self.version()
            if before == self.newest and "version" in content:
                return 0
            if self.commit(number, content | {"version": self.newest}):
                return self.newest - before

    def append(self, rows: DataFrame) -> None:
        """Adds rows of the version that the table has; their columns are matched by name."""
        version = self.version()
        fitted = rows.select(*(F.col(f.name).cast(f.dataType) for f in self.schemas[version - 1]))
        name = self.write(fitted)
        while True:
            number, content = self.last()
            if content.get("version", 1) != version:
                raise ValueError("the table was migrated meanwhile")
            if self.commit(number, content | {"version": version, "parts": [*content.get("parts", []), [name, version]]}):
                return

    def rows(self) -> DataFrame:
        """All rows, in the version that the table has."""
        return self._rows(self.last()[1].get("parts", []), self.version())

    def _rows(self, parts: Sequence[Sequence], version: int) -> DataFrame:
        found = self.spark.createDataFrame([], self.schemas[version - 1])
        for of in sorted({v for _, v in parts}):
            rows = self.read([name for name, v in parts if v == of], self.schemas[of - 1])
            for steps in self.migrations[of - 1 : version - 1]:
                for step in steps:
                    rows = step.apply(rows)
            found = found.unionByName(rows.select(*found.columns))
        return found

    def rewrite(self) -> int:
        """Writes folders of earlier versions anew, in one; how many those were."""
        while True:
            number, content = self.last()
            version, parts = self.version(), content.get("parts", [])
            old = [p for p in parts if p[1] < version]
            if not old:
                return 0
            name = self.write(self._rows(old, version))
            if self.commit(number, content | {"parts": [*(p for p in parts if p[1] == version), [name, version]]}):
                return len(old)
