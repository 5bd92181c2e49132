"""A catalogue: a folder of Parquet tables, or tables handed in, as DataFrames and views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .schemas import LOADED, PARTITIONED, SCHEMAS, source_table

# fixed value: the source's names of table families
_FAMILY = re.compile(r"(TZUKN|TGRR|THGR|TKNHG)\d{6}")


class Catalog:
    """Tables by name. A table that is absent reads as empty; `has` tells the difference."""

    def __init__(self, spark: SparkSession, folder: str | None = None, tables: dict[str, DataFrame] | None = None) -> None:
        self.spark, self.folder, self.tables = spark, folder, dict(tables or {})
        self._loaded: set[tuple[str, int]] | None = None

    def has(self, name: str) -> bool:
        if name not in self.tables and self.folder is not None:
            try:
                self.tables[name] = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}")
            except AnalysisException:
                return False
        return name in self.tables

    def table(self, name: str) -> DataFrame:
        return self.tables[name] if self.has(name) else self.spark.createDataFrame([], SCHEMAS[name])

    def partition(self, name: str, doc_type_id: int) -> DataFrame | None:
        """One document type's part of a partitioned table, or None where the source has no such table."""
        if name not in PARTITIONED:
            return None
        part = self.table(name).where(F.col("doc_type_id") == doc_type_id)
        return part if (name, doc_type_id) in self.loaded() or not part.isEmpty() else None

    def loaded(self) -> set[tuple[str, int]]:
        """The family tables that were loaded, which may have no rows; one per document type, so they are few."""
        if self._loaded is None:
            self._loaded = {(r["name"], r["doc_type_id"]) for r in self.table(LOADED).distinct().collect()}
        return self._loaded

    def resolve(self, source_name: str) -> DataFrame | None:
        """A family table by its source name: checked against the allowed names, None if malformed or absent."""
        if not _FAMILY.fullmatch(source_name):
            return None
        name, doc_type_id = source_table(source_name)
        return self.partition(name, doc_type_id)

    def register(self, prefix: str = "") -> list[str]:
        """Views for SQL, one per table that is there."""
        found = [n for n in SCHEMAS if self.has(n)]
        for n in found:
            self.table(n).createOrReplaceTempView(prefix + n)
        return found

    def lookup(self, name: str, key: str, value) -> DataFrame:
        """The row with a key; the lowest in column order where the key repeats."""
        rows = self.table(name).where(F.col(key) == F.lit(value))
        return rows.orderBy(*rows.columns).limit(1)


def family_suffix(doc_type_id: int) -> str:
    """Document type numbers are padded to six digits, longer ones stay as they are."""
    return str(doc_type_id).zfill(6)
