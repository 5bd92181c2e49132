"""Favourite vehicles and documents: two lists held as one small table (kind, series, model, engine, doc_id, name)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "kind string, series_id long, model_id long, engine_id long, doc_id long, name string"
IDENTITY = ["kind", "series_id", "model_id", "engine_id", "doc_id"]


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def _same(entry: dict):
    out = F.lit(True)
    for c in IDENTITY:
        out = out & F.col(c).eqNullSafe(F.lit(entry.get(c)))
    return out


def add(rows: DataFrame, entry: dict) -> DataFrame:
    """Add an entry unless one with its identity is there."""
    new = rows.sparkSession.createDataFrame([tuple(entry.get(c) for c in [*IDENTITY, "name"])], SCHEMA)
    held = rows.select(*[F.col(c).alias(f"_{c}") for c in IDENTITY])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in IDENTITY]
    return rows.unionByName(new.join(held, same, "left_anti"))


def remove(rows: DataFrame, entry: dict) -> DataFrame:
    return rows.where(~_same(entry))


def rename(rows: DataFrame, entry: dict, name: str) -> DataFrame:
    return rows.withColumn("name", F.when(_same(entry), F.lit(name)).otherwise(F.col("name")))


def contains(rows: DataFrame, entry: dict) -> bool:
    return not rows.where(_same(entry)).isEmpty()


def count(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.count("*").alias("entries"))


def export(rows: DataFrame) -> str:
    """All entries as JSON text; a user's list is small by nature."""
    found: dict[str, list] = {"vehicles": [], "documents": []}
    for r in rows.orderBy("kind", "name").toLocalIterator():
        found[f"{r['kind']}s"].append({k: v for k, v in r.asDict().items() if k != "kind" and v is not None})
    return json.dumps(found, indent=2, ensure_ascii=False)


def load(spark: SparkSession, text: str) -> DataFrame:
    """The entries of an export, replacing all others. Raises ValueError if a list or key is missing."""
    data = json.loads(text)
    if not isinstance(data, dict) or not all(isinstance(data.get(k), list) for k in ("vehicles", "documents")):
        raise ValueError("both lists are required")
    rows = []
    for kind, needed in (("vehicle", ("series_id", "model_id", "engine_id")), ("document", ("doc_id",))):
        for x in data[f"{kind}s"]:
            if any(k not in x for k in needed):
                raise ValueError(f"a {kind} lacks one of {needed}")
            rows.append((kind, *(x.get(c) for c in [*IDENTITY[1:], "name"])))
    return spark.createDataFrame(rows, SCHEMA)
