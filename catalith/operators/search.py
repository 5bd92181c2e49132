"""Searching listings, groups and code fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.functions.scalars import node_label, search_term


def search_documents(rows: DataFrame, text: str, columns: tuple[str, ...] = ("title", "code")) -> DataFrame:
    """Rows with the term in any of the columns, case aside; a blank term keeps all. The term is no pattern."""
    term = search_term(text)
    if not term:
        return rows
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(c), F.lit(term)), F.lit(False))
    return rows.where(found)


def search_groups(rows: DataFrame, text: str) -> DataFrame:
    """Groups whose label (code, name and variant) contains the term."""
    label = node_label(F.col("code"), F.col("name"), F.col("variant_name"))
    return search_documents(rows.withColumn("_label", label), text, ("_label",)).drop("_label")


def first_result(rows: DataFrame, *order: str) -> DataFrame:
    return rows.orderBy(*(order or ("id",))).limit(1)
