"""Cross-references by position: the n-th link of a text leads to the targets of hotspot n."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.catalog import Catalog
from catalith.functions.rtf.columns import link_texts
from catalith.operators.documents import document_text
from catalith.plans.applicability import Vehicle, applicable
from catalith.schemas import ENABLED


def hotspots(catalog: Catalog, doc_id: int, vehicle: Vehicle = Vehicle()) -> DataFrame:
    """(number, id, code, doc_type_id, title), each target once per number."""
    spots = catalog.table("hotspot").where((F.col("source_id") == doc_id) & (F.col("enabled") == ENABLED)).select("number", F.col("target_id").alias("id"))
    docs = catalog.table("document").where(F.col("enabled") == ENABLED).select("id", "code", "doc_type_id", "title")
    rows = spots.join(docs, "id").select("number", "id", "code", "doc_type_id", "title")
    rows = applicable(rows, catalog.table("applicability"), vehicle)
    first = rows.groupBy("number", "id").agg(F.min(F.struct("code", "doc_type_id", "title")).alias("t"))
    return first.select("number", "id", "t.*").orderBy("number", "id")


def hotspot_map(spots: DataFrame) -> DataFrame:
    """One row with a map from number to the array of its targets."""
    by_number = spots.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("id", "code", "doc_type_id", "title"))).alias("targets"))
    return by_number.agg(F.map_from_entries(F.collect_list(F.struct("number", "targets"))).alias("hotspots"))


def links(documents: DataFrame, html: str, key: str, pattern: str = r'href="([^"]*)"') -> DataFrame:
    """(key, number, link) for the links of each document, numbered from 1."""
    found = F.posexplode(F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1)))
    return documents.select(key, found.alias("pos", "link")).select(key, (F.col("pos") + 1).alias("number"), "link")


def text_links(documents: DataFrame, text: str, key: str) -> DataFrame:
    """(key, number, link) for the links of rich texts as they are rendered, numbered from 1."""
    found = F.posexplode(link_texts(F.col(text)))
    return documents.select(key, found.alias("pos", "link")).select(key, (F.col("pos") + 1).alias("number"), "link")


def resolved_links(catalog: Catalog, doc_id: int, name: str, vehicle: Vehicle = Vehicle()) -> DataFrame:
    """The links of a stored text with the documents that the hotspots of their numbers lead to; a link without any has none."""
    numbered = text_links(document_text(catalog, name), "text", "id").select("number", "link")
    return numbered.join(hotspots(catalog, doc_id, vehicle), "number", "left").orderBy("number", "id")
