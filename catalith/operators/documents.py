"""Document types, listings and single documents. Every operator is lazy and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.catalog import Catalog
from catalith.functions.rtf.columns import render_html
from catalith.functions.scalars import CODE, TYPED_CODE, code_prefix, latin1
from catalith.plans.applicability import Vehicle, applicable
from catalith.schemas import ENABLED, PUBLIC, SCHEMAS

LISTED = ["id", "code", "doc_type_id", "title", "published", "sort"]
ANY_VEHICLE = Vehicle()


def doc_types(catalog: Catalog, doc_type_id: int | None = None) -> DataFrame:
    """Enabled types in their order; a single type by id whether enabled or not."""
    t = catalog.table("doc_type").withColumn("code_prefix", code_prefix(F.col("id")))
    if doc_type_id is not None:
        return t.where(F.col("id") == doc_type_id).orderBy("code").limit(1)
    return t.where(F.col("enabled") == ENABLED).orderBy("sort", "id")


def listing(catalog: Catalog, documents: DataFrame, vehicle: Vehicle, columns: list[str] = LISTED) -> DataFrame:
    """Enabled documents that apply to a vehicle, each once, by sort and title."""
    rows = documents.where(F.col("enabled") == ENABLED).select(*columns)
    order = [c for c in ("sort", "title", "id") if c in columns]
    return applicable(rows, catalog.table("applicability"), vehicle).orderBy(*order)


def _bridged(catalog: Catalog, bridge: DataFrame, node_id: int) -> DataFrame:
    ids = bridge.where((F.col("node_id") == node_id) & (F.col("security") == PUBLIC)).select(F.col("doc_id").alias("id"))
    return catalog.table("document").join(ids, "id", "left_semi")


def documents_by_node(catalog: Catalog, doc_type_id: int, node_id: int, vehicle: Vehicle = ANY_VEHICLE) -> DataFrame:
    """Documents of a navigation node; none if the type has no bridge table."""
    bridge = catalog.partition("node_document", doc_type_id)
    if bridge is None:
        bridge = catalog.spark.createDataFrame([], SCHEMAS["node_document"])
    return listing(catalog, _bridged(catalog, bridge, node_id), vehicle)


def documents_by_type(catalog: Catalog, doc_type_id: int, vehicle: Vehicle = ANY_VEHICLE) -> DataFrame:
    """All documents of a type; there is no bridge here, so no security filter."""
    return listing(catalog, catalog.table("document").where(F.col("doc_type_id") == doc_type_id), vehicle)


def symptom_documents(catalog: Catalog, node_id: int, vehicle: Vehicle = ANY_VEHICLE) -> DataFrame:
    return listing(catalog, _bridged(catalog, catalog.table("symptom_document"), node_id), vehicle.reduced())


def document_by_code(catalog: Catalog, code: str, vehicle: Vehicle = ANY_VEHICLE, doc_type_id: int | None = None) -> DataFrame:
    """Documents with exactly this code, optionally of one type. Raises ValueError for a malformed code."""
    import re

    code = code.strip()
    if not re.fullmatch(CODE if doc_type_id is None else TYPED_CODE, code):
        raise ValueError("malformed document code")
    found = catalog.table("document").where(F.col("code") == code)
    if doc_type_id is not None:
        found = found.where(F.col("doc_type_id") == doc_type_id)
    return listing(catalog, found, vehicle.reduced())


def document(catalog: Catalog, doc_id: int) -> DataFrame:
    """One document with its files, whether enabled or not."""
    rows = catalog.table("document").where(F.col("id") == doc_id).orderBy("doc_type_id", "security").limit(1)
    files = catalog.table("document_file").where(F.col("doc_id") == doc_id)
    name = F.concat("file_name", F.lit(".rtf"))
    entry = F.struct("file_name", "device_type", "device_code", name.alias("text_path"), F.concat(F.lit("/api/docs/"), name).alias("text_url"))
    files = files.groupBy(F.col("doc_id").alias("id")).agg(F.sort_array(F.collect_list(entry)).alias("files"))
    return rows.join(files, "id", "left").select("id", "code", "doc_type_id", "title", "published", "security", F.coalesce("files", F.array().cast(files.schema["files"].dataType)).alias("files"))


def related_documents(catalog: Catalog, doc_id: int, vehicle: Vehicle = ANY_VEHICLE) -> DataFrame:
    """Documents that a document refers to, by type code and title."""
    refs = catalog.table("document_ref").where((F.col("source_id") == doc_id) & (F.col("enabled") == ENABLED)).select(F.col("target_id").alias("id"))
    types = catalog.table("doc_type").select(F.col("id").alias("doc_type_id"), F.col("code").alias("type_code"), F.col("name").alias("type_name"))
    rows = catalog.table("document").where(F.col("enabled") == ENABLED).join(refs, "id", "left_semi").join(types, "doc_type_id")
    rows = rows.select("id", "code", "doc_type_id", "title", "published", "type_code", "type_name")
    return applicable(rows, catalog.table("applicability"), vehicle.reduced()).orderBy("type_code", "title", "id")


def document_text(catalog: Catalog, name: str) -> DataFrame:
    """The text of a stored document; ids are upper case, bytes Latin-1."""
    found = catalog.lookup("doc_blob", "id", name.upper())
    return found.select("id", latin1(F.col("data")).alias("text"))


def document_html(catalog: Catalog, name: str, marks: dict[str, str] | None = None, image_base: str = "/api/images") -> DataFrame:
    """The text of a stored document as HTML, with a vehicle's values for its marks."""
    return document_text(catalog, name).select("id", render_html(F.col("text"), marks, image_base).alias("html"))


def image(catalog: Catalog, name: str) -> DataFrame:
    found = catalog.lookup("image_blob", "id", name.upper())
    return found.select("id", F.coalesce(F.nullif("content_type", F.lit("")), F.lit("image/png")).alias("content_type"), "data")
