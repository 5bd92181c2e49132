"""Documented-only queries: no program of the reference runs them; they are here so that their documentation can be
tried. L-numbers follow the survey."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.catalog import Catalog
from catalith.operators.vehicle import chassis_types
from catalith.plans.applicability import Vehicle, applicable
from catalith.schemas import ALL_VEHICLES, ENABLED, GENERIC


def built_on(date: int | None) -> Column:
    """The production window holds a date; open ends hold any."""
    if date is None:
        return F.lit(True)
    return (F.coalesce("produced_from", F.lit(date)) <= date) & (F.coalesce("produced_to", F.lit(date)) >= date)


def default_type(catalog: Catalog) -> DataFrame:
    """L1: the enabled type with the lowest sort."""
    types = catalog.table("doc_type").where(F.col("enabled") == ENABLED)
    least = types.agg(F.min("sort").alias("sort"))
    return types.join(F.broadcast(least), "sort").orderBy("id").limit(1)  # one row


def chassis_lookup(catalog: Catalog, area: int, serial: int) -> DataFrame:
    """L2: type, its parts and its lead type."""
    one = catalog.spark.range(1).select(F.lit(area).cast("long").alias("area"), F.lit(serial).cast("long").alias("serial"))
    hit = chassis_types(one, catalog.table("chassis_range"), ["area", "serial"])
    return hit.join(catalog.table("vehicle_type"), "type_id").join(catalog.table("lead_type"), "type_id", "left")


def selectable_series(catalog: Catalog, doc_type_id: int | None = None) -> DataFrame:
    """L3: series on offer, for one type those its applicability names, or all if it names all vehicles."""
    rows = catalog.table("vehicle_model").select("series_id", "series_name").distinct()
    if doc_type_id is None:
        return rows.orderBy("series_name", "series_id")
    named = catalog.table("doc_type_applicability").where(F.col("doc_type_id") == doc_type_id).select("series_id").distinct()
    for_all = F.broadcast(named.where(F.col("series_id") == ALL_VEHICLES).limit(1).select(F.lit(True).alias("_all")))
    everything = rows.withColumn("_all", F.lit(True)).join(for_all, "_all", "left_semi").drop("_all")
    return rows.join(named, "series_id", "left_semi").unionByName(everything).distinct().orderBy("series_name", "series_id")


def type_details(catalog: Catalog, vehicle: Vehicle, date: int | None = None) -> DataFrame:
    """L4: enabled types that apply to a vehicle."""
    fits = catalog.table("doc_type_applicability").where(built_on(date)).withColumnRenamed("doc_type_id", "doc_id")
    return applicable(catalog.table("doc_type").where(F.col("enabled") == ENABLED), fits, vehicle).orderBy("sort", "id")


def paths(catalog: Catalog) -> DataFrame:
    """L5: enabled navigation paths."""
    return catalog.table("path").where(F.col("enabled") == ENABLED).orderBy("sort", "id")


def path_children(catalog: Catalog, path_id: int, parent_id: int, vehicle: Vehicle = Vehicle()) -> DataFrame:
    """L5: enabled generic children, by group applicability or for all vehicles."""
    nodes = catalog.table("path_node").where((F.col("path_id") == path_id) & (F.col("parent_id") == parent_id) & (F.col("enabled") == ENABLED) & (F.col("variant_value") == GENERIC))
    fits = catalog.table("group_applicability").where(F.col("path_id") == path_id).withColumnRenamed("node_id", "doc_id")
    return applicable(nodes, fits, vehicle, "node_id").orderBy("sort", "node_id")


def document_list(catalog: Catalog, doc_type_id: int, das_type: str | None = None, das_object: str | None = None, lead_type: int | None = None, max_security: int | None = None) -> DataFrame:
    """L6: documents by whichever filters are given."""
    rows = catalog.table("document").where((F.col("doc_type_id") == doc_type_id) & (F.col("enabled") == ENABLED))
    for c, x in (("das_type", das_type), ("das_object", das_object)):
        if x is not None:
            rows = rows.where(F.col(c) == x)
    if max_security is not None:
        rows = rows.where(F.col("security") <= max_security)
    if lead_type is not None:
        rows = rows.join(catalog.table("applicability").where(F.col("lead_type") == lead_type).select(F.col("doc_id").alias("id")), "id", "left_semi")
    return rows.orderBy("sort", "title", "id")


def applicability_check(catalog: Catalog, doc_id: int, vehicle: Vehicle, date: int | None = None) -> DataFrame:
    """L7: how many rows let a document apply to a vehicle built on a date."""
    return catalog.table("applicability").where((F.col("doc_id") == doc_id) & vehicle.fits() & built_on(date)).agg(F.count("*").alias("rows"))


def graphics_count(catalog: Catalog, node_id: int, vehicle: Vehicle = Vehicle()) -> DataFrame:
    """L8: documents with files below a node, over whichever tables exist."""
    docs = catalog.table("node_document").where(F.col("node_id") == node_id).select(F.col("doc_id").alias("id")).distinct()
    docs = docs.join(catalog.table("document_file").select(F.col("doc_id").alias("id")), "id", "left_semi")
    return applicable(docs, catalog.table("applicability"), vehicle).agg(F.count("*").alias("documents"))


def production_span(catalog: Catalog, vehicle: Vehicle) -> DataFrame:
    """L9: first and last production date and the number of model rows."""
    rows = catalog.table("vehicle_model").where(F.col("series_id") == vehicle.series)
    if vehicle.model is not None:
        rows = rows.where(F.col("model_id") == vehicle.model)
    return rows.agg(F.min("produced_from").alias("first"), F.max("produced_to").alias("last"), F.count("*").alias("models"))


def hotspot_targets(catalog: Catalog, doc_id: int, number: int, max_security: int) -> DataFrame:
    """L10: targets of a hotspot up to a security level, with repeats."""
    spots = catalog.table("hotspot").where((F.col("source_id") == doc_id) & (F.col("number") == number))
    return spots.join(catalog.table("document").where(F.col("security") <= max_security), F.col("target_id") == F.col("id")).select("id", "code", "title")


def reference_count(catalog: Catalog, doc_id: int) -> DataFrame:
    """L11: references that lead to an enabled document."""
    refs = catalog.table("document_ref").where((F.col("source_id") == doc_id) & (F.col("enabled") == ENABLED))
    return refs.join(catalog.table("document").where(F.col("enabled") == ENABLED), F.col("target_id") == F.col("id"), "left_semi").agg(F.count("*").alias("links"))


def collect_applicable(catalog: Catalog, vehicle: Vehicle, view: str) -> DataFrame:
    """L12: the documents of a vehicle as a temporary view."""
    ids = catalog.table("applicability").where((F.col("series_id") == ALL_VEHICLES) | vehicle.fits()).select("doc_id").distinct()
    ids.createOrReplaceTempView(view)
    return ids


def browse_collected(catalog: Catalog, doc_type_id: int, view: str) -> DataFrame:
    """L13: a type's documents among the collected ones."""
    ids = catalog.spark.table(view).withColumnRenamed("doc_id", "id")
    return catalog.table("document").where((F.col("doc_type_id") == doc_type_id) & (F.col("enabled") == ENABLED)).join(ids, "id", "left_semi").orderBy("sort", "title", "id")


def news(catalog: Catalog, vehicle: Vehicle = Vehicle()) -> DataFrame:
    """L14: enabled news of documents that apply to a vehicle, latest first."""
    rows = catalog.table("news").where(F.col("enabled") == ENABLED).select("id", "doc_id", "doc_type_id", "published", "title", "sort")
    return applicable(rows, catalog.table("applicability"), vehicle, "doc_id").orderBy(F.desc("published"), "sort", "id")


def vehicle_actions(catalog: Catalog, area: int, serial: int) -> DataFrame:
    """L15: actions for the chassis intervals that hold a serial."""
    ids = catalog.table("chassis_document").where((F.col("area") == area) & F.lit(serial).between(F.col("serial_from"), F.col("serial_to"))).select("doc_id")
    return catalog.table("vehicle_action").where(F.col("enabled") == ENABLED).join(ids, "doc_id", "left_semi").orderBy("sort", "doc_id")
