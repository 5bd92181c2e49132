"""Navigation groups of a document type, and the variant filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.catalog import Catalog
from catalith.plans.applicability import Vehicle, applicable_nodes
from catalith.schemas import ENABLED, GENERIC, METHOD_FLAT, ROOT_GROUP, SCHEMAS, VARIANT_BODY, VARIANT_ENGINE, VARIANT_GEARBOX, VARIANT_NONE


class NotFound(LookupError):
    """The document type, or any node table for it, does not exist."""


def filter_variants(nodes: DataFrame, vehicle: Vehicle) -> DataFrame:
    """Of the variants of a code and kind, those of the vehicle; failing that, the generic ones.

    Rows without a kind, and of an unknown kind, stay. Kinds for which no ids are given keep their generic rows, or all
    rows if they have none. Without any ids the input comes back as it is."""
    ids = {VARIANT_ENGINE: [vehicle.engine] if vehicle.engine is not None else [], VARIANT_BODY: list(vehicle.bodies), VARIANT_GEARBOX: list(vehicle.gearboxes)}
    if not any(ids.values()):
        return nodes
    kind, value = F.col("variant_kind"), F.col("variant_value")
    group = Window.partitionBy(F.coalesce("code", F.lit("null")), "variant_kind")

    def any_of(c: Column) -> Column:
        return F.max(F.coalesce(c, F.lit(False)).cast("int")).over(group) == 1

    hit, asked = F.lit(False), F.lit(False)
    for k, given in ids.items():
        if given:
            hit = hit | ((kind == k) & (value > GENERIC) & value.isin(*given))
            asked = asked | (kind == k)
    generic = value == GENERIC
    free = (kind == VARIANT_NONE) | ~kind.isin(*ids)
    marked = nodes.withColumn("_hit", F.coalesce(hit, F.lit(False))).withColumn("_any_hit", any_of(hit)).withColumn("_any_generic", any_of(generic))
    keep = free | (~asked & (generic | ~F.col("_any_generic"))) | (asked & (F.col("_hit") | (~F.col("_any_hit") & generic)))
    kept = marked.where(keep).drop("_hit", "_any_hit", "_any_generic")
    return kept.orderBy(F.coalesce("code", F.lit("")), "variant_kind", "variant_value", "id")


def _level(nodes: DataFrame, labels: DataFrame, parent_id: int) -> DataFrame:
    """The enabled children of a node, with the names of their variants; generic variants have none."""
    nodes = nodes.where((F.col("enabled") == ENABLED) & (F.col("parent_id") == parent_id))
    names = labels.select(F.col("key").alias("_key"), F.col("name").alias("variant_name"))
    rows = nodes.join(names, (F.col("variant_value") == F.col("_key")) & (F.col("variant_value") > GENERIC), "left")
    rows = rows.select(F.col("node_id").alias("id"), "code", "name", "parent_id", "variant_kind", "variant_value", "variant_name", "sort")
    return rows.distinct().orderBy("sort", "code", "variant_kind", "variant_value", "id")


def groups(catalog: Catalog, doc_type_id: int, vehicle: Vehicle | None = None, parent_id: int = ROOT_GROUP) -> DataFrame:
    """One level of a document type's navigation. Which tables it uses depends on which exist; types listed flat have
    none, and a shared tree is not filtered by vehicle."""
    vehicle = vehicle or Vehicle()
    type_ = catalog.table("doc_type").where(F.col("id") == doc_type_id).select("method", "access").first()
    if type_ is None:
        raise NotFound("document type")
    labels = catalog.table("label")
    if type_["method"] == METHOD_FLAT:
        return _level(catalog.spark.createDataFrame([], SCHEMAS["nav_node"]), labels, parent_id).drop("sort")
    nodes = catalog.partition("nav_node", doc_type_id)
    if nodes is not None:
        fits = catalog.partition("nav_applicability", doc_type_id) if vehicle.known else None
        if fits is not None:
            nodes = applicable_nodes(nodes, fits, vehicle)
    elif type_["access"]:
        nodes = catalog.table("path_node").where(F.col("path_id") == type_["access"])
    else:
        raise NotFound("group table")
    return filter_variants(_level(nodes, labels, parent_id), vehicle).drop("sort")


def group_children(catalog: Catalog, doc_type_id: int, node_id: int, vehicle: Vehicle | None = None) -> DataFrame:
    return groups(catalog, doc_type_id, vehicle, node_id)
