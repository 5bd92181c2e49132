"""Symptom trees: levels, whole subtrees, assembly and search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.catalog import Catalog
from catalith.plans.applicability import Vehicle, applicable_nodes
from catalith.plans.stored import stored
from catalith.schemas import ENABLED, SYMPTOM_PARENT, SYMPTOM_PATH


def path_nodes(catalog: Catalog) -> DataFrame:
    """The enabled nodes of the symptom path."""
    nodes = catalog.table("path_node").where((F.col("path_id") == SYMPTOM_PATH) & (F.col("enabled") == ENABLED))
    return nodes.select("node_id", "parent_id", "code", "name", "sort")


def _with_children(nodes: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """has_children, whatever vehicle the nodes were chosen by."""
    parents = all_nodes.select(F.col("parent_id").alias("node_id"), F.lit(True).alias("_is_parent")).distinct()
    return nodes.join(parents, "node_id", "left").withColumn("has_children", F.coalesce("_is_parent", F.lit(False))).drop("_is_parent")


def _applicable(catalog: Catalog, nodes: DataFrame, vehicle: Vehicle) -> DataFrame:
    """With a vehicle, nodes need a row that fits; symptoms have no rows for all vehicles."""
    if not vehicle.known:
        return nodes
    return applicable_nodes(nodes, catalog.table("symptom_applicability").where(F.col("path_id") == SYMPTOM_PATH), vehicle)


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("node_id").alias("id"), "code", "name", "parent_id", "has_children", "sort").distinct().orderBy("sort", "id")


def symptom_roots(catalog: Catalog) -> DataFrame:
    rows = path_nodes(catalog).where(F.col("parent_id") == SYMPTOM_PARENT)
    return rows.select(F.col("node_id").alias("id"), "code", "name", "parent_id", "sort").distinct().orderBy("sort", "id").drop("sort")


def symptom_nodes(catalog: Catalog, parent_id: int, vehicle: Vehicle = Vehicle()) -> DataFrame:
    nodes = path_nodes(catalog)
    level = _applicable(catalog, nodes.where(F.col("parent_id") == parent_id), vehicle)
    return _shown(_with_children(level, nodes)).drop("sort")


def _walk(start: DataFrame, step) -> DataFrame:
    """All rows reached from `start` by `step`, with set semantics: a frontier holds rows not seen before, so cycles end it, and
    no number of rows or levels does. Only frontiers are stored, each once."""
    seen = frontier = stored(start.distinct(), "frontier")
    while not frontier.isEmpty():
        frontier = stored(step(frontier).distinct().exceptAll(seen), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def descendants(nodes: DataFrame, root_id: int) -> DataFrame:
    """All rows of `nodes` (node_id, parent_id, ...) below a node, each once."""

    def children(frontier: DataFrame) -> DataFrame:
        return nodes.join(frontier.select(F.col("node_id").alias("parent_id")).distinct(), "parent_id", "left_semi").select(*nodes.columns)

    return _walk(nodes.where(F.col("parent_id") == root_id), children)


def symptom_tree(catalog: Catalog, root_id: int, vehicle: Vehicle = Vehicle()) -> DataFrame:
    """Everything below a root. With a vehicle each node on the way must fit, so the nodes are filtered first."""
    nodes = path_nodes(catalog)
    return _shown(_with_children(descendants(_applicable(catalog, nodes, vehicle), root_id), nodes))


def assemble(tree: DataFrame) -> DataFrame:
    """Children by parent, in order: one row per parent with an array."""
    child = F.struct("sort", "id", "code", "name", "has_children")
    return tree.groupBy("parent_id").agg(F.sort_array(F.collect_list(child)).alias("children"))


def search_tree(tree: DataFrame, term: str) -> DataFrame:
    """The nodes whose name contains the term and their ancestors, with `expanded`: a kept node below it."""
    term = term.strip().lower()
    if not term:
        return tree.withColumn("expanded", F.lit(False))
    tree = stored(tree, "tree")
    edges = tree.select("id", "parent_id")

    def parents(frontier: DataFrame) -> DataFrame:
        return edges.join(frontier.select(F.col("parent_id").alias("id")).distinct(), "id", "left_semi")

    kept = _walk(tree.where(F.contains(F.lower("name"), F.lit(term))).select("id", "parent_id"), parents)
    above = kept.select(F.col("parent_id").alias("id"), F.lit(True).alias("_up")).distinct()
    rows = tree.join(kept.select("id").distinct(), "id", "left_semi").join(above, "id", "left")
    return rows.withColumn("expanded", F.coalesce("_up", F.lit(False))).drop("_up").select(*tree.columns, "expanded")
