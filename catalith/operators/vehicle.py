"""Series, models, engines, variants and chassis numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.catalog import Catalog
from catalith.functions.scalars import vin_area, vin_serial, year
from catalith.plans.applicability import Vehicle


def _labels(catalog: Catalog, key: str, name: str) -> DataFrame:
    return catalog.table("label").select(F.col("key").alias(key), F.col("name").alias(name))


def _one_label(catalog: Catalog, key: str, name: str) -> DataFrame:
    """One label for each key: the first in order."""
    return _labels(catalog, key, name).groupBy(key).agg(F.min(name).alias(name))


def series(catalog: Catalog) -> DataFrame:
    rows = catalog.table("vehicle_model").select(F.col("series_id").alias("id"), F.col("series_name").alias("name")).distinct()
    return rows.join(_labels(catalog, "id", "code"), "id", "left").select("id", "code", "name").distinct().orderBy("name", "id", "code")


def models(catalog: Catalog, series_id: int) -> DataFrame:
    rows = catalog.table("vehicle_model").where(F.col("series_id") == series_id)
    rows = rows.groupBy(F.col("model_id").alias("id"), F.col("model_name").alias("name")).agg(F.min("produced_from").alias("produced_from"), F.max("produced_to").alias("produced_to"))
    return rows.join(_labels(catalog, "id", "code").distinct(), "id", "left").select("id", "code", "name", "produced_from", "produced_to").orderBy("name", "id", "code")


def engines(catalog: Catalog, model_id: int) -> DataFrame:
    rows = catalog.table("vehicle_type").where(F.col("model_id") == model_id).select(F.col("engine_id").alias("id")).distinct()
    return rows.join(_labels(catalog, "id", "name"), "id", "left").distinct().orderBy("name", "id")


def variants(catalog: Catalog, vehicle: Vehicle) -> DataFrame:
    """Body, gearbox and drive ids with their names, and the model years: one row.

    A name that is missing or empty is left out, so there can be fewer names than ids."""
    if not vehicle.known:
        raise ValueError("a series is required")
    kinds = ["body", "gearbox", "drive"]
    rows = catalog.table("vehicle_type").where(vehicle.reduced().fits())
    ids = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_id").alias("id")) for k in kinds])).alias("x")).select("x.*").where("id is not null").distinct()
    named = ids.join(_one_label(catalog, "id", "name"), "id", "left")
    out = named.agg(
        *[F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("id")))).alias(f"{k}_ids") for k in kinds],
        *[F.transform(F.sort_array(F.collect_list(F.when((F.col("kind") == k) & (F.col("name") != ""), F.struct("id", "name")))), lambda x: x["name"]).alias(f"{k}_names") for k in kinds],
    )
    if vehicle.model is None:
        return out.withColumn("model_year", F.lit(None).cast("string"))
    span = catalog.table("vehicle_model").where((F.col("series_id") == vehicle.series) & (F.col("model_id") == vehicle.model)).agg(F.min("produced_from").alias("a"), F.max("produced_to").alias("b"))
    text = F.when(F.coalesce("a", F.lit(0)) != 0, F.when((F.coalesce("b", F.lit(0)) != 0) & (year(F.col("a")) != year(F.col("b"))), F.concat_ws("-", year(F.col("a")), year(F.col("b")))).otherwise(year(F.col("a"))))
    return out.crossJoin(F.broadcast(span.select(text.alias("model_year"))))  # both sides have one row


BIN = 4096


def chassis_types(vins: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """For rows with area and serial, the type and production date of the range that holds the serial, both ends
    included; of several, the one with the lowest type."""
    # serials and ranges meet by bins, so a number is compared with the ranges near it only
    held = F.sequence(F.expr(f"serial_from div {BIN}"), F.expr(f"serial_to div {BIN}"))
    r = ranges.where("serial_from <= serial_to").select("area", F.explode(held).alias("bin"), "serial_from", "serial_to", "type_id", "produced")
    near = vins.withColumn("bin", F.expr(f"serial div {BIN}")).join(r, ["area", "bin"])
    hits = near.where(F.col("serial").between(F.col("serial_from"), F.col("serial_to"))).groupBy(*by).agg(F.min(F.struct("type_id", "produced")).alias("hit"))
    return hits.select(*by, "hit.type_id", "hit.produced")


def decode_vins(catalog: Catalog, vins: DataFrame, column: str = "vin") -> DataFrame:
    """Vehicles by chassis number, with names. Malformed and unknown numbers give no row."""
    rows = vins.select(F.col(column).alias("vin"), vin_area(F.col(column)).alias("area"), vin_serial(F.col(column)).alias("serial")).where("area is not null and serial is not null").distinct()
    rows = chassis_types(rows, catalog.table("chassis_range"), ["vin"]).join(catalog.table("vehicle_type").drop("equipment"), "type_id")
    models_ = catalog.table("vehicle_model")
    by_series = models_.groupBy("series_id").agg(F.min("series_name").alias("series_name"))
    by_body = models_.groupBy("series_id", "model_id", "body_id").agg(F.min("model_name").alias("with_body"))
    by_model = models_.groupBy("series_id", "model_id").agg(F.min("model_name").alias("any_body"))
    rows = rows.join(by_series, "series_id", "left").join(by_body, ["series_id", "model_id", "body_id"], "left").join(by_model, ["series_id", "model_id"], "left")
    for kind in ("engine", "body", "gearbox", "drive"):
        rows = rows.join(_one_label(catalog, f"{kind}_id", f"{kind}_name"), f"{kind}_id", "left")
    return rows.select("vin", "series_id", "series_name", "model_id", F.coalesce("with_body", "any_body").alias("model_name"), "engine_id", "engine_name", "body_id", "body_name", "gearbox_id", "gearbox_name", "drive_id", "drive_name", F.col("produced").alias("production_date"))


def lookup_vin(catalog: Catalog, vin: str) -> DataFrame:
    return decode_vins(catalog, catalog.spark.range(1).select(F.lit(vin).alias("vin")))
