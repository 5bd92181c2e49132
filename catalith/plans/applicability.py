"""Which documents apply to a vehicle.

A document applies if it has a row that fits the vehicle, or one for all vehicles. As no column of those rows is
returned, that is a semi join on (for all vehicles OR fits): one pass over the applicability table and no union."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.schemas import ALL_VEHICLES, ANY_GEARBOX


@dataclass(frozen=True)
class Vehicle:
    """What is known of a vehicle. Without a series nothing is filtered, whatever else is given."""

    series: int | None = None
    model: int | None = None
    engine: int | None = None
    bodies: tuple[int, ...] = ()
    gearboxes: tuple[int, ...] = ()

    def __post_init__(self) -> None:
        for name in ("bodies", "gearboxes"):
            object.__setattr__(self, name, tuple(x for x in getattr(self, name) if x is not None))

    @property
    def known(self) -> bool:
        return self.series is not None

    def reduced(self) -> Vehicle:
        """Series, model and engine only."""
        return Vehicle(self.series, self.model, self.engine)

    def clauses(self) -> list[Column]:
        """One condition for each thing known: bodies never have a wildcard, gearbox 0 fits any."""
        out = [F.col(c) == x for c, x in (("series_id", self.series), ("model_id", self.model), ("engine_id", self.engine)) if x is not None]
        if self.bodies:
            out.append(F.col("body_id").isin(*self.bodies))
        if self.gearboxes:
            out.append(F.col("gearbox_id").isin(*self.gearboxes, ANY_GEARBOX))
        return out

    def fits(self) -> Column:
        return reduce(lambda a, b: a & b, self.clauses(), F.lit(True))


def applicable(rows: DataFrame, applicability: DataFrame, vehicle: Vehicle, key: str = "id") -> DataFrame:
    """Rows whose document applies to the vehicle, without repeats. Without a known vehicle, all of them."""
    if vehicle.known:
        fitting = applicability.where((F.col("series_id") == ALL_VEHICLES) | vehicle.fits()).select(F.col("doc_id").alias(key))
        rows = rows.join(fitting, key, "left_semi").select(*rows.columns)
    return rows.distinct()


def applicable_nodes(nodes: DataFrame, applicability: DataFrame, vehicle: Vehicle) -> DataFrame:
    """Nodes with a row that fits series, model and engine; navigation has no rows for all vehicles."""
    fitting = applicability.where(vehicle.reduced().fits()).select("node_id")
    return nodes.join(fitting, "node_id", "left_semi").select(*nodes.columns)
