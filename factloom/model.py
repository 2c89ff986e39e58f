"""The data model: provenance, absences, the order of origins, schemas, and the rubric."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Origins of claims and their precedence; kinds of absence; states of a source, from good to bad.
PRECEDENCE = {"user": 120, "source_field": 100, "detail_page": 80, "text_rule": 60, "geo_provider": 55, "vision": 30}
ABSENCE = ("not_stated", "not_applicable", "contradictory")
SEVERITY = {"ok": 0, "degraded": 1, "failed": 2}

SOURCE_RECORD = T.StructType(
    [
        T.StructField("record_id", T.LongType()),
        T.StructField("listing_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("fetched_at", T.TimestampType()),
        T.StructField("payload", T.StringType()),
    ]
)
CLAIM = T.StructType(
    [
        T.StructField("claim_id", T.LongType()),
        T.StructField("listing_id", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("origin", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("evidence", T.StringType()),
        T.StructField("observed_at", T.TimestampType()),
    ]
)


def precedence(origin: Column) -> Column:
    """0 for an origin that isn't known."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in PRECEDENCE.items() for x in pair)), origin), F.lit(0))


@dataclass(frozen=True)
class Range:
    """Either eq, or bounds."""

    eq: float | None = None
    min: float | None = None
    max: float | None = None

    def __post_init__(self) -> None:
        if self.eq is not None and (self.min is not None or self.max is not None):
            raise ValueError("a range is either eq or min and max")


@dataclass(frozen=True)
class Scaled:
    """A weight by amount: rate for each hundred, at most cap in size."""

    rate: float
    cap: float


@dataclass(frozen=True)
class Landmark:
    name: str
    lat: float
    lng: float
    within_km: float
    weight: float


@dataclass(frozen=True)
class Rubric:
    """What a user asks for: hard criteria, weights, and how unknown facts count."""

    rent_max: float | None = None
    rent_min: float | None = None
    currency: str = "CAD"
    beds: Range | None = None
    baths: Range | None = None
    floor: Range | None = None
    area_min: float | None = None
    area_unit: str = "sqft"
    areas: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    require_laundry: bool = False
    require_parking: bool = False
    lease_months_min: int | None = None
    total_monthly_max: float | None = None
    available_by: str | None = None
    unknown_policy: str = "exclude"
    weights: dict[str, float | Scaled] = field(default_factory=dict)
    area_key_weights: dict[str, float] = field(default_factory=dict)
    landmark: Landmark | None = None
    unverified_penalty: float = 0.0

    def __post_init__(self) -> None:
        if self.rent_min is not None and self.rent_max is not None and self.rent_min > self.rent_max:
            raise ValueError("rent_min is above rent_max")


#: The rubric of the queries.
RUBRIC = Rubric(
    rent_max=3000.0,
    rent_min=1600.0,
    beds=Range(min=1.0, max=3.0),
    baths=Range(min=1.0),
    floor=Range(max=12.0),
    area_min=300.0,
    areas=("harbour", "midtown", "eastside"),
    exclude=("basement", "furnished_only"),
    require_laundry=True,
    require_parking=True,
    lease_months_min=6,
    total_monthly_max=3200.0,
    available_by="2024-06-30",
    unknown_policy="review",
    weights={
        "laundry.in_suite": 12.0,
        "laundry.building": 4.0,
        "floor.low": 6.0,
        "walk.score": 5.0,
        "space.den_or_solarium": 5.0,
        "amenities.gym_building": 3.0,
        "proximity.gym_nearby": 2.0,
        "proximity.grocery_nearby": 4.0,
        "density.walkable": 6.0,
        "density.sparse": -3.0,
        "parking.available": 8.0,
        "pets.allowed": 5.0,
        "photo.present": 2.0,
        "area.over_minimum": Scaled(1.5, 9.0),
        "rent.headroom": Scaled(0.5, 6.0),
    },
    area_key_weights={"harbour": 6.0, "midtown": 3.0, "old-mill": -4.0},
    landmark=Landmark("Central station", 43.65, -79.38, 5.0, 7.0),
    unverified_penalty=4.0,
)
