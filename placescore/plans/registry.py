"""Dataset and metric registries: adding a dataset or a metric means adding a record here."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

METHODOLOGY_VERSION = "3.10.0"


@dataclass(frozen=True)
class DatasetSpec:
    """One raw dataset: where its columns are and how it is scored. Lives on the driver only."""

    name: str
    kind: str  # point_count | zip_response | zip_sum | line_vertices | location_index
    columns: list[str]
    rename: dict[str, str] = field(default_factory=dict)
    date: str | None = None
    coordinates: bool = True
    entity: str | None = None
    critical: str | None = None
    value: str | None = None
    wkt: str | None = None
    filter_mode: str | None = None
    filter_column: str | None = None
    more_is_better: bool = False
    publish_score: bool = True
    trend: bool = False


_XY = {"LATITUDE": "latitude", "LONGITUDE": "longitude"}
_Xy = {"Latitude": "latitude", "Longitude": "longitude"}

# The catalogued datasets with their column names.
DATASETS = [
    DatasetSpec(
        "safety_collisions", "point_count",
        ["CRASH DATE", "LATITUDE", "LONGITUDE", "ZIP CODE", "BOROUGH", "COLLISION_ID", "ON STREET NAME",
         "NUMBER OF PEDESTRIANS INJURED", "NUMBER OF CYCLIST INJURED"],
        {"CRASH DATE": "event_date", **_XY, "ZIP CODE": "zip", "BOROUGH": "borough"}, date="event_date", trend=True,
    ),
    DatasetSpec(
        "safety_rodent", "point_count",
        ["INSPECTION_DATE", "RESULT", "LATITUDE", "LONGITUDE", "ZIP_CODE", "BOROUGH", "JOB_ID"],
        {"INSPECTION_DATE": "event_date", **_XY, "ZIP_CODE": "zip", "BOROUGH": "borough"}, date="event_date",
        filter_mode="rodent_positive", filter_column="RESULT", publish_score=False, trend=True,
    ),
    DatasetSpec(
        "safety_311", "point_count",
        ["Unique Key", "Created Date", "Problem (formerly Complaint Type)", "Problem Detail (formerly Descriptor)",
         "Latitude", "Longitude", "Incident Zip", "Borough"],
        {"Created Date": "event_date", **_Xy, "Incident Zip": "zip", "Borough": "borough"}, date="event_date",
        filter_mode="safety_311", filter_column="Problem (formerly Complaint Type)", trend=True,
    ),
    DatasetSpec(
        "safety_ems", "zip_response", ["ZIPCODE", "INCIDENT_RESPONSE_SECONDS_QY", "BOROUGH"],
        {"ZIPCODE": "zip", "INCIDENT_RESPONSE_SECONDS_QY": "response_seconds", "BOROUGH": "borough"},
        coordinates=False, value="response_seconds",
    ),
    DatasetSpec(
        "safety_fire", "zip_response", ["ZIPCODE", "INCIDENT_RESPONSE_SECONDS_QY", "INCIDENT_BOROUGH"],
        {"ZIPCODE": "zip", "INCIDENT_RESPONSE_SECONDS_QY": "response_seconds", "INCIDENT_BOROUGH": "borough"},
        coordinates=False, value="response_seconds",
    ),
    DatasetSpec(
        "amenities_restaurants", "point_count",
        ["CAMIS", "DBA", "INSPECTION DATE", "CRITICAL FLAG", "GRADE", "Latitude", "Longitude", "ZIPCODE", "BORO"],
        {"INSPECTION DATE": "event_date", **_Xy, "ZIPCODE": "zip", "BORO": "borough"}, date="event_date",
        entity="CAMIS", critical="CRITICAL FLAG", more_is_better=True, trend=True,
    ),
    DatasetSpec(
        "amenities_parks", "zip_sum", ["NAME311", "ACRES", "ZIPCODE", "BOROUGH", "WATERFRONT"],
        {"ZIPCODE": "zip", "BOROUGH": "borough", "ACRES": "value"}, coordinates=False, value="value",
        more_is_better=True,
    ),
    DatasetSpec(
        "amenities_trees", "point_count",
        ["tree_id", "created_at", "latitude", "longitude", "postcode", "borough", "status", "health"],
        {"created_at": "event_date", "postcode": "zip"}, date="event_date", filter_mode="alive_tree",
        filter_column="status", more_is_better=True, trend=True,
    ),
    DatasetSpec(
        "amenities_linknyc", "point_count",
        ["Site ID", "Street Address", "Installation Status", "Latitude", "Longitude", "Postcode", "Borough"],
        {**_Xy, "Postcode": "zip", "Borough": "borough"}, filter_mode="live_linknyc",
        filter_column="Installation Status", more_is_better=True,
    ),
    DatasetSpec(
        "amenities_toilets", "point_count", ["Facility Name", "Status", "Latitude", "Longitude"], dict(_Xy),
        filter_mode="operational_toilet", filter_column="Status", more_is_better=True,
    ),
    DatasetSpec(
        "amenities_facilities", "point_count",
        ["uid", "facname", "facgroup", "facsubgrp", "zipcode", "boro", "latitude", "longitude"],
        {"zipcode": "zip", "boro": "borough"}, more_is_better=True,
    ),
    DatasetSpec(
        "transit_subway", "point_count", ["Stop Name", "Entrance Latitude", "Entrance Longitude", "Borough"],
        {"Entrance Latitude": "latitude", "Entrance Longitude": "longitude", "Borough": "borough"},
        more_is_better=True,
    ),
    DatasetSpec(
        "transit_bus", "point_count", ["Shelter_ID", "On_Street", "Cross_Stre", "Latitude", "Longitude", "BoroName"],
        {**_Xy, "BoroName": "borough"}, more_is_better=True,
    ),
    DatasetSpec(
        "transit_bike_routes", "line_vertices", ["the_geom", "segmentid", "status", "street", "boro", "allclasses"],
        wkt="the_geom", filter_mode="current_bike_route", filter_column="status", more_is_better=True,
    ),
    DatasetSpec("transit_open_streets", "line_vertices", ["the_geom", "appronstre"], wkt="the_geom", more_is_better=True),
    DatasetSpec(
        "building_violations", "point_count",
        ["ViolationID", "InspectionDate", "Class", "ViolationStatus", "Latitude", "Longitude", "Postcode", "Borough"],
        {"InspectionDate": "event_date", **_Xy, "Postcode": "zip", "Borough": "borough"}, date="event_date",
        filter_mode="open_violations", filter_column="ViolationStatus", trend=True,
    ),
    DatasetSpec(
        "building_aep", "point_count",
        ["AEP_START_DATE", "CURRENT_STATUS", "Latitude", "Longitude", "Postcode", "Borough"],
        {"AEP_START_DATE": "event_date", **_Xy, "Postcode": "zip", "Borough": "borough"}, date="event_date",
        filter_mode="active_aep", filter_column="CURRENT_STATUS",
    ),
    DatasetSpec(
        "location_pluto", "location_index",
        ["address", "borough", "postcode", "latitude", "longitude", "BBL", "appbbl"], {"postcode": "zip"},
    ),
]
DATASETS_BY_NAME = {d.name: d for d in DATASETS}

# Category weights in the overall score.
CATEGORIES = {"safety": 0.40, "transit": 0.30, "amenities": 0.30, "building": 0.0, "environment": 0.0}


@dataclass(frozen=True)
class Metric:
    id: str
    category: str
    weight: float
    higher_is_better: bool
    grain: str
    absence_means_zero: bool
    source: str
    overlaps: tuple[str, ...] = ()


# The metrics, their weight inside the category, direction, grain and absence rule.
METRICS = [
    Metric("collision", "safety", 0.3125, False, "cell", True, "safety_collisions"),
    Metric("rodent", "safety", 0.125, False, "cell", False, "safety_rodent", ("311_sanitation",)),
    Metric("311_sanitation", "safety", 0.125, False, "cell", True, "safety_311", ("rodent", "housing_violations")),
    Metric("ems_response", "safety", 0.25, False, "zip", True, "safety_ems"),
    Metric("fire_response", "safety", 0.1875, False, "zip", True, "safety_fire"),
    Metric("subway", "transit", 5 / 14, True, "cell", True, "transit_subway"),
    Metric("bus", "transit", 4 / 14, True, "cell", True, "transit_bus"),
    Metric("bike_routes", "transit", 3 / 14, True, "cell", True, "transit_bike_routes"),
    Metric("open_streets", "transit", 2 / 14, True, "cell", True, "transit_open_streets"),
    Metric("parks_access", "amenities", 0.25, True, "zip", True, "amenities_parks"),
    Metric("trees", "amenities", 0.15, True, "cell", True, "amenities_trees"),
    Metric("public_toilets", "amenities", 0.15, True, "cell", True, "amenities_toilets"),
    Metric("linknyc", "amenities", 0.10, True, "cell", True, "amenities_linknyc"),
    Metric("restaurant_context", "amenities", 0.20, True, "cell", True, "amenities_restaurants"),
    Metric("facilities", "amenities", 0.15, True, "cell", True, "amenities_facilities"),
    Metric("housing_violations", "building", 0.70, False, "cell", True, "building_violations", ("311_sanitation",)),
    Metric("aep", "building", 0.30, False, "cell", True, "building_aep"),
    Metric("nyccas_no", "environment", 1.0, False, "cell", False, "environment_no_raster"),
    Metric("heat_vulnerability", "environment", 0.0, False, "zip", False, "environment_hvi"),
]
METRICS_BY_ID = {m.id: m for m in METRICS}


def weights_of(category: str) -> dict[str, float]:
    return {m.id: m.weight for m in METRICS if m.category == category}


def overall_contribution(metric_id: str) -> float:
    m = METRICS_BY_ID[metric_id]
    return CATEGORIES[m.category] * m.weight


def overlapping_pairs() -> list[tuple[str, str]]:
    return sorted({tuple(sorted((m.id, other))) for m in METRICS for other in m.overlaps})


def check_registry() -> list[str]:
    """Problems: weights of a category not adding to one, one-sided overlaps."""
    out = []
    for c in CATEGORIES:
        total = sum(weights_of(c).values())
        if abs(total - 1.0) > 1e-9:
            out.append(f"weights of {c} add to {total}")
    for m in METRICS:
        out += [f"overlap {m.id}/{o} is one-sided" for o in m.overlaps if m.id not in METRICS_BY_ID[o].overlaps]
    return out


def metrics_table(spark: SparkSession, grain: str | None = None, ids: list[str] | None = None) -> DataFrame:
    """The registry as rows; its size is the number of records above."""
    rows = [
        (m.id, m.category, float(m.weight), m.higher_is_better, m.grain, m.absence_means_zero, m.source,
         float(CATEGORIES[m.category]), float(overall_contribution(m.id)))
        for m in METRICS
        if (grain is None or m.grain == grain) and (ids is None or m.id in ids)
    ]
    return spark.createDataFrame(
        rows,
        "metric string, category string, weight double, higher_is_better boolean, grain string, "
        "absence_means_zero boolean, source string, category_weight double, contribution double",
    )
