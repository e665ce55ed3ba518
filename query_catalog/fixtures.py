"""Domain shapes derived from the given tables, once for Spark and once as SQL text.

Coordinates come from integer arithmetic on the keys, so both engines compute the same doubles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placescore.functions import cells
from placescore.operators.tables import count_by
from placescore.session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without SQL only its rows are recorded."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _bend(key: Column, factor: int, mod: int) -> Column:
    a = (key * F.lit(factor)) % F.lit(mod)
    return (a * a).cast("double") / F.lit(float(mod)) / F.lit(10000.0)


def lat_of(key: Column) -> Column:
    return F.lit(40.70) + _bend(key, 7919, 397)


def lon_of(key: Column) -> Column:
    return F.lit(-74.00) + _bend(key, 104729, 499)


def sql_bend(key: str, factor: int, mod: int) -> str:
    a = f"(({key} * {factor}) % {mod})"
    return f"CAST({a} * {a} AS DOUBLE) / {mod}::DOUBLE / 10000::DOUBLE"


def sql_lat(key: str) -> str:
    return f"(40.70::DOUBLE + {sql_bend(key, 7919, 397)})"


def sql_lon(key: str) -> str:
    return f"(-74.00::DOUBLE + {sql_bend(key, 104729, 499)})"


def sql_x(lon: str) -> str:
    return f"(({lon} - (-74.30::DOUBLE)) * 111320::DOUBLE * 0.7580107::DOUBLE)"


def sql_y(lat: str) -> str:
    return f"(({lat} - 40.45::DOUBLE) * 111320::DOUBLE)"


def sql_pack(ix: str, iy: str) -> str:
    return f"((CAST({ix} AS BIGINT) + 1048576) * 2097152 + (CAST({iy} AS BIGINT) + 1048576))"


def sql_cell(lat: str, lon: str) -> str:
    return sql_pack(f"floor({sql_x(lon)} / 300::DOUBLE)", f"floor({sql_y(lat)} / 300::DOUBLE)")


def sql_ix(cell: str) -> str:
    return f"({cell} // 2097152 - 1048576)"


def sql_iy(cell: str) -> str:
    return f"({cell} % 2097152 - 1048576)"


def sql_parent(cell: str) -> str:
    return sql_pack(f"floor({sql_ix(cell)} / 3::DOUBLE)", f"floor({sql_iy(cell)} / 3::DOUBLE)")


def sql_d2(lat_a: str, lon_a: str, lat_b: str, lon_b: str) -> str:
    dy = f"(({lat_a} - {lat_b}) * 111320::DOUBLE)"
    dx = f"(({lon_a} - {lon_b}) * 111320::DOUBLE * 0.7580107::DOUBLE)"
    return f"({dx} * {dx} + {dy} * {dy})"


def sql_hav(lat_a: str, lon_a: str, lat_b: str, lon_b: str) -> str:
    sa, so = f"sin(radians({lat_b} - {lat_a}) / 2)", f"sin(radians({lon_b} - {lon_a}) / 2)"
    return (
        f"(12742000::DOUBLE * asin(sqrt(least(1.0::DOUBLE, {sa} * {sa} + cos(radians({lat_a})) * "
        f"cos(radians({lat_b})) * {so} * {so}))))"
    )


def sql_pct(v: str, higher: bool = True, by: str = "") -> str:
    """Tie-averaged percentile score of an expression as a window expression."""
    part = f"PARTITION BY {by}" if by else ""
    both = f"PARTITION BY {by}, {v}" if by else f"PARTITION BY {v}"
    share = (
        f"((rank() OVER ({part} ORDER BY {v}) - 1) + (count(*) OVER ({both}) + 1) / 2.0::DOUBLE)"
        f" / count(*) OVER ({part}) * 100"
    )
    value = share if higher else f"100.0::DOUBLE - {share}"
    return f"CAST(least(100, greatest(0, round_even({value}, 0))) AS INTEGER)"


def sql_clamp(v: str) -> str:
    return f"CAST(least(100, greatest(0, round_even({v}, 0))) AS INTEGER)"


# ---- shapes ------------------------------------------------------------------------------------


def incidents(spark: SparkSession, sf: str) -> DataFrame:
    """Point facts with an entity, a kind and a value."""
    e = table(spark, sf, "events")
    key = F.col("event_id")
    return e.select(
        "event_id",
        F.col("user_id").alias("entity_id"),
        F.col("ts").alias("event_ts"),
        F.col("event_type").alias("kind"),
        "value",
        lat_of(key).alias("lat"),
        lon_of(key).alias("lon"),
    ).withColumn("cell", cells.cell(F.col("lat"), F.col("lon")))


INCIDENTS = f"""incidents AS (
  SELECT *, {sql_cell("lat", "lon")} AS cell FROM (
    SELECT event_id, user_id AS entity_id, ts AS event_ts, event_type AS kind, value,
           {sql_lat("event_id")} AS lat, {sql_lon("event_id")} AS lon
    FROM events))"""


def cell_counts(spark: SparkSession, sf: str, out: str = "raw_count", where: str = "true") -> DataFrame:
    """Incidents per cell, written once: rank operators read their input twice, the events only once."""
    return cut_lineage(count_by(incidents(spark, sf).where(where), "cell", out))


def targets(spark: SparkSession, sf: str) -> DataFrame:
    """Every supplier is a target location."""
    s = table(spark, sf, "supplier")
    return s.select(
        F.col("s_suppkey").alias("target_id"),
        lat_of(F.col("s_suppkey") + 13).alias("lat"),
        lon_of(F.col("s_suppkey") + 13).alias("lon"),
    )


TARGETS = f"""targets AS (
  SELECT s_suppkey AS target_id, {sql_lat("(s_suppkey + 13)")} AS lat, {sql_lon("(s_suppkey + 13)")} AS lon
  FROM supplier)"""


def places(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer is a parcel with a name and a postal code."""
    c = table(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("place_id"),
        F.col("c_name").alias("name"),
        F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("zip"),
        lat_of(F.col("c_custkey")).alias("lat"),
        lon_of(F.col("c_custkey")).alias("lon"),
    )


PLACES = f"""places AS (
  SELECT c_custkey AS place_id, c_name AS name, lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS zip,
         {sql_lat("c_custkey")} AS lat, {sql_lon("c_custkey")} AS lon
  FROM customer)"""


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """Dated facts: place = customer group, signal = order priority, class = order status."""
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("fact_id"),
        (F.col("o_custkey") % 40).alias("place"),
        F.col("o_orderdate").cast("date").alias("day"),
        F.col("o_orderpriority").alias("signal"),
        F.col("o_orderstatus").alias("class"),
        F.col("o_totalprice").alias("amount"),
    )


FACTS = """facts AS (
  SELECT o_orderkey AS fact_id, o_custkey % 40 AS place, CAST(o_orderdate AS DATE) AS day,
         o_orderpriority AS signal, o_orderstatus AS class, o_totalprice AS amount
  FROM orders)"""


def as_of(df: DataFrame, column: str) -> DataFrame:
    """One row: the latest date of a table, the reference point of every recency rule."""
    return df.agg(F.max(F.to_date(F.col(column))).alias("as_of"))


def with_as_of(df: DataFrame, column: str) -> DataFrame:
    """Attach the latest date as a one-row broadcast."""
    return df.join(F.broadcast(as_of(df, column)), F.lit(True))


# Which event kind stands in for which registered metric.
KIND_METRIC = {
    "error": "collision",
    "click": "311_sanitation",
    "view": "subway",
    "purchase": "trees",
    "signup": "linknyc",
}


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# Twelve rectangles over the incident area, one with a hole: x0, y0 step by 0.0125 / 0.0134 degrees.
ZONE_ROWS, ZONE_COLS = 3, 4
ZONE_W, ZONE_H = 0.0125, 0.0134
ZONE_X0, ZONE_Y0 = -74.0, 40.70
HOLE_ZONE = 5
HOLE_MARGIN = 0.003


def zone_boxes() -> list[tuple[int, float, float, float, float]]:
    out = []
    for i in range(ZONE_ROWS * ZONE_COLS):
        r, c = divmod(i, ZONE_COLS)
        x0, y0 = round(ZONE_X0 + c * ZONE_W, 4), round(ZONE_Y0 + r * ZONE_H, 4)
        out.append((i, x0, y0, round(x0 + ZONE_W, 4), round(y0 + ZONE_H, 4)))
    return out


def _rect(x0: float, y0: float, x1: float, y1: float) -> list[dict]:
    return [{"x": x, "y": y} for x, y in [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]


def zones(spark: SparkSession) -> DataFrame:
    rows = []
    for i, x0, y0, x1, y1 in zone_boxes():
        rings = [_rect(x0, y0, x1, y1)]
        if i == HOLE_ZONE:
            m = HOLE_MARGIN
            rings.append(_rect(round(x0 + m, 4), round(y0 + m, 4), round(x1 - m, 4), round(y1 - m, 4)))
        rows.append((i, f"zone {i}", 1000.0 + 100 * i, 50.0 + i, [rings]))
    schema = (
        "zone_id int, zone_name string, total double, moe double, "
        "shape array<array<array<struct<x:double,y:double>>>>"
    )
    return spark.createDataFrame(rows, schema)


_BOX_ROWS = ", ".join(
    f"({i}, 'zone {i}', {1000.0 + 100 * i}::DOUBLE, {50.0 + i}::DOUBLE, {x0}::DOUBLE, {y0}::DOUBLE, {x1}::DOUBLE, {y1}::DOUBLE)"
    for i, x0, y0, x1, y1 in zone_boxes()
)
ZONES = f"zones AS (SELECT * FROM (VALUES {_BOX_ROWS}) AS z(zone_id, zone_name, total, moe, x0, y0, x1, y1))"


def sql_in_zone(lat: str, lon: str) -> str:
    """Even-odd containment in the rectangles: left and lower edges are inside, right and upper are not."""
    m = HOLE_MARGIN
    hole = (
        f"(zone_id = {HOLE_ZONE} AND {lon} >= round(x0 + {m}, 4) AND {lon} < round(x1 - {m}, 4) "
        f"AND {lat} >= round(y0 + {m}, 4) AND {lat} < round(y1 - {m}, 4))"
    )
    return f"({lon} >= x0 AND {lon} < x1 AND {lat} >= y0 AND {lat} < y1 AND NOT {hole})"
