"""Raw rows to index, score and quarterly tables, one lazy plan per dataset."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placescore.functions import cells, clean, text
from placescore.operators import spatial, tables
from placescore.plans.registry import DatasetSpec
from placescore.session import cut_lineage

Tables = dict[str, DataFrame]


def prepare(spec: DatasetSpec, raw: DataFrame, box: tuple[float, float, float, float] = cells.CITY_BOX) -> DataFrame:
    """Filter, rename, type, clip and index raw text rows."""
    rows = raw
    if spec.filter_mode:
        rows = rows.where(clean.named_filter(spec.filter_mode, F.col(f"`{spec.filter_column}`")))
    out = tables.project(rows, [c for c in spec.columns if c in raw.columns], spec.rename)
    if spec.coordinates and "latitude" in out.columns:
        out = tables.clip_box(out, "latitude", "longitude", box)
        out = spatial.with_cell(out, "latitude", "longitude")
    if spec.date and spec.date in out.columns:
        out = out.withColumn(spec.date, clean.parse_date(F.col(spec.date)).cast("date"))
    if "zip" in out.columns:
        out = out.withColumn("zip", clean.normalize_zip(F.col("zip")))
    if "borough" in out.columns:
        out = out.withColumn("borough", clean.normalize_borough(F.col("borough")))
    return out


def score_points(spec: DatasetSpec, indexed: DataFrame) -> DataFrame:
    critical = None
    if spec.critical:
        critical = F.upper(F.coalesce(F.col(f"`{spec.critical}`"), F.lit(""))) == "CRITICAL"
    # the ranks read the counts twice; written once, the raw rows are scanned once
    counted = cut_lineage(tables.measures_by(indexed, "cell", spec.entity, critical))
    if not spec.critical:
        return tables.percentile_score(counted, "raw_count", spec.more_is_better)
    both = tables.percentile_score(counted, "raw_count", True, "_abundance")
    both = tables.percentile_score(both, "critical_rate", False, "_quality")
    return both.withColumn("score", tables.blend(F.col("_abundance"), F.col("_quality"))).drop("_abundance", "_quality")


def build_point(spec: DatasetSpec, raw: DataFrame, as_of: Column | None = None) -> Tables:
    indexed = prepare(spec, raw)
    out = {"indexed": indexed}
    if spec.publish_score:
        out["scores"] = score_points(spec, indexed)
    if spec.trend and spec.date:
        out["quarterly"] = tables.quarterly(indexed, "cell", spec.date, as_of)
    return out


def score_zip(spec: DatasetSpec, indexed: DataFrame) -> DataFrame:
    typed = indexed.withColumn(spec.value, clean.to_float(F.col(spec.value)))
    if spec.kind == "zip_response":
        mean = tables.mean_by(typed, "zip", spec.value).withColumnRenamed("avg_value", "avg_response_seconds")
        return tables.percentile_score(cut_lineage(mean), "avg_response_seconds", False)
    return tables.percentile_score(cut_lineage(tables.sum_by(typed, "zip", spec.value)), "total_value", spec.more_is_better)


def build_zip(spec: DatasetSpec, raw: DataFrame) -> Tables:
    """Postal-code means (response times, faster is better) or sums (scored from the total)."""
    indexed = prepare(spec, raw)
    return {"indexed": indexed, "scores": score_zip(spec, indexed)}


def build_location_index(spec: DatasetSpec, raw: DataFrame) -> Tables:
    p = prepare(spec, raw)
    key = F.coalesce(*[F.col(c) for c in ("BBL", "appbbl") if c in p.columns])
    return {
        "indexed": p.withColumn("matched_address", F.col("address")).withColumn(
            "canonical_location_id", text.canonical_id(key)
        )
    }


def build_lines(spec: DatasetSpec, raw: DataFrame, box: tuple[float, float, float, float] = cells.CITY_BOX) -> Tables:
    """Vertices of line records to cells; a record counts once per cell however many vertices it has."""
    rows = raw
    if spec.filter_mode:
        rows = rows.where(clean.named_filter(spec.filter_mode, F.col(f"`{spec.filter_column}`")))
    vertices = (
        rows.withColumn("record_index", F.monotonically_increasing_id())
        .withColumn("_v", F.explode(cells.wkt_vertices(F.col(spec.wkt))))
        .withColumns({"latitude": F.col("_v.lat"), "longitude": F.col("_v.lon")})
        .drop("_v", spec.wkt)
        .where(cells.in_box(F.col("latitude"), F.col("longitude"), box))
    )
    indexed = spatial.with_cell(vertices, "latitude", "longitude")
    counted = cut_lineage(indexed.groupBy("cell").agg(F.count_distinct("record_index").alias("raw_count")))
    return {"indexed": indexed, "scores": tables.percentile_score(counted, "raw_count", True)}


BUILDERS: dict[str, Callable[[DatasetSpec, DataFrame], Tables]] = {
    "point_count": build_point,
    "zip_response": build_zip,
    "zip_sum": build_zip,
    "location_index": build_location_index,
    "line_vertices": build_lines,
}


def build(spec: DatasetSpec, raw: DataFrame) -> Tables:
    return BUILDERS[spec.kind](spec, raw)


def rescore(spec: DatasetSpec, indexed: DataFrame) -> DataFrame:
    """Scores from the published index without touching raw files; lines and locations refuse."""
    if spec.kind == "point_count":
        return score_points(spec, indexed)
    if spec.kind in ("zip_response", "zip_sum"):
        return score_zip(spec, indexed)
    raise ValueError(f"{spec.kind} cannot be rescored from its index")


def build_rate_score(events: DataFrame, positive: Column) -> DataFrame:
    """Shrunk positive rate per cell, its percentile score (lower is better) and the raw parts."""
    c = cut_lineage(
        events.where(F.col("cell").isNotNull())
        .groupBy("cell")
        .agg(F.count(F.lit(1)).alias("inspections"), F.count_if(F.coalesce(positive, F.lit(False))).alias("positives"))
    )
    s = tables.shrink(c, "positives", "inspections", "raw_count").withColumn(
        "raw_rate", F.bround(F.col("positives") / F.col("inspections"), 4)
    )
    return tables.percentile_score(s, "raw_count", False).drop("alpha", "beta")


def build_exposure_score(
    events: DataFrame, exposure: DataFrame, killed: Column, injured: Column
) -> tuple[DataFrame, DataFrame]:
    rated, lost = tables.exposure_rate(events, exposure, "cell", killed, injured)
    return tables.percentile_score(cut_lineage(rated), "rate", False), lost


def build_ordinal(rows: DataFrame, key: str, ordinal: str, top: int = 5) -> DataFrame:
    """Ordinal index (1..top, higher is worse) to 0..100 scores per five-character key; bad rows refuse."""
    from placescore.functions.score import reverse_ordinal

    checked = rows.withColumn(
        "_ok", F.coalesce(F.col(ordinal).between(1, top) & F.col(key).rlike(r"^\d{5}$"), F.lit(False))
    )
    guarded = checked.withColumn(
        ordinal, F.when(F.col("_ok"), F.col(ordinal)).otherwise(F.raise_error(F.lit("ordinal out of domain")).cast("int"))
    )
    return guarded.select(key, ordinal, F.bround(reverse_ordinal(F.col(ordinal), top), 0).cast("int").alias("score"))


def build_raster_score(polys: DataFrame, raster: DataFrame, georef: dict[str, float]) -> DataFrame:
    """Raster value at each cell centre of the region, scored (lower is better)."""
    from placescore.operators import polygons

    centres = polygons.fill_polygons(polys).select("cell").distinct().withColumns(
        {"lat": cells.centre_lat(F.col("cell")), "lon": cells.centre_lon(F.col("cell"))}
    )
    sampled = spatial.sample_raster(centres, raster, **georef).select("cell", F.col("value").alias("raw_count"))
    return tables.percentile_score(cut_lineage(sampled), "raw_count", False)
