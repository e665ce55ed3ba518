"""What-if: what the scores of a place become when k assets are added to its cell or postal code.

The asset's count in the unit goes through the fitted curve, the curve's marginal effect moves the unit's real score, the
unit is put back into the mean its sub-score is, and category and overall scores are computed anew from the substituted
sub-score. All targets and assets are answered together: one join with the disks gives the baselines and the parts of the
means, and a row per (target, asset) carries the substitution through the same composite.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placescore.functions import cells
from placescore.functions.score import curve_lookup
from placescore.operators import spatial
from placescore.plans.composite import composite

WEAK_FIT = 0.7


@dataclass(frozen=True)
class Asset:
    """What is added, and the sub-score it moves; ``grain`` is the unit that is scored, cell or zip."""

    name: str
    category: str
    metric: str
    grain: str = "cell"


def local_parts(targets: DataFrame, by_cell: DataFrame, by_zip: DataFrame, radius_m: float) -> DataFrame:
    """(target_id, asset, mean, others, n, unit_score, unit_count): the mean a sub-score is, taken apart.

    ``targets`` has target_id, lat, lon, zip; ``by_cell`` (asset, cell, count, score); ``by_zip`` (asset, zip, count, score). A
    postal code has no peers: its mean is its own score.
    """
    own = targets.withColumn("own_cell", cells.cell(F.col("lat"), F.col("lon")))
    disk = spatial.cells_within(own, radius_m).join(own.select("target_id", "own_cell"), "target_id")
    columns = ["target_id", "asset", "mine", "count", "score"]
    near = disk.join(by_cell, "cell").withColumn("mine", F.col("cell") == F.col("own_cell")).select(*columns)
    zips = targets.select("target_id", "zip").join(by_zip, "zip").withColumn("mine", F.lit(True)).select(*columns)
    mine = F.col("mine")
    return near.unionByName(zips).groupBy("target_id", "asset").agg(
        F.avg("score").alias("mean"),
        F.coalesce(F.sum(F.when(~mine, F.col("score"))), F.lit(0.0)).alias("others"),
        F.count(F.when(~mine, F.col("score"))).alias("n"),
        F.max(F.when(mine, F.col("score"))).alias("unit_score"),
        F.max(F.when(mine, F.col("count"))).alias("unit_count"),
    )


def sub_scores(parts: DataFrame, metrics: Mapping[str, str]) -> DataFrame:
    """One row per target with a column per metric; ``metrics`` maps metric to asset."""
    value = F.bround("mean", 0).cast("int")
    return parts.groupBy("target_id").agg(*[F.max(F.when(F.col("asset") == asset, value)).alias(metric) for metric, asset in metrics.items()])


def projected_parts(targets: DataFrame, parts: DataFrame, fits: DataFrame, assets: Sequence[Asset], k: int) -> DataFrame:
    """A row per (target, asset) with counts and unit and sub-score before and after, and a status.

    ``no_unit``: the target has no postal code and the asset is scored by it. ``no_curve``: nothing is fitted for the asset.
    """
    named = F.array(*[F.struct(F.lit(a.name).alias("asset"), F.lit(a.grain).alias("grain"), F.lit(a.metric).alias("metric")) for a in assets])
    rows = targets.select("target_id", "zip", F.explode(named).alias("a")).select("target_id", "zip", "a.*")
    curves = fits.where("available").select("asset", "curve", "slope", "rho")
    rows = rows.join(parts, ["target_id", "asset"], "left").join(F.broadcast(curves), "asset", "left")  # a row per asset
    before = F.coalesce("unit_count", F.lit(0.0)).cast("double")
    now, later = (curve_lookup(F.col("curve"), F.col("slope"), before + float(x)) for x in (0, k))
    status = F.when((F.col("grain") == "zip") & F.col("zip").isNull(), "no_unit").when(F.col("curve").isNull(), "no_curve").otherwise("ok")
    moved = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("unit_score") + later - now))
    unit = F.when(status == "ok", F.when(F.col("unit_score").isNull(), later).otherwise(moved))
    after = (F.coalesce("others", F.lit(0.0)) + unit) / (F.coalesce("n", F.lit(0)) + 1)
    return rows.select(
        "target_id",
        "asset",
        "metric",
        status.alias("status"),
        before.alias("count_before"),
        (before + float(k)).alias("count_after"),
        F.col("unit_score").alias("unit_before"),
        F.round(unit, 2).alias("unit_after"),
        F.bround("mean", 0).cast("int").alias("sub_before"),
        F.bround(after, 0).cast("int").alias("sub_after"),
        (F.coalesce("rho", F.lit(1.0)) < WEAK_FIT).alias("weak_fit"),
    )


def what_if(
    targets: DataFrame,
    by_cell: DataFrame,
    by_zip: DataFrame,
    fits: DataFrame,
    assets: Sequence[Asset],
    metrics: Mapping[str, str],
    weights: Mapping[str, Mapping[str, float]],
    overall: Mapping[str, float],
    k: int,
    radius_m: float,
) -> DataFrame:
    """A row per (target, asset): status, the unit and sub-score before and after, every category and overall score before,
    after and their difference.

    ``metrics`` maps every metric of ``weights`` that is known to the asset its scores come from. Without a projection the
    scores after are those before and the differences are NULL.
    """
    parts = local_parts(targets, by_cell, by_zip, radius_m)
    base = targets.select("target_id").join(sub_scores(parts, metrics), "target_id", "left")
    rows = projected_parts(targets, parts, fits, assets, k)

    def scored(df: DataFrame, names: Mapping[str, Column], prefix: str, keep: Sequence[str]) -> DataFrame:
        ready = {c: {m: names[m] for m in w if m in names} for c, w in weights.items()}
        done = composite(df, ready, {}, weights, overall)
        keys = [*weights, "overall"]
        return done.select(*keep, *[F.col(f"{c}_score").alias(f"{c}_{prefix}") for c in keys])

    before = scored(base, {m: F.col(m) for m in metrics}, "before", ["target_id", *metrics])
    joined = rows.join(before, "target_id")
    put = {m: F.when((F.col("metric") == m) & (F.col("status") == "ok"), F.col("sub_after")).otherwise(F.col(m)) for m in metrics}
    shown = [c for c in rows.columns if c not in ("target_id", "metric")]
    was = [c for c in before.columns if c.endswith("_before")]
    after = scored(joined, put, "after", ["target_id", *shown, *was])
    ok = F.col("status") == "ok"
    return after.withColumns({f"{c}_delta": F.when(ok, F.round(F.col(f"{c}_after") - F.col(f"{c}_before"), 2)) for c in [*weights, "overall"]})
