"""Roll-ups to parent cells and zones, population denominators and the quarterly timeline."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placescore.functions import cells
from placescore.functions import score as S
from placescore.functions.clean import literal_map
from placescore.operators import ordering, polygons
from placescore.plans.registry import Metric
from placescore.session import cut_lineage


def assert_conserved(allocated: DataFrame, parents: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Source total and whether the allocated total equals it within the tolerance."""
    a = allocated.agg(F.sum("population").alias("_a"))
    p = parents.agg(F.sum("total").alias("source_total"))
    ok = F.abs(F.col("_a") - F.col("source_total")) <= F.lit(tolerance) * F.col("source_total")
    return p.join(F.broadcast(a), F.lit(True)).select("source_total", ok.alias("conserved"))


def parent_means(scores: DataFrame) -> DataFrame:
    """(cell, metric, score) to the mean per (parent cell, metric)."""
    return scores.groupBy(cells.parent(F.col("cell")).alias("parent"), "metric").agg(F.avg("score").alias("value"))


def build_overview(scores: DataFrame, metrics: Sequence[Metric], overall: Mapping[str, float]) -> DataFrame:
    """Parent tiles with a score and coverage per category and overall, from the long score table.

    Two shuffles whatever the number of metrics: cell to parent, then parent to one wide row. Postal
    metrics take no part and the remaining weights renormalise.
    """
    used = [m for m in metrics if m.grain == "cell" and m.weight > 0]
    totals: dict[str, tuple[int, float]] = {}
    for m in used:
        n, w = totals.get(m.category, (0, 0.0))
        totals[m.category] = (n + 1, w + m.weight)
    members = (
        parent_means(scores)
        .where(F.col("metric").isin([m.id for m in used]))
        .withColumns(
            {
                "category": F.element_at(literal_map({m.id: m.category for m in used}), F.col("metric")),
                "weight": F.element_at(literal_map({m.id: float(m.weight) for m in used}), F.col("metric")),
            }
        )
    )
    aggs = []
    for cat in totals:
        mine = F.col("category") == cat
        aggs += [
            F.sum(F.when(mine, F.col("value") * F.col("weight"))).alias(f"_{cat}_top"),
            F.sum(F.when(mine, F.col("weight"))).alias(f"_{cat}_w"),
            F.count_if(mine).alias(f"{cat}_coverage_n"),
        ]
    tiles = members.groupBy("parent").agg(*aggs)
    columns: dict = {}
    for cat, (n, w) in totals.items():
        columns |= {
            f"{cat}_score": F.col(f"_{cat}_top") / F.col(f"_{cat}_w"),
            f"{cat}_coverage_total": F.lit(n),
            f"{cat}_coverage_fraction": F.round(F.col(f"{cat}_coverage_n") / F.lit(n), 4),
            f"{cat}_coverage_ratio": F.round(F.coalesce(F.col(f"_{cat}_w"), F.lit(0.0)) / F.lit(w), 4),
        }
    tiles = tiles.withColumns(columns)
    known = {c: x for c, x in overall.items() if x > 0 and c in totals}
    top = sum((F.coalesce(F.col(f"{c}_score") * x, F.lit(0.0)) for c, x in known.items()), F.lit(0.0))
    bottom = sum((F.when(F.col(f"{c}_score").isNotNull(), x).otherwise(0.0) for c, x in known.items()), F.lit(0.0))
    total_n = sum(n for n, _ in totals.values())
    tiles = tiles.withColumns(
        {
            "overall_score": F.when(bottom > 0, F.bround(top / bottom, 0).cast("int")),
            "overall_coverage_n": sum((F.col(f"{c}_coverage_n") for c in totals), F.lit(0)),
            "overall_coverage_total": F.lit(total_n),
        }
    ).withColumns(
        {
            "overall_coverage_fraction": F.round(F.col("overall_coverage_n") / F.lit(total_n), 4),
            "overall_coverage_ratio": F.round(
                sum((F.col(f"{c}_coverage_ratio") * x for c, x in known.items()), F.lit(0.0)), 4
            ),
            "risk_level": S.risk_level(F.col("overall_score")),
            "lat": cells.centre_lat(F.col("parent"), cells.FINE_CELL_M * cells.PARENT_FACTOR),
            "lon": cells.centre_lon(F.col("parent"), cells.FINE_CELL_M * cells.PARENT_FACTOR),
        }
    )
    return tiles.drop(*[f"_{c}_{s}" for c in totals for s in ("top", "w")])


def build_zones(tiles: DataFrame, zones: DataFrame, prefixes: list[str]) -> DataFrame:
    """Tiles to the polygon zone holding their centre: mean scores, coverage as a ratio of sums."""
    placed = polygons.pip_join(tiles, zones, "parent").select("parent", "zone_id")
    rows = tiles.join(placed, "parent")
    aggs = [F.count(F.lit(1)).alias("cell_count")]
    for p in prefixes:
        aggs += [
            F.bround(F.avg(f"{p}_score"), 0).cast("int").alias(f"{p}_score"),
            F.sum(f"{p}_coverage_n").alias(f"{p}_coverage_n"),
            F.sum(f"{p}_coverage_total").alias(f"{p}_coverage_total"),
            F.round(F.coalesce(F.avg(f"{p}_coverage_ratio"), F.lit(0.0)), 4).alias(f"{p}_coverage_ratio"),
        ]
    grouped = rows.groupBy("zone_id").agg(*aggs)
    for p in prefixes:
        share = F.try_divide(F.col(f"{p}_coverage_n"), F.col(f"{p}_coverage_total"))
        grouped = grouped.withColumn(f"{p}_coverage_fraction", F.round(F.coalesce(share, F.lit(0.0)), 4))
    # zone attributes are joined by key; the optimizer broadcasts them when they are small enough
    return grouped.join(zones.select("zone_id", "zone_name"), "zone_id").withColumn(
        "risk_level", S.risk_level(F.col("overall_score"))
    )


def build_denominator(parents: DataFrame, polys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Population per cell with its margin, and the parent-to-cell edges behind it."""
    return polygons.allocate(parents, polygons.fill_polygons(polys))


def timeline(quarterly: DataFrame, n: int, classes: int = 4) -> DataFrame:
    """Last n quarters per parent cell; a cell of the population without rows in a quarter counts zero.

    ``quarterly`` is (cell, quarter, count). Breaks and classes are taken per quarter. The zero rows
    come from exploding each parent over the n kept quarters, so nothing is crossed.
    """
    from placescore.functions.clean import quarter_index

    q = quarterly.withColumn("_qi", quarter_index(F.col("quarter")))
    # a handful of quarters: the newest n of the distinct ones, held in one row
    kept = q.select("quarter", "_qi").distinct().orderBy(F.desc("_qi")).limit(n)
    kept_array = kept.agg(F.sort_array(F.collect_list(F.struct("_qi", "quarter"))).alias("_kept"))
    sums = (
        q.join(F.broadcast(kept.select("quarter")), "quarter", "left_semi")
        .groupBy(cells.parent(F.col("cell")).alias("parent"), "quarter")
        .agg(F.sum("count").alias("count"))
    )
    population = quarterly.select(cells.parent(F.col("cell")).alias("parent")).distinct()
    frame = population.join(F.broadcast(kept_array), F.lit(True)).select(
        "parent", F.explode(F.transform("_kept", lambda k: k["quarter"])).alias("quarter")
    )
    full = frame.join(sums, ["parent", "quarter"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    full = cut_lineage(full)
    breaks = class_breaks(full, "count", classes, by=["quarter"])
    return full.join(F.broadcast(breaks), "quarter").select(
        "parent", "quarter", "count", class_index(F.col("count"), F.col("breaks")).alias("class")
    )


def class_breaks(df: DataFrame, column: str, k: int, by: list[str] | None = None) -> DataFrame:
    """Strict quantile edges i/k, two decimals; edges not above the minimum or not increasing are dropped."""
    keys = by or []
    shares = [0.0] + [i / k for i in range(1, k)]
    q = ordering.exact_quantiles(df, column, shares, by=keys)
    raw = F.slice("quantiles", 2, k - 1)
    low = F.col("quantiles")[0]
    kept = F.filter(
        F.transform(
            raw,
            lambda v, i: F.when(
                (v > low) & F.coalesce(v > F.get(raw, i - 1), F.lit(True)), F.round(v, 2)
            ),
        ),
        lambda v: v.isNotNull(),
    )
    return q.select(*keys, kept.alias("breaks"))


def class_index(value, breaks):
    """Number of edges at or below the value."""
    return F.size(F.filter(breaks, lambda e: value >= e))


def bivariate(df: DataFrame, a: str, b: str, classes: int = 3) -> DataFrame:
    """Class of two columns at once, each by its own quantile breaks; the pair is the map legend's cell."""
    df = cut_lineage(df)
    ba = class_breaks(df, a, classes).withColumnRenamed("breaks", "_ba")
    bb = class_breaks(df, b, classes).withColumnRenamed("breaks", "_bb")
    joined = df.join(F.broadcast(ba), F.lit(True)).join(F.broadcast(bb), F.lit(True))
    return joined.withColumns(
        {"class_a": class_index(F.col(a), F.col("_ba")), "class_b": class_index(F.col(b), F.col("_bb"))}
    ).withColumn("class", F.col("class_a") * classes + F.col("class_b")).drop("_ba", "_bb")
