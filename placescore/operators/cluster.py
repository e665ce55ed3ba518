"""Density clusters: points to grid cells, cells to clusters, without pairing the points of a dense cell.

The grid side is eps / sqrt(2), so any two points of one cell are within eps. A cell with min_samples
points is core as a whole and needs no distances inside. Distances are only taken for points of sparse
cells (fewer than min_samples each) and for pairs of neighbouring cells, and there the points are first
reduced: copies of a coordinate become one row with a weight.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placescore.functions import cells
from placescore.session import cut_lineage

EPS_SLACK = 1e-9


def _grid(points: DataFrame, side: float) -> DataFrame:
    """One row per distinct coordinate with its weight and grid cell."""
    at = points.where(cells.valid_coord(F.col("lat"), F.col("lon"))).groupBy("lat", "lon").agg(
        F.count(F.lit(1)).alias("w")
    )
    x, y = cells.metres_x(F.col("lon")), cells.metres_y(F.col("lat"))
    return at.withColumns({"x": x, "y": y, "gx": F.floor(x / side), "gy": F.floor(y / side)}).withColumn(
        "g", cells.pack(F.col("gx"), F.col("gy"))
    )


def _around(gx: Column, gy: Column, half: bool = False) -> Column:
    """Cells whose points can lie within eps: the 5x5 block without its corners; optionally each pair once."""
    steps = [
        (dx, dy)
        for dx in range(-2, 3)
        for dy in range(-2, 3)
        if abs(dx) + abs(dy) < 4 and (not half or (dx, dy) > (0, 0))
    ]
    return F.array(*[cells.pack(gx + dx, gy + dy) for dx, dy in steps])


def _core(at: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """Rows of ``at`` that are core points."""
    sizes = at.groupBy("g").agg(F.sum("w").alias("m"))
    dense = sizes.where(F.col("m") >= min_samples).select("g")
    thin = sizes.where(F.col("m") < min_samples).select("g")
    sure = at.join(dense, "g", "left_semi")
    # fewer than min_samples askers per cell bound this join to a constant times the data
    asking = at.join(thin, "g", "left_semi").select(
        F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), F.col("x").alias("ax"), F.col("y").alias("ay"),
        F.explode(_around(F.col("gx"), F.col("gy"))).alias("g"),
    )
    held = at.select("g", "x", "y", "w")
    near = F.hypot(F.col("ax") - F.col("x"), F.col("ay") - F.col("y")) <= eps + EPS_SLACK
    counted = (
        asking.join(held, "g").where(near).groupBy("a_lat", "a_lon").agg(F.sum("w").alias("m"))
        .where(F.col("m") >= min_samples)
        .select(F.col("a_lat").alias("lat"), F.col("a_lon").alias("lon"))
    )
    return sure.unionByName(at.join(counted, ["lat", "lon"], "left_semi").select(*sure.columns))


SPLIT = 4
MAX_SPLITS = 8


def _links(core: DataFrame, eps: float, side: float) -> DataFrame:
    """Pairs of cells holding core points within eps of each other.

    Boxes of the core points decide most pairs: boxes whose far corners are within eps are linked,
    boxes further apart than eps are not. Undecided pairs are split sixteen ways and looked at again;
    what is still undecided at the end compares points of the tiny boxes left.
    """
    size = side
    level = core.select("g", "x", "y", F.col("g").alias("b"))
    boxes = _boxes(level)
    mine = boxes.select(
        F.col("g").alias("ga"), F.col("b").alias("ba"), *[F.col(c).alias(f"a{c}") for c in ("x0", "x1", "y0", "y1")],
        F.explode(_around(cells.cell_ix(F.col("g")), cells.cell_iy(F.col("g")), half=True)).alias("gb"),
    )
    theirs = boxes.select(
        F.col("g").alias("gb"), F.col("b").alias("bb"), *[F.col(c).alias(f"b{c}") for c in ("x0", "x1", "y0", "y1")]
    )
    linked, open_pairs = _decide(mine.join(theirs, "gb"), eps)
    for _ in range(MAX_SPLITS):
        open_pairs = cut_lineage(open_pairs)
        linked = cut_lineage(linked)
        if open_pairs.isEmpty():
            return linked
        size /= SPLIT
        parts = core.select("g", "x", "y", cells.cell_at(F.col("x"), F.col("y"), size).alias("b"))
        boxes = _boxes(parts)
        up = boxes.withColumn("up", cells.cell_at((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2, size * SPLIT))
        if size * SPLIT == side:
            up = up.withColumn("up", F.col("g"))
        a = up.select(F.col("g").alias("ga"), F.col("up").alias("ua"), F.col("b").alias("ba"), *[F.col(c).alias(f"a{c}") for c in ("x0", "x1", "y0", "y1")])
        b = up.select(F.col("g").alias("gb"), F.col("up").alias("ub"), F.col("b").alias("bb"), *[F.col(c).alias(f"b{c}") for c in ("x0", "x1", "y0", "y1")])
        again = (
            open_pairs.select("ga", "gb", F.col("ba").alias("ua"), F.col("bb").alias("ub"))
            .join(a, ["ga", "ua"])
            .join(b, ["gb", "ub"])
            .drop("ua", "ub")
        )
        more, open_pairs = _decide(again, eps)
        linked = linked.unionByName(more).distinct()
        open_pairs = open_pairs.join(linked, ["ga", "gb"], "left_anti")
    parts = core.select("g", "x", "y", cells.cell_at(F.col("x"), F.col("y"), size).alias("b"))
    pa = parts.select(F.col("g").alias("ga"), F.col("b").alias("ba"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    pb = parts.select(F.col("g").alias("gb"), F.col("b").alias("bb"), F.col("x").alias("bx"), F.col("y").alias("by"))
    near = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")) <= eps + EPS_SLACK
    rest = open_pairs.select("ga", "ba", "gb", "bb").join(pa, ["ga", "ba"]).join(pb, ["gb", "bb"]).where(near)
    return linked.unionByName(rest.select("ga", "gb")).distinct()


def _boxes(parts: DataFrame) -> DataFrame:
    return parts.groupBy("g", "b").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    )


def _decide(pairs: DataFrame, eps: float) -> tuple[DataFrame, DataFrame]:
    zero = F.lit(0.0)
    near = F.hypot(
        F.greatest(F.col("bx0") - F.col("ax1"), F.col("ax0") - F.col("bx1"), zero),
        F.greatest(F.col("by0") - F.col("ay1"), F.col("ay0") - F.col("by1"), zero),
    )
    far = F.hypot(
        F.greatest(F.abs(F.col("bx1") - F.col("ax0")), F.abs(F.col("ax1") - F.col("bx0"))),
        F.greatest(F.abs(F.col("by1") - F.col("ay0")), F.abs(F.col("ay1") - F.col("by0"))),
    )
    judged = pairs.withColumns({"near": near, "far": far}).where(F.col("near") <= eps + EPS_SLACK)
    yes = judged.where(F.col("far") <= eps).select("ga", "gb").distinct()
    maybe = judged.where(F.col("far") > eps).select("ga", "ba", "gb", "bb").join(yes, ["ga", "gb"], "left_anti")
    return yes, maybe


def connected_components(nodes: DataFrame, links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, label) with label the smallest node of its component.

    Alternating large-star and small-star rounds: every round only takes minima per node (merged
    map-side) and joins them back, so a hub is never gathered; the number of rounds grows with the
    logarithm of the component, not with its diameter. Each round is checkpointed.
    """
    edges = cut_lineage(
        links.select(F.col("ga").alias("u"), F.col("gb").alias("v")).where(F.col("u") != F.col("v")).distinct()
    )
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v")).distinct()
        low2 = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(low2, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low2.select("u", F.col("m").alias("v")))
            .where(F.col("u") != F.col("v"))
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .distinct()
        )
        edges = cut_lineage(small)
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == tuple(mark):
            break
        before = tuple(mark)
    else:
        raise RuntimeError("components did not settle")
    labels = edges.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")
    return nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def hotspots(points: DataFrame, eps: float = 100.0, min_samples: int = 3) -> DataFrame:
    """Points with their cluster; noise is dropped.

    Clusters are the components of the core points under distance eps, border points join the smallest
    cluster id of the core points within reach. The id is the smallest grid cell of the cluster.
    """
    side = eps / math.sqrt(2.0)
    at = cut_lineage(_grid(points, side))
    core = cut_lineage(_core(at, eps, min_samples))
    nodes = core.select(F.col("g").alias("node")).distinct()
    labels = connected_components(nodes, _links(core, eps, side))
    # in a sparse cell a core point and another core point are within eps too, so one label per cell holds
    labelled = core.join(labels.withColumnRenamed("node", "g"), "g").select("lat", "lon", "x", "y", "g", F.col("label").alias("cluster"))
    border = at.join(core.select("lat", "lon"), ["lat", "lon"], "left_anti").select(
        "lat", "lon", F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(_around(F.col("gx"), F.col("gy"))).alias("g")
    )
    near = F.hypot(F.col("ax") - F.col("x"), F.col("ay") - F.col("y")) <= eps + EPS_SLACK
    joined = (
        border.join(labelled.select("g", "x", "y", "cluster"), "g").where(near).groupBy("lat", "lon").agg(F.min("cluster").alias("cluster"))
    )
    found = labelled.select("lat", "lon", "cluster").unionByName(joined)
    return points.join(found, ["lat", "lon"])


def cluster_summary(clustered: DataFrame, kind: str = "kind") -> DataFrame:
    """Mean centre, size, largest haversine radius, counts per kind and the dominant kind."""
    mean = clustered.groupBy("cluster").agg(
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count(F.lit(1)).alias("n")
    )
    centre = mean.select("cluster", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))
    places = clustered.select("cluster", "lat", "lon").distinct()
    reach = (
        places.join(centre, "cluster")
        .groupBy("cluster")
        .agg(F.max(cells.haversine_m(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon"))).alias("radius_m"))
    )
    kinds = clustered.groupBy("cluster", kind).agg(F.count(F.lit(1)).alias("k"))
    top = kinds.groupBy("cluster").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "k")))).alias("kinds"),
        F.min_by(kind, F.struct(-F.col("k"), F.col(kind))).alias("dominant"),
    )
    return mean.join(reach, "cluster").join(top, "cluster")
