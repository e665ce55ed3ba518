"""Walk graph hygiene and reachability from many targets at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placescore.functions import cells
from placescore.operators import spatial
from placescore.session import cut_lineage

WALK_SPEED_M_S = 1.33
SEARCH_STRETCH = 1.45
MIN_NODES = 4


def clean_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes once each; edges with a positive length, both ends known, parallels reduced to the shortest."""
    ok = nodes.where(F.col("node_id").isNotNull() & cells.valid_coord(F.col("lat"), F.col("lon")))
    unique = ok.groupBy("node_id").agg(F.min(F.struct("lat", "lon")).alias("_p")).select("node_id", "_p.lat", "_p.lon")
    ids = unique.select("node_id")
    kept = (
        edges.where((F.col("length_m") > 0) & F.col("u").isNotNull() & F.col("v").isNotNull())
        .join(ids.withColumnRenamed("node_id", "u"), "u", "left_semi")
        .join(ids.withColumnRenamed("node_id", "v"), "v", "left_semi")
        .groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .agg(F.min("length_m").alias("length_m"))
    )
    return unique, kept


def reachable(targets: DataFrame, nodes: DataFrame, edges: DataFrame, minutes: float, max_rounds: int = 10000) -> DataFrame:
    """(target, node, distance) along edges within the walking budget, from the nearest node of each target.

    A frontier of improved (target, node) pairs is relaxed with one join and one minimum per round; the
    budget prunes every row beyond reach. State and frontier are checkpointed every round, so a lost
    executor costs one round. Nodes outside 1.45 times the budget as the crow flies take no part.
    Targets reaching fewer than four nodes are left out.
    """
    budget = minutes * 60.0 * WALK_SPEED_M_S
    both = (
        edges.select("u", "v", "length_m")
        .unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "length_m"))
        .where(F.col("length_m") <= budget)
        .groupBy("u", "v")
        .agg(F.min("length_m").alias("length_m"))
    )
    snap = spatial.nearest_join(targets, nodes, "node_id", max_m=budget * SEARCH_STRETCH, degrees=False)
    start = snap.where(F.col("node_id").isNotNull()).select("target_id", F.col("node_id").alias("node"), F.lit(0.0).alias("dist"))
    box = targets.select("target_id", F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"))
    spots = nodes.select(F.col("node_id").alias("v"), F.col("lat").alias("v_lat"), F.col("lon").alias("v_lon"))
    # edges stay partitioned by their start for all rounds; only the frontier moves
    both = cut_lineage(both.join(spots, "v").repartition("u"))
    reach = budget * SEARCH_STRETCH
    near = (F.abs(F.col("v_lat") - F.col("t_lat")) * cells.METRES_PER_DEGREE <= reach) & (
        F.abs(F.col("v_lon") - F.col("t_lon")) * cells.METRES_PER_DEGREE * cells.COS_LAT <= reach
    )
    best = cut_lineage(start.join(box, "target_id"))
    frontier = best
    for _ in range(max_rounds):
        step = (
            frontier.join(both, frontier.node == both.u)
            .withColumn("next", F.col("dist") + F.col("length_m"))
            .where((F.col("next") <= budget) & near)
            .groupBy("target_id", F.col("v").alias("node"))
            .agg(F.min("next").alias("dist"), F.first("t_lat").alias("t_lat"), F.first("t_lon").alias("t_lon"))
        )
        merged = (
            best.select("*", F.lit(0).alias("_new"))
            .unionByName(step.select("*", F.lit(1).alias("_new")))
            .groupBy("target_id", "node")
            .agg(F.min(F.struct("dist", "_new")).alias("_b"), F.first("t_lat").alias("t_lat"), F.first("t_lon").alias("t_lon"))
            .select("target_id", "node", F.col("_b.dist").alias("dist"), "t_lat", "t_lon", F.col("_b._new").alias("_new"))
        )
        state = cut_lineage(merged)
        frontier = state.where("_new = 1").drop("_new")
        best = state.drop("_new")
        if frontier.isEmpty():
            break
    else:
        raise RuntimeError("reachability did not settle")
    enough = best.groupBy("target_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= MIN_NODES)
    return best.join(enough.select("target_id"), "target_id", "left_semi").select("target_id", "node", "dist")


def reach_summary(reached: DataFrame) -> DataFrame:
    return reached.groupBy("target_id").agg(
        F.count(F.lit(1)).alias("nodes"), F.round(F.max("dist"), 4).alias("farthest_m")
    )


def _hull(pts):
    """Convex hull of an (n, 2) array by a monotone chain, counter-clockwise."""
    import numpy as np

    p = np.unique(pts, axis=0)
    if len(p) < 3:
        return p

    def chain(rows):
        out: list = []
        for r in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (r[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (r[0] - out[-2][0]):
                out.pop()
            out.append(r)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def hull_area(reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """Convex-hull area in square kilometres of the nodes each target reaches.

    Hulls merge: every Arrow batch is first reduced to its hull per target, so what meets per target is
    a few hull vertices and never its whole node set.
    """
    at = reached.join(nodes.select(F.col("node_id").alias("node"), "lat", "lon"), "node").select(
        F.col("target_id").cast("bigint").alias("target_id"),
        cells.metres_x(F.col("lon")).alias("x"),
        cells.metres_y(F.col("lat")).alias("y"),
    )

    def partial(batches):
        import pandas as pd

        for batch in batches:
            for key, rows in batch.groupby("target_id"):
                h = _hull(rows[["x", "y"]].to_numpy())
                yield pd.DataFrame({"target_id": key, "x": h[:, 0], "y": h[:, 1]})

    def area(key, rows):
        import numpy as np
        import pandas as pd

        h = _hull(rows[["x", "y"]].to_numpy())
        x, y = h[:, 0], h[:, 1]
        size = abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2.0 if len(h) > 2 else 0.0
        return pd.DataFrame({"target_id": [key[0]], "area_km2": [size / 1e6]})

    schema = "target_id bigint, x double, y double"
    corners = at.mapInPandas(partial, schema)
    return corners.groupBy("target_id").applyInPandas(area, "target_id bigint, area_km2 double")
