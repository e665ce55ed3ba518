"""Point in polygon, polygon fill and cell allocation.

A polygon is ``ARRAY<ARRAY<ARRAY<STRUCT<x, y>>>>`` (polygons, rings, vertices in degrees; the first ring
is the outline, the rest are holes). An edge goes to the cells it crosses and nowhere else. Whether the corner of a cell is
inside follows from the crossings further along its row, counted by parity; a point is inside when the path from it to
that corner crosses an odd or even number of the cell's own edges. Cells without edges need no test. So the work is
linear in edges and covered cells, however many vertices a polygon has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placescore.functions import cells
from placescore.operators import spatial

SHAPE = "array<array<array<struct<x:double,y:double>>>>"


def _ring_edges(ring: Column) -> Column:
    """Consecutive vertex pairs of a ring."""
    n = F.size(ring)
    return F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def edges(shape: Column) -> Column:
    """All edges of all rings; even-odd counting over them handles holes and multipolygons."""
    return F.flatten(F.transform(F.flatten(shape), _ring_edges))


def _spans(e: Column, y: Column) -> Column:
    return (e["a"]["y"] > y) != (e["b"]["y"] > y)


def _x_at(e: Column, y: Column) -> Column:
    a, b = e["a"], e["b"]
    return F.try_divide((b["x"] - a["x"]) * (y - a["y"]), b["y"] - a["y"]) + a["x"]


def crosses(x: Column, y: Column, edge_array: Column) -> Column:
    """Even-odd rule over a whole polygon: an odd number of edges to the right of the point."""
    return F.size(F.filter(edge_array, lambda e: _spans(e, y) & (x < _x_at(e, y)))) % 2 == 1


def boundary_distance_m(x: Column, y: Column, edge_array: Column) -> Column:
    """Metres from a point to the nearest edge."""
    sx, sy = cells.METRES_PER_DEGREE * cells.COS_LAT, cells.METRES_PER_DEGREE

    def one(e: Column) -> Column:
        ax, ay = (e["a"]["x"] - x) * sx, (e["a"]["y"] - y) * sy
        bx, by = (e["b"]["x"] - x) * sx, (e["b"]["y"] - y) * sy
        dx, dy = bx - ax, by - ay
        length = dx * dx + dy * dy
        t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / length))).otherwise(0.0)
        return F.hypot(ax + t * dx, ay + t * dy)

    return F.array_min(F.transform(edge_array, one))


#: Metres by which an edge reaches beyond itself, so that rounding never hides it from a cell.
REACH_M = 1e-3


def _corner(ix: Column, iy: Column, size: float) -> tuple[Column, Column]:
    """Degrees of the lower right corner of a cell, the point whose side is known for every cell."""
    return cells.lon_of((ix + 1) * size), cells.lat_of(iy * size)


def edge_cells(polys: DataFrame, zone: str = "zone_id", buffer_m: float = 0.0, size: float = cells.FINE_CELL_M) -> DataFrame:
    """(zone, edge, _ix, _iy): every edge with the cells that it, or what lies within ``buffer_m`` of it, touches."""
    e = F.col("edge")
    ends = {f"_{axis}{i}": f(e[v][axis]) for i, v in enumerate("ab") for axis, f in (("x", cells.metres_x), ("y", cells.metres_y))}
    reach = buffer_m + REACH_M
    rows = polys.select(zone, F.explode(edges(F.col("shape"))).alias("edge")).withColumns(ends)
    low, high = F.least("_y0", "_y1"), F.greatest("_y0", "_y1")
    rows = rows.withColumn("_iy", F.explode(F.sequence(F.floor((low - reach) / size), F.floor((high + reach) / size))))
    dy = F.col("_y1") - F.col("_y0")

    def x_near(y: Column) -> Column:
        """x where the edge meets a height, or its end beyond that."""
        part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(y - F.col("_y0"), dy)))
        return F.col("_x0") + part * (F.col("_x1") - F.col("_x0"))

    below, above = F.col("_iy") * size - reach, (F.col("_iy") + 1) * size + reach
    left = F.when(dy == 0, F.least("_x0", "_x1")).otherwise(F.least(x_near(below), x_near(above)))
    right = F.when(dy == 0, F.greatest("_x0", "_x1")).otherwise(F.greatest(x_near(below), x_near(above)))
    return rows.withColumn("_ix", F.explode(F.sequence(F.floor((left - reach) / size), F.floor((right + reach) / size)))).select(zone, "edge", "_ix", "_iy")


def cell_index(polys: DataFrame, zone: str = "zone_id", size: float = cells.FINE_CELL_M) -> DataFrame:
    """(zone, cell, edges, corner_in): the cells a polygon covers or cuts. Cells wholly inside have NULL edges."""
    e = F.col("edge")
    corner_x, corner_y = _corner(F.col("_ix"), F.col("_iy"), size)
    at = _x_at(e, corner_y)
    left_x = cells.lon_of(F.col("_ix") * size)
    # the bottom line of the row meets the edge in this cell: right of the left corner, not right of the right one
    toggles = _spans(e, corner_y) & (left_x < at) & ~(corner_x < at)
    cut = edge_cells(polys, zone, 0.0, size).groupBy(zone, "_iy", "_ix").agg(F.collect_list("edge").alias("edges"), F.count_if(toggles).alias("_t"))
    row = Window.partitionBy(zone, "_iy").orderBy(F.desc("_ix"))
    beyond = F.coalesce(F.sum("_t").over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seen = cut.withColumns({"_beyond": beyond, "_next": F.lead("_ix").over(row)})
    own = seen.select(zone, "_ix", "_iy", "edges", (F.col("_beyond") % 2 == 1).alias("corner_in"))
    run = F.when(((F.col("_beyond") + F.col("_t")) % 2 == 1) & (F.col("_next") < F.col("_ix") - 1), F.sequence(F.col("_next") + 1, F.col("_ix") - 1))
    whole = seen.select(zone, F.explode(run).alias("_ix"), "_iy").withColumns({"edges": F.lit(None).cast(own.schema["edges"].dataType), "corner_in": F.lit(True)})
    return own.unionByName(whole).select(zone, cells.pack(F.col("_ix"), F.col("_iy")).alias("cell"), "edges", "corner_in")


def inside_cell(x: Column, y: Column, size: float = cells.FINE_CELL_M) -> Column:
    """Whether a point is inside, given its cell's row of :func:`cell_index`: along the row to the right border, then down to the corner."""
    right, bottom = _corner(cells.cell_ix(F.col("cell")), cells.cell_iy(F.col("cell")), size)

    def flips(e: Column) -> Column:
        a, b = e["a"], e["b"]
        along = _spans(e, y) & ((x < _x_at(e, y)) != (right < _x_at(e, y)))
        height = a["y"] + F.try_divide((right - a["x"]) * (b["y"] - a["y"]), b["x"] - a["x"])
        down = ((a["x"] > right) != (b["x"] > right)) & ((height <= y) != (height <= bottom))
        return along != down  # both at once cancel out

    odd = F.size(F.filter("edges", flips)) % 2 == 1
    return F.when(F.col("edges").isNull(), F.lit(True)).otherwise(F.col("corner_in") != odd)


def pip_join(
    points: DataFrame, polys: DataFrame, id_col: str, zone: str = "zone_id", buffer_m: float = 0.0
) -> DataFrame:
    """Zone of each point (smallest zone id when several hold it); unmatched points are left out.

    With a buffer a point outside every polygon but within ``buffer_m`` of one also counts; a true hit
    always beats a buffered one. Points sharing a coordinate are tested once.
    """
    at = spatial.with_cell(points.select("lat", "lon").distinct())
    tested = at.join(cell_index(polys, zone), "cell").where(inside_cell(F.col("lon"), F.col("lat"))).select("lat", "lon", zone, F.lit(0.0).alias("_gap"))
    if buffer_m > 0:
        close = edge_cells(polys, zone, buffer_m).groupBy(zone, cells.pack(F.col("_ix"), F.col("_iy")).alias("cell")).agg(F.collect_list("edge").alias("edges"))
        gap = boundary_distance_m(F.col("lon"), F.col("lat"), F.col("edges"))
        beside = at.join(close, "cell").select("lat", "lon", zone, gap.alias("_gap")).where(F.col("_gap") <= buffer_m)
        tested = tested.unionByName(beside)
    zones = tested.groupBy("lat", "lon").agg(F.min(F.struct("_gap", zone))[zone].alias(zone))
    return points.join(zones, ["lat", "lon"]).select(id_col, "lat", "lon", zone)


def inside_buffered(points: DataFrame, polys: DataFrame, id_col: str, buffer_m: float, zone: str = "zone_id") -> DataFrame:
    """Points inside the region or within ``buffer_m`` of it."""
    return pip_join(points, polys, id_col, zone, buffer_m).select(id_col)


def fill_polygons(polys: DataFrame, zone: str = "zone_id") -> DataFrame:
    """Polygon to cells by centre containment; a polygon holding no centre gets the cell of its mean vertex."""
    lat, lon = cells.centre_lat(F.col("cell")), cells.centre_lon(F.col("cell"))
    hit = cell_index(polys, zone).where(inside_cell(lon, lat)).select(zone, "cell")
    outline = F.col("shape")[0][0]
    n = F.size(outline) - 1
    corner = F.slice(outline, 1, n)
    mean = [
        F.aggregate(F.transform(corner, lambda p: p[axis]), F.lit(0.0), lambda a, v: a + v) / n
        for axis in ("x", "y")
    ]
    lost = (
        polys.join(hit.select(zone).distinct(), zone, "left_anti")
        .select(zone, cells.cell(mean[1], mean[0]).alias("cell"))
    )
    return hit.unionByName(lost)


def land_fraction(units: DataFrame, polys: DataFrame, parts: int = 8, zone: str = "zone_id") -> DataFrame:
    """Share of each cell inside the polygons by a parts x parts grid of sample points.

    Below 0.03 the cell is dropped, above 0.999 it counts as whole.
    """
    step = cells.FINE_CELL_M / parts
    samples = (
        units.select("cell")
        .distinct()
        .withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        .withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        .withColumns(
            {
                "lon": cells.lon_of(cells.cell_ix(F.col("cell")) * cells.FINE_CELL_M + (F.col("_i") + 0.5) * step),
                "lat": cells.lat_of(cells.cell_iy(F.col("cell")) * cells.FINE_CELL_M + (F.col("_j") + 0.5) * step),
            }
        )
    )
    near = samples.join(cell_index(polys, zone), "cell", "left")
    hit = F.when(F.col("corner_in").isNull(), F.lit(False)).otherwise(inside_cell(F.col("lon"), F.col("lat")))
    per_sample = near.groupBy("cell", "_i", "_j").agg(F.max(hit.cast("int")).alias("_in"))
    share = per_sample.groupBy("cell").agg(F.avg("_in").alias("land_fraction"))
    return share.where(F.col("land_fraction") >= 0.03).withColumn(
        "land_fraction", F.when(F.col("land_fraction") > 0.999, 1.0).otherwise(F.col("land_fraction"))
    )


def allocate(parents: DataFrame, fill: DataFrame, zone: str = "zone_id") -> tuple[DataFrame, DataFrame]:
    """Split a parent's total and margin equally over its cells.

    Returns the cells (population, root-sum-square margin, contributors, largest contributor) and the
    edge list behind them.
    """
    sizes = fill.groupBy(zone).agg(F.count(F.lit(1)).alias("n_cells"))
    links = (
        fill.join(parents.select(zone, "total", "moe").join(sizes, zone), zone)
        .withColumns(
            {"share": F.col("total") / F.col("n_cells"), "moe_share": F.col("moe") / F.col("n_cells")}
        )
        .select("cell", zone, "share", "moe_share")
    )
    out = links.groupBy("cell").agg(
        F.sum("share").alias("population"),
        F.sqrt(F.sum(F.col("moe_share") * F.col("moe_share"))).alias("moe"),
        F.count_distinct(zone).alias("contributors"),
        F.max_by(zone, F.struct(F.col("share"), F.col(zone))).alias("largest"),
    )
    return out, links


def apportion_length(lines: DataFrame, id_col: str, vertices: str = "vertices", step_m: float = 20.0) -> DataFrame:
    """Metres of each line per cell: n = max(2, floor(len / step) + 1) equally spaced samples, len / n each."""
    v = F.col(vertices)
    n = F.size(v)

    def metres(p: Column) -> Column:
        return F.struct(cells.metres_x(p["lon"]).alias("x"), cells.metres_y(p["lat"]).alias("y"))

    flat = F.transform(v, metres)
    legs = F.zip_with(
        F.slice(flat, 1, n - 1),
        F.slice(flat, 2, n - 1),
        lambda a, b: F.struct(a.alias("a"), b.alias("b"), F.hypot(b["x"] - a["x"], b["y"] - a["y"]).alias("d")),
    )
    base = lines.where(n >= 2).select(id_col, legs.alias("_legs"))
    ends = F.transform(
        F.sequence(F.lit(1), F.size("_legs")),
        lambda i: F.aggregate(F.slice(F.col("_legs"), F.lit(1), i), F.lit(0.0), lambda acc, leg: acc + leg["d"]),
    )
    timed = base.withColumn("_ends", ends).withColumn("_len", F.element_at("_ends", -1))
    samples = (
        timed.where(F.col("_len") > 0)
        .withColumn("_n", F.greatest(F.lit(2), F.floor(F.col("_len") / step_m).cast("int") + 1))
        .withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .withColumn("_at", F.col("_i") / (F.col("_n") - 1) * F.col("_len"))
    )
    leg_no = F.least(F.size(F.filter("_ends", lambda e: e < F.col("_at"))), F.size("_legs") - 1)
    placed = samples.withColumn("_leg", F.get(F.col("_legs"), leg_no)).withColumn(
        "_start", F.coalesce(F.get(F.col("_ends"), leg_no - 1), F.lit(0.0))
    )
    t = F.when(F.col("_leg.d") > 0, (F.col("_at") - F.col("_start")) / F.col("_leg.d")).otherwise(0.0)
    x = F.col("_leg.a.x") + t * (F.col("_leg.b.x") - F.col("_leg.a.x"))
    y = F.col("_leg.a.y") + t * (F.col("_leg.b.y") - F.col("_leg.a.y"))
    return (
        placed.withColumn("cell", cells.cell_at(x, y))
        .groupBy("cell")
        .agg(F.sum(F.col("_len") / F.col("_n")).alias("exposure"))
    )
