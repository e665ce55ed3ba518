"""Spatial operators against brute force, with hot cells, copies and far-away points."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from placescore.functions import cells
from placescore.operators import polygons, spatial

K, C = cells.METRES_PER_DEGREE, cells.COS_LAT


def _points(n, seed, hot=0.35):
    """Scattered points with a third of the rows on one corner and copies of a single coordinate."""
    rng = np.random.default_rng(seed)
    lat, lon = 40.70 + rng.random(n) * 0.03, -74.0 + rng.random(n) * 0.03
    h = int(n * hot)
    lat[:h], lon[:h] = 40.7101 + rng.random(h) * 0.0004, -73.9901 + rng.random(h) * 0.0004
    lat[h : h + n // 10], lon[h : h + n // 10] = 40.715, -73.985
    return [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))]


def _d(a, b):
    return math.hypot((a[0] - b[0]) * K, (a[1] - b[1]) * K * C)


def test_radius_measures_equal_pairs(spark):
    facts = _points(600, 1)
    goals = _points(40, 2) + [(999, 40.9, -73.7)]
    f = spark.createDataFrame([(i, i % 17, a, b) for i, a, b in facts], "fact_id int, entity_id int, lat double, lon double").repartition(6)
    t = spark.createDataFrame(goals, "target_id int, lat double, lon double")
    for r in (200.0, 1000.0):
        got = {x.target_id: (x.n, x.entities) for x in spatial.radius_measures(t, f, r, {"n": F.lit(1)}, "entity_id").collect()}
        joined = spatial.radius_join(t, f, r).groupBy("target_id").agg(F.count("*").alias("n")).collect()
        pairs = {x.target_id: x.n for x in joined}
        for i, a, b in goals:
            near = [j for j, c, d in facts if _d((a, b), (c, d)) <= r]
            assert got[i] == (len(near), len({j % 17 for j in near}))
            assert pairs.get(i, 0) == len(near)


def test_nearest_join_and_its_miss(spark):
    places, goals = _points(300, 3), _points(60, 4) + [(998, 40.78, -73.80)]
    p = spark.createDataFrame(places, "place_id int, lat double, lon double")
    t = spark.createDataFrame(goals, "target_id int, lat double, lon double")
    got = {x.target_id: x.place_id for x in spatial.nearest_join(t, p, "place_id").collect()}
    for i, a, b in goals:
        box = [(((c - a) ** 2 + (d - b) ** 2), j) for j, c, d in places if abs(c - a) * K <= 2500 and abs(d - b) * K * C <= 2500]
        assert got[i] == (min(box)[1] if box else None)
    assert got[998] is None


def test_nearest_cell_far_away(spark):
    known = spark.createDataFrame([(40.70, -74.0), (40.71, -73.99), (40.93, -73.70)], "lat double, lon double")
    t = spark.createDataFrame([(1, 40.705, -74.0), (2, 40.80, -73.85), (3, 40.94, -73.69)], "target_id int, lat double, lon double")
    near = spatial.nearest_cell(t, spatial.with_cell(known)).collect()
    centre = [
        ((math.floor((a - 40.45) * K / 300) + 0.5) * 300, (math.floor((b + 74.30) * K * C / 300) + 0.5) * 300)
        for a, b in [(40.70, -74.0), (40.71, -73.99), (40.93, -73.70)]
    ]
    for r in near:
        a, b = {1: (40.705, -74.0), 2: (40.80, -73.85), 3: (40.94, -73.69)}[r.target_id]
        y, x = (a - 40.45) * K, (b + 74.30) * K * C
        assert r.distance_m == pytest.approx(min(math.hypot(x - cx, y - cy) for cy, cx in centre))


def test_knn_with_copies_and_outliers(spark):
    pts = _points(250, 5) + [(900, 40.90, -73.70), (901, 40.93, -73.72)]
    df = spark.createDataFrame(pts, "id int, lat double, lon double")
    got = {r.id: r.mean_m for r in spatial.knn_mean(df, "id", 3).collect()}
    for i, a, b in pts[::7] + pts[-2:]:
        want = sorted(_d((a, b), (c, d)) for j, c, d in pts if j != i)[:3]
        assert got[i] == pytest.approx(sum(want) / 3, abs=1e-6)
    lone = spatial.knn_mean(spark.createDataFrame([(1, 40.7, -74.0)], "id int, lat double, lon double"), "id").first()
    assert lone.mean_m is None and lone.density == 0.0


def _ring(*xy):
    return [{"x": float(x), "y": float(y)} for x, y in [*xy, xy[0]]]


def test_point_in_polygon_holes_and_parts(spark):
    donut = [[_ring((-74.0, 40.70), (-73.98, 40.70), (-73.98, 40.72), (-74.0, 40.72)), _ring((-73.995, 40.705), (-73.985, 40.705), (-73.985, 40.715), (-73.995, 40.715))]]
    two = [[_ring((-73.97, 40.70), (-73.96, 40.70), (-73.965, 40.71))], [_ring((-73.95, 40.70), (-73.94, 40.70), (-73.94, 40.71), (-73.95, 40.71))]]
    z = spark.createDataFrame([(1, donut), (2, two)], f"zone_id int, shape {polygons.SHAPE}")
    pts = [(1, 40.702, -73.99), (2, 40.71, -73.99), (3, 40.702, -73.965), (4, 40.705, -73.945), (5, 40.709, -73.9695), (6, 40.75, -73.9)]
    p = spark.createDataFrame(pts, "id int, lat double, lon double")
    got = {r.id: r.zone_id for r in polygons.pip_join(p, z, "id").collect()}
    assert got == {1: 1, 3: 2, 4: 2}
    near = {r.id for r in polygons.inside_buffered(p, z, "id", 600.0).collect()}
    assert near == {1, 2, 3, 4, 5}


def _plain_inside(x, y, ring):
    odd = False
    for (ax, ay), (bx, by) in zip(ring[:-1], ring[1:], strict=True):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def test_a_polygon_of_fifty_thousand_vertices(spark):
    """Edges go to the cells they cross: rows stay linear in edges and covered cells, and every point gets the right side."""
    n, rng = 50_000, random.Random(4)
    ring = []
    for i in range(n):
        r = 0.02 * (1 + 0.3 * math.sin(11 * 2 * math.pi * i / n) + 0.02 * rng.random())
        ring.append((-73.95 + r * math.cos(2 * math.pi * i / n), 40.75 + r * math.sin(2 * math.pi * i / n)))
    ring.append(ring[0])
    z = spark.createDataFrame([(7, [[[{"x": x, "y": y} for x, y in ring]]])], f"zone_id int, shape {polygons.SHAPE}")
    pts = [(i, 40.75 + rng.uniform(-0.03, 0.03), -73.95 + rng.uniform(-0.03, 0.03)) for i in range(150)]
    pts += [(1000 + i, y + rng.uniform(-1e-5, 1e-5), x + rng.uniform(-1e-5, 1e-5)) for i, (x, y) in enumerate(rng.sample(ring, 100))]
    got = {r.id for r in polygons.pip_join(spark.createDataFrame(pts, "id int, lat double, lon double"), z, "id").collect()}
    assert got == {i for i, y, x in pts if _plain_inside(x, y, ring)}
    index = polygons.cell_index(z).agg(F.count("*").alias("cells"), F.sum(F.size("edges")).alias("edges")).first()
    assert index.edges < 1.5 * n + 20 * index.cells
    filled = {r.cell for r in polygons.fill_polygons(z).collect()}
    rows = polygons.cell_index(z).select("cell", cells.centre_lat(F.col("cell")).alias("y"), cells.centre_lon(F.col("cell")).alias("x")).collect()
    assert filled == {r.cell for r in rows if _plain_inside(r.x, r.y, ring)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_polygons_on_the_lattice_lines(spark, seed):
    """Edges along cell borders, corners on cell corners, self-crossing rings: every point as by the plain rule."""
    rng = random.Random(seed)
    step_x, step_y = 300 / K / C, 300 / K
    corner = lambda: (-73.98 + rng.randint(-6, 6) * step_x / rng.choice([1, 2]), 40.72 + rng.randint(-6, 6) * step_y / rng.choice([1, 2]))
    rings = []
    for _ in range(6):
        ring = [corner() for _ in range(rng.randint(3, 7))]
        x0, y0, x1, y1 = *min(ring), *max(ring)
        rings.append(ring + ring[:1])
        rings.append([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)])
    z = spark.createDataFrame([(i, [[[{"x": x, "y": y} for x, y in ring]]]) for i, ring in enumerate(rings)], f"zone_id int, shape {polygons.SHAPE}")
    pts = [(i, 40.72 + rng.uniform(-7, 7) * step_y, -73.98 + rng.uniform(-7, 7) * step_x) for i in range(400)]
    p = spark.createDataFrame(pts, "id int, lat double, lon double")
    got = {r.id: r.zone_id for r in polygons.pip_join(p, z, "id").collect()}
    want = {i: min(k) for i, y, x in pts if (k := [j for j, ring in enumerate(rings) if _plain_inside(x, y, ring)])}
    assert got == want


def test_one_address_with_most_of_the_facts_is_dealt_to_many_tasks(spark):
    f = spark.range(3000).selectExpr("id AS event_id", "40.70D AS lat", "-74.0D + IF(id % 3 = 0, 0.0001D * id, 0.0D) AS lon", "1 AS one")
    t = spark.createDataFrame([(1, 40.70, -74.0), (2, 40.701, -74.0)], "target_id int, lat double, lon double")
    left, right, keys = spatial._spread(spatial.cover(t, 300.0).select("target_id", "cell"), spatial.with_cell(f), 100)
    sizes = [r["count"] for r in right.groupBy(*keys).count().collect()]
    assert max(sizes) < 200 and sum(sizes) == 3000
    plain = spatial.radius_join(t, f, 300.0).groupBy("target_id").count().orderBy("target_id").collect()
    assert spatial.radius_join(t, f, 300.0, rows_per_task=100).groupBy("target_id").count().orderBy("target_id").collect() == plain
    few = spatial.radius_measures(t, f, 300.0, {"n": F.col("one")}, entity="event_id", rows_per_task=50).orderBy("target_id").collect()
    assert [(r.target_id, r.n, r.entities) for r in few] == [(r.target_id, r["count"], r["count"]) for r in plain]


BOXES = {
    "west": (-74.00, 40.72, -73.985, 40.735, 9000.0, 100.0),
    "east": (-73.985, 40.72, -73.97, 40.735, 4000.0, 80.0),
    "tiny": (-73.9761, 40.7271, -73.9759, 40.7273, 500.0, 50.0),
}


def _tracts(spark, names):
    rows = []
    for n in names:
        x0, y0, x1, y1, total, moe = BOXES[n]
        rows.append((n, total, moe, [[_ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))]]))
    return spark.createDataFrame(rows, f"zone_id string, total double, moe double, shape {polygons.SHAPE}")


def test_allocation_conserves_and_partitions(spark):
    z = _tracts(spark, ["west", "east"])
    out, links = polygons.allocate(z, polygons.fill_polygons(z))
    assert out.agg(F.sum("population")).first()[0] == pytest.approx(13000)
    assert out.agg(F.max("contributors")).first()[0] == 1
    for r in links.where("zone_id = 'west'").collect():
        assert r.moe_share == pytest.approx(r.share * 100 / 9000)


def test_sub_cell_polygon_keeps_both_contributors(spark):
    z = _tracts(spark, ["east", "tiny"])
    out, links = polygons.allocate(z, polygons.fill_polygons(z))
    tiny = links.where("zone_id = 'tiny'").collect()
    assert len(tiny) == 1 and tiny[0].share == 500
    shared = out.where(F.col("cell") == tiny[0].cell).first()
    assert shared.contributors == 2 and shared.largest == "tiny"


def test_apportioned_length(spark):
    line = [(1, [{"lon": -74.0, "lat": 40.70}, {"lon": -73.99, "lat": 40.70}, {"lon": -73.99, "lat": 40.705}])]
    df = spark.createDataFrame(line, "id int, vertices array<struct<lon:double,lat:double>>")
    got = {r.cell: r.exposure for r in polygons.apportion_length(df, "id").collect()}
    x0, y0 = (-74.0 + 74.30) * K * C, (40.70 - 40.45) * K
    a, b = 0.01 * K * C, 0.005 * K
    n = max(2, int((a + b) // 20) + 1)
    want = {}
    for i in range(n):
        s = i / (n - 1) * (a + b)
        x, y = (x0 + s, y0) if s <= a else (x0 + a, y0 + s - a)
        cell = (math.floor(x / 300) + 2**20) * 2**21 + math.floor(y / 300) + 2**20
        want[cell] = want.get(cell, 0) + (a + b) / n
    assert sum(got.values()) == pytest.approx(a + b)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_state_plane_origin(spark):
    c = spark.range(1).select(cells.transform_coords(F.lit("984250.0"), F.lit("0.0"), "EPSG:2263").alias("p")).first().p
    assert c.lon == pytest.approx(-74.0, abs=1e-6) and c.lat == pytest.approx(40.1666667, abs=1e-5)
    bad = spark.range(1).select(cells.transform_coords(F.lit("x"), F.lit("1"), "EPSG:3857").alias("p")).first().p
    assert bad is None
    with pytest.raises(ValueError):
        cells.transform_coords(F.lit(1), F.lit(1), "EPSG:9999")


def test_nearest_searches_have_no_farthest_distance(spark):
    """Sparse points hundreds of kilometres apart: the nearer one outside a block of the coarsest lattice, and the only one."""
    rng = np.random.default_rng(5)
    spots = [(float(a), float(b)) for a, b in zip(40.45 + rng.random(12) * 30, -74.3 + rng.random(12) * 60)]
    goals = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(40.45 + rng.random(40) * 30, -74.3 + rng.random(40) * 60))]
    known = spatial.with_cell(spark.createDataFrame(spots, "lat double, lon double"))
    t = spark.createDataFrame(goals, "target_id int, lat double, lon double")
    centre = [((math.floor((a - 40.45) * K / 300) + 0.5) * 300, (math.floor((b + 74.30) * K * C / 300) + 0.5) * 300) for a, b in spots]
    got = {r.target_id: r.distance_m for r in spatial.nearest_cell(t, known).collect()}
    for i, a, b in goals:
        assert got[i] == pytest.approx(min(math.hypot((a - 40.45) * K - y, (b + 74.30) * K * C - x) for y, x in centre), abs=0.01)
    mean = {r.target_id: r.mean_m for r in spatial.knn_mean(t, "target_id", 3).collect()}
    for i, a, b in goals:
        near = sorted(_d((a, b), (c, d)) for j, c, d in goals if j != i)[:3]
        assert mean[i] == pytest.approx(sum(near) / 3, abs=0.01)
    assert spatial.nearest_cell(t, known.limit(0)).where("cell IS NULL").count() == len(goals)


def test_entities_are_counted_without_pairs(spark, monkeypatch):
    facts, goals = _points(3000, 21), _points(70, 22) + [(999, 40.9, -73.7), (998, None, -74.0)]
    who = lambda i: 7 if i % 4 == 0 else i % 211  # noqa: E731  one entity has a quarter of the rows
    f = spark.createDataFrame([(f"e{who(i)}", a, b) for i, a, b in facts], "who string, lat double, lon double").repartition(5)
    t = spark.createDataFrame(goals, "target_id int, lat double, lon double")
    monkeypatch.setattr(spatial, "ENTITY_TARGETS", 30)
    paired = []
    plain = spatial.within
    monkeypatch.setattr(spatial, "within", lambda targets, r, per_cell, *rest: paired.append(per_cell) or plain(targets, r, per_cell, *rest))
    for r in (200.0, 1000.0):
        for most in (400, 100_000):
            got = {x.target_id: x.entities for x in spatial.distinct_within(t, f, r, "who", entity_rows=most).collect()}
            want = {i: len({who(j) for j, c, d in facts if _d((a, b), (c, d)) <= r}) for i, a, b in goals if a is not None}
            assert got == {i: n for i, n in want.items() if n}
    assert all({x[0] for x in p.select("_entity").distinct().collect()} == {"e7"} for p in paired) and len(paired) == 2


def test_radius_join_tests_a_coordinate_once(spark):
    f = spark.createDataFrame([(i, 40.7101, -74.0) for i in range(500)] + [(i, 40.7302, -74.0) for i in range(500, 520)], "fact_id int, lat double, lon double")
    t = spark.createDataFrame([(1, 40.71, -74.0), (2, 40.73, -74.0)], "target_id int, lat double, lon double")
    j = spatial.radius_join(t, f, 200.0)
    assert j.columns == ["cell", "target_id", "target_lat", "target_lon", "fact_id", "lat", "lon", "distance_sq"]
    assert sorted((x.target_id, x.fact_id) for x in j.collect()) == [(1, i) for i in range(500)] + [(2, i) for i in range(500, 520)]
    assert "collect_list" in j._jdf.queryExecution().toString()


def test_cells_by_centre_from_totals(spark):
    facts, goals = _points(800, 23), _points(30, 24)
    f = spatial.with_cell(spark.createDataFrame(facts, "fact_id int, lat double, lon double"))
    t = spark.createDataFrame(goals, "target_id int, lat double, lon double")
    n = F.count("*").alias("n")
    got = spatial.within(t, 500.0, f.groupBy("cell").agg(n), f.groupBy("cell", "lat", "lon").agg(n), prefilter="cell_center").groupBy("target_id").agg(F.sum("n").alias("n"))
    want = spatial.radius_join(t, f, 500.0, prefilter="cell_center").groupBy("target_id").agg(n)
    assert sorted(got.collect()) == sorted(want.collect())
