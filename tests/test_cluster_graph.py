"""Density clusters and reachability against sequential brute force."""

import heapq
import math

import numpy as np
import pytest

from placescore.functions import cells
from placescore.operators import cluster, graph

K, C = cells.METRES_PER_DEGREE, cells.COS_LAT


def _brute(pts, eps, k):
    n = len(pts)
    d = [[math.hypot((a[1] - b[1]) * K, (a[2] - b[2]) * K * C) for b in pts] for a in pts]
    near = [[j for j in range(n) if d[i][j] <= eps + 1e-9] for i in range(n)]
    core = [len(x) >= k for x in near]
    label = [None] * n
    for s in range(n):
        if not core[s] or label[s] is not None:
            continue
        label[s], stack = s, [s]
        while stack:
            for j in near[stack.pop()]:
                if core[j] and label[j] is None:
                    label[j] = s
                    stack.append(j)
    reach = [{label[j] for j in near[i] if core[j]} for i in range(n)]
    return core, label, reach


@pytest.mark.parametrize(("eps", "k", "seed"), [(60.0, 4, 1), (100.0, 3, 2), (25.0, 2, 3)])
def test_hotspots_equal_brute_force(spark, eps, k, seed):
    rng = np.random.default_rng(seed)
    lat = np.concatenate([40.70 + rng.random(150) * 0.02, 40.705 + rng.random(120) * 0.0008, np.full(20, 40.7123)])
    lon = np.concatenate([-74.0 + rng.random(150) * 0.02, -73.992 + rng.random(120) * 0.0008, np.full(20, -73.985)])
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))]
    df = spark.createDataFrame(pts + [(999, float("nan"), -74.0)], "id int, lat double, lon double").repartition(5)
    got = {r.id: r.cluster for r in cluster.hotspots(df, eps, k).collect()}
    core, label, reach = _brute(pts, eps, k)
    assert set(got) == {i for i in range(len(pts)) if reach[i]}
    name = {}
    for i in range(len(pts)):
        if core[i]:
            assert name.setdefault(label[i], got[i]) == got[i]
    assert len(set(name.values())) == len(name)
    for i in got:
        assert got[i] in {name[x] for x in reach[i]}


def test_cluster_summary(spark):
    rows = [(1, 40.70, -74.0, "a"), (2, 40.7008, -74.0, "b"), (3, 41.5, -73.0, "a")]
    df = spark.createDataFrame(rows, "id int, lat double, lon double, kind string")
    s = cluster.cluster_summary(cluster.hotspots(df, 100.0, 2)).collect()
    assert len(s) == 1 and s[0].n == 2 and s[0].radius_m == pytest.approx(44.5, abs=1.0)
    assert s[0].kinds == {"a": 1, "b": 1} and s[0].dominant == "a"


def test_components_on_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "ga long, gb long")
    nodes = spark.createDataFrame([(i,) for i in [*range(301), 1000, 1001, 5000]], "node long")
    got = {r.node: r.label for r in cluster.connected_components(nodes, links).collect()}
    assert {got[i] for i in range(301)} == {0} and got[1001] == 1000 and got[5000] == 5000


def test_reachability_equals_shortest_paths(spark):
    rng = np.random.default_rng(5)
    n = 80
    pos = [(i, float(40.70 + rng.random() * 0.006), float(-74.0 + rng.random() * 0.006)) for i in range(n)]
    edges = []
    for _ in range(220):
        u, v = (int(x) for x in rng.integers(0, n, 2))
        edges.append((u, v, float(rng.integers(20, 200))))
    edges += [(0, None, 5.0), (1, 2, 0.0), (3, 500, 9.0)]
    nodes = spark.createDataFrame(pos + [pos[0]], "node_id int, lat double, lon double")
    e = spark.createDataFrame(edges, "u int, v int, length_m double")
    good_nodes, good_edges = graph.clean_graph(nodes, e)
    assert good_nodes.count() == n
    goals = [(100 + i, pos[i][1], pos[i][2]) for i in (3, 17, 40)]
    t = spark.createDataFrame(goals, "target_id int, lat double, lon double")
    got = {}
    for r in graph.reachable(t, good_nodes, good_edges, 4.0).collect():
        got.setdefault(r.target_id, {})[r.node] = r.dist
    budget = 4 * 60 * 1.33
    adj = {}
    for u, v, w in edges:
        if v is None or w <= 0 or v >= n:
            continue
        adj.setdefault(u, []).append((v, w))
        adj.setdefault(v, []).append((u, w))
    reach = budget * 1.45
    for goal, start in zip(goals, (3, 17, 40)):
        inside = {i for i, a, b in pos if abs(a - goal[1]) * K <= reach and abs(b - goal[2]) * K * C <= reach}
        assert len(inside) < n  # the search box really cuts something off
        best, heap = {start: 0.0}, [(0.0, start)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > best[u]:
                continue
            for v, w in adj.get(u, []):
                if v in inside and d + w <= budget and d + w < best.get(v, 1e18):
                    best[v] = d + w
                    heapq.heappush(heap, (d + w, v))
        assert got.get(goal[0], {}) == (best if len(best) >= 4 else {})


def test_hull_area(spark):
    d = 0.001
    sq = [(1, 40.70, -74.0), (2, 40.70 + d, -74.0), (3, 40.70 + d, -74.0 + d), (4, 40.70, -74.0 + d), (5, 40.7005, -73.9995)]
    nodes = spark.createDataFrame(sq, "node_id int, lat double, lon double")
    reached = spark.createDataFrame([(7, i) for i, _, _ in sq], "target_id int, node int").repartition(3)
    a = graph.hull_area(reached, nodes).first().area_km2
    assert a == pytest.approx(d * K * d * K * C / 1e6)
