"""Distributed ranks, numbering and quantiles against numpy, with hot ties."""

import math

import numpy as np
from pyspark.sql import functions as F

from placescore.operators import ordering
from placescore.plans import stats


def _values():
    rng = np.random.default_rng(7)
    v = np.concatenate([rng.normal(0, 50, 400), np.full(300, 12.5), rng.lognormal(3, 2, 200), -rng.lognormal(1, 3, 100)])
    return [float(x) for x in np.round(v, 3)]


def test_positions_match_numpy(spark):
    v = _values()
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)] + [(-1, None)], "id int, v double").repartition(5)
    got = {r.id: r for r in ordering.with_positions(df, "v").collect()}
    a = np.array(v)
    for i in range(0, len(v), 37):
        assert got[i].below == int((a < a[i]).sum())
        assert got[i].n == int((a == a[i]).sum())
        assert got[i].total == len(v)
    assert got[-1].below is None


def test_global_row_number(spark):
    v = _values()
    rows = [(i * 1000003 % 900001, i % 3, x) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "id long, g int, v double").repartition(5)
    got = [(r.id, r.rank) for r in ordering.global_row_number(df, "v", "id", tie_bucket=F.shiftright("id", 14)).collect()]
    want = {x[0]: i + 1 for i, x in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])))}
    assert dict(got) == want
    by = {(r.id): r.rank for r in ordering.global_row_number(df, "v", "id", by=["g"]).collect()}
    g0 = sorted([r for r in rows if r[1] == 0], key=lambda r: (-r[2], r[0]))
    assert [by[r[0]] for r in g0] == list(range(1, len(g0) + 1))


def test_exact_quantiles(spark):
    v = _values()
    df = spark.createDataFrame([("a", x) for x in v] + [("b", 1.0), ("b", 2.0), ("b", 4.0), ("b", 9.0)], "k string, v double")
    got = {r.k: r.quantiles for r in ordering.exact_quantiles(df, "v", [0.02, 0.25, 0.5, 0.98], by=["k"]).collect()}
    assert np.allclose(got["a"], np.percentile(v, [2, 25, 50, 98]))
    assert got["b"][1] == 1.75


def test_running_max_and_thinning(spark):
    pts = [(float(i), float((i * 37) % 101)) for i in range(150)]
    df = spark.createDataFrame(pts, "x double, y double").repartition(4)
    got = {r.x: r.running for r in stats.running_max(df, "x", "y").collect()}
    best = -1.0
    for x, y in pts:
        best = max(best, y)
        assert got[x] == best
    kept = sorted(r.x for r in stats.thin(df, "x").collect())
    want = sorted({float(int(i * 150 / 60)) for i in range(60)} | {149.0})
    assert kept == want


def test_spearman_and_p_value(spark):
    df = spark.createDataFrame([(0.9, 10), (0.5, 7), (0.7, 26), (0.65, 9)], "rho double, n int")
    got = [r.p_value for r in stats.with_p_value(df).collect()]
    for (rho, n), p in zip([(0.9, 10), (0.5, 7), (0.7, 26), (0.65, 9)], got):
        nu = n - 2
        t = rho * (nu / (1 - rho * rho)) ** 0.5
        x = np.linspace(0, t, 200001)
        pdf = math.gamma((nu + 1) / 2) / (math.sqrt(nu * math.pi) * math.gamma(nu / 2)) * (1 + x * x / nu) ** (-(nu + 1) / 2)
        assert abs(p - (1 - 2 * np.trapezoid(pdf, x))) < 1e-7
    same = spark.createDataFrame([(float(i), float(i * i)) for i in range(12)], "a double, b double")
    r = stats.spearman(same, ["a", "b"]).first()
    assert round(r.rho, 9) == 1.0 and r.n == 12
    flat = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "a double, b double")
    assert stats.spearman(flat, ["a", "b"]).first().rho is None


def test_positions_of_odd_values(spark):
    rows = [(1, 1.0), (2, 50.0), (3, 900.0), (4, float("nan")), (5, float("inf")), (6, float("-inf")), (7, None), (8, 50.0)]
    got = {r.id: (r.below, r.n) for r in ordering.with_positions(spark.createDataFrame(rows, "id int, v double"), "v").collect()}
    assert got == {6: (0, 1), 1: (1, 1), 2: (2, 2), 8: (2, 2), 3: (4, 1), 5: (5, 1), 4: (6, 1), 7: (None, None)}


def test_row_number_keeps_large_integers_null_ties_and_groups(spark):
    rows = [(None, 2**53, 1), (None, 2**53 + 1, None), (None, 2**53 + 2, 3), ("a", 5, None), ("a", 5, 2), ("a", 5, 1), ("a", None, 1)]
    df = spark.createDataFrame(rows, "g string, v bigint, id bigint")
    got = {(r.g, r.v, r.id): r.rank for r in ordering.global_row_number(df, "v", "id", by=["g"]).collect()}
    assert got == {
        (None, 2**53, 1): 3,
        (None, 2**53 + 1, None): 2,
        (None, 2**53 + 2, 3): 1,
        ("a", 5, 1): 1,
        ("a", 5, 2): 2,
        ("a", 5, None): 3,
        ("a", None, 1): None,
    }


def test_quantiles_of_a_null_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 7.0)], "k string, v double")
    assert {r.k: r.quantiles for r in ordering.exact_quantiles(df, "v", [0.5], by=["k"]).collect()} == {None: [2.0], "a": [7.0]}


def test_narrow_values_are_spread_over_buckets(spark):
    df = spark.range(100_000).select((F.col("id") + 1_700_000_000_000_000).alias("v"), (F.col("id") / 1e8).alias("w"))
    for c in ("v", "w"):
        sizes = [r["count"] for r in ordering.with_bucket(df, c, "b").groupBy("b").count().collect()]
        assert len(sizes) > 100 and max(sizes) < 4 * 100_000 / len(sizes)


def test_two_levels_of_split_points_follow_the_values(spark, monkeypatch):
    monkeypatch.setattr(ordering, "VALUES_UNCUT", 10)
    monkeypatch.setattr(ordering, "VALUES_PER_BUCKET", 50)
    monkeypatch.setattr(ordering, "SPLITS", 7)
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("v"))
    sizes = {r["b"]: r["count"] for r in ordering.with_bucket(df, "v", "b").groupBy("b").count().collect()}
    assert len(sizes) > 300 and max(sizes.values()) < 4 * 50
    got = ordering.value_positions(df, "v").orderBy("v").collect()
    assert [r.below for r in got] == list(range(20_000)) and {r.total for r in got} == {20_000}
