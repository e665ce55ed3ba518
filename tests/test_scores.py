"""Golden category scores, curves, tiers, flags and labels."""

import pytest
from pyspark.sql import functions as F

from placescore.functions import score
from placescore.operators import tables
from placescore.plans import composite, registry

STATE = [
    "safety_collisions", "transit_collisions", "injuries", "rodent", "sanitation", "ems_seconds", "fire_seconds",
    "park_acres", "trees", "toilets", "kiosks", "restaurants", "critical_rate", "class_c", "class_b", "aep",
]
P75 = {"collision": 40, "rodent": 12, "ems_response": 500, "fire_response": 300}
FULL = {
    "safety_collisions": 30, "transit_collisions": 30, "injuries": 3, "rodent": 8, "sanitation": 10, "ems_seconds": 420,
    "fire_seconds": 260, "park_acres": 40, "trees": 300, "toilets": 2, "kiosks": 3, "restaurants": 60,
    "critical_rate": 0.2, "class_c": 1, "class_b": 4, "aep": 0,
}
PREPARED = {
    "safety": {"collision": 70, "rodent": 60, "311_sanitation": 55, "ems_response": 80, "fire_response": 75},
    "transit": {"subway": 90, "bus": 70, "bike_routes": 50, "open_streets": 20},
    "amenities": {"parks_access": 60, "trees": 55, "public_toilets": 40, "linknyc": 30, "restaurant_context": 75, "facilities": 50},
    "building": {"housing_violations": 65, "aep": 90},
}
BAD = {"safety_collisions": 9999, "rodent": 9999, "sanitation": 9999, "ems_seconds": 9999, "fire_seconds": 9999}
# name: state, prepared, user weights, expected (safety, transit, amenities, building, overall)
CASES = {
    "empty": ({}, {}, None, (None, None, None, None, None)),
    "full fallback": (FULL, {}, None, (63, None, 56, 78, 60)),
    "one signal": ({"safety_collisions": 30}, {}, None, (62, None, None, None, 62)),
    "rodent only": ({"rodent": 25}, {}, None, (40, None, None, None, 40)),
    "prepared": (FULL, PREPARED, None, (70, 66, 55, 72, 64)),
    "prepared partly": (FULL, {"safety": {"collision": 70}}, None, (70, None, 56, 78, 64)),
    "user weights": (FULL, PREPARED, {"safety": 0.5, "transit": 0.3, "amenities": 0.2}, (70, 66, 55, 72, 66)),
    "extreme": (BAD, {}, None, (45, None, None, None, 45)),
    "sanitation": ({"sanitation": 10}, {}, None, (75, None, None, None, 75)),
    "ems": ({"ems_seconds": 420}, {}, None, (62, None, None, None, 62)),
    "fire": ({"fire_seconds": 260}, {}, None, (70, None, None, None, 70)),
    "parks": ({"park_acres": 40}, {}, None, (None, None, 55, None, 55)),
    "trees": ({"trees": 300}, {}, None, (None, None, 60, None, 60)),
    "toilets": ({"toilets": 2}, {}, None, (None, None, 54, None, 54)),
    "kiosks": ({"kiosks": 3}, {}, None, (None, None, 69, None, 69)),
    "restaurants": ({"restaurants": 60, "critical_rate": 0.2}, {}, None, (None, None, 50, None, 50)),
    "violations": ({"class_c": 1, "class_b": 4}, {}, None, (None, None, None, 68, None)),
    "aep": ({"aep": 1}, {}, None, (None, None, None, 75, None)),
    "injuries": ({"safety_collisions": 0, "injuries": 6}, {}, None, (88, None, None, None, 88)),
}
CATEGORIES = ("safety", "transit", "amenities", "building")


def _frame(spark):
    schema = "name string, " + ", ".join(f"{c} double" for c in STATE)
    ids = [m for c in PREPARED for m in PREPARED[c]]
    schema += ", " + ", ".join(f"`p_{m}` int" for m in ids)
    rows = []
    for name, (state, ready, _, _) in CASES.items():
        flat = {m: v for c in ready.values() for m, v in c.items()}
        rows.append((name, *[float(state[c]) if c in state else None for c in STATE], *[flat.get(m) for m in ids]))
    return spark.createDataFrame(rows, schema)


def _run(df, overall):
    prepared = {c: {m: F.col(f"p_{m}") for m in PREPARED[c]} for c in PREPARED}
    fallback = score.fallback_scores({c: F.col(c) for c in STATE}, {k: F.lit(v) for k, v in P75.items()})
    weights = {c: registry.weights_of(c) for c in CATEGORIES}
    out = composite.composite(df, prepared, fallback, weights, overall).collect()
    return {r["name"]: r for r in out}


def test_golden_scores(spark):
    df = _frame(spark)
    plain = _run(df, registry.CATEGORIES)
    custom = _run(df, CASES["user weights"][2])
    for name, (_, _, user, want) in CASES.items():
        r = (custom if user else plain)[name]
        assert tuple(r[f"{c}_score"] for c in (*CATEGORIES, "overall")) == want, name


def test_coverage_is_reported_beside_the_score(spark):
    r = _run(_frame(spark), registry.CATEGORIES)["prepared partly"]
    assert (r["safety_source"], r["safety_available"], r["safety_total"], r["safety_ratio"]) == ("prepared", 1, 5, 0.3125)
    assert r["safety_present"] == "collision" and "rodent" in r["safety_missing"]
    assert r["overall_ratio"] == 0.7
    none = _run(_frame(spark), registry.CATEGORIES)["empty"]
    assert none["overall_score"] is None and none["overall_ratio"] == 0.0


def _one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("x", "slope", "want"), [(0, 2, 10), (1, 2, 10), (2, 2, 30), (10, 2, 90), (3.5, 2, 45), (100, 50, 100), (50, -10, 90)]
)
def test_curve_lookup(spark, x, slope, want):
    knots = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in [(1, 10), (2, 30), (5, 60), (10, 90)]])
    assert _one(spark, score.curve_lookup(knots, F.lit(float(slope)), F.lit(float(x)))) == pytest.approx(want)


def test_public_tier(spark):
    assert _one(spark, score.public_tier(F.lit(5.0), F.lit(19.0))) == "Very low"
    assert _one(spark, score.public_tier(F.lit(15.0), F.lit(100.0))) == "Very low–Very high"
    assert _one(spark, score.public_tier(F.lit(50.0), F.lit(40.0))) is None
    assert _one(spark, score.public_tier(F.lit(None).cast("double"), F.lit(40.0))) is None


def test_risk_flag_unknown_is_not_none(spark):
    n = F.lit(None).cast("int")
    assert _one(spark, score.risk_flag(n, n, n)["level"]) == "unknown"
    assert _one(spark, score.risk_flag(F.lit(0), F.lit(0), F.lit(0))["level"]) == "none"
    assert _one(spark, score.risk_flag(F.lit(1), F.lit(2), n)["level"]) == "serious"
    assert _one(spark, score.risk_flag(n, F.lit(5), n)["level"]) == "elevated"
    assert _one(spark, score.risk_flag(n, n, F.lit(10))["level"]) == "watch"


def test_percentile_score_ties_nulls_and_inversion(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, 2), (4, 4)], "id int, v int")
    got = {r.id: r.score for r in tables.percentile_score(df, "v").collect()}
    assert got == {1: 25, 2: 62, 3: 62, 4: 100}
    low = {r.id: r.score for r in tables.percentile_score(df, "v", False).collect()}
    assert low == {1: 75, 2: 38, 3: 38, 4: 0}
    nulls = spark.createDataFrame([(1, None), (2, 5)], "id int, v int")
    assert {r.id: r.score for r in tables.percentile_score(nulls, "v").collect()} == {1: 50, 2: 100}


def test_registry_is_consistent():
    assert registry.check_registry() == []
    assert len(registry.DATASETS) == 18 and len(registry.METRICS) == 19
    assert registry.overlapping_pairs() == [("311_sanitation", "housing_violations"), ("311_sanitation", "rodent")]


def test_duplicated_sources(spark):
    m = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "metric string, source string")
    assert [tuple(r) for r in tables.duplicated_sources(m).collect()] == [("x", 2)]


def test_similar_places(spark):
    s = spark.createDataFrame([(1, 50, 50), (2, 51, 50), (3, 90, 10), (4, 50, 53)], "target_id int, a int, b int")
    assert [(r.target_id, r.distance) for r in composite.similar(s, 1, ["a", "b"], 2).collect()] == [(2, 1.0), (4, 3.0)]


def test_baseline_sentences(spark):
    q = [F.lit(10.0), F.lit(20.0), F.lit(30.0)]
    assert _one(spark, score.baseline_sentence(F.lit(35.0), *q)) == "35 — among the worst ~25% citywide (median 20.0)"
    assert _one(spark, score.baseline_sentence(F.lit(12.0), *q)) == "12 — at or below city median of 20.0"
    assert _one(spark, score.baseline_sentence(F.lit(5.0), *q, higher_is_worse=False)) == "5 — among the lowest ~25% citywide (median 20.0)"


@pytest.mark.parametrize("pivots", [1, 7, 48])
def test_similar_places_equal_brute_force(spark, pivots):
    import math
    import random

    from placescore.plans import composite

    rng = random.Random(pivots)
    rows = [(i, rng.randint(0, 6), rng.uniform(0, 100), float(rng.randint(0, 3))) for i in range(300)]
    rows += [(1000 + i, 3, 50.0, 1.0) for i in range(150)]  # one vector held by a third of the rows
    rows += [(5000, None, 1.0, 1.0), (5001, 3, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "target_id int, a int, b double, c double")
    known = [r for r in rows if None not in r and r[2] == r[2]]
    want = set()
    for t, *x in known:
        best = sorted((round(math.dist(x, y), 4), o) for o, *y in known if o != t)[:5]
        want |= {(t, o, d, n + 1) for n, (d, o) in enumerate(best)}
    assert {tuple(r) for r in composite.similar_places(df, ["a", "b", "c"], 5, pivots).collect()} == want
    assert composite.similar_places(df.limit(0), ["a", "b", "c"]).collect() == []
    assert composite.similar_places(df.limit(1), ["a", "b", "c"]).collect() == []
