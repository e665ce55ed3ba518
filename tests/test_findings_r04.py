"""Findings of round 4: pairs of a radius join, tallies of crowded tiles, the packing program."""

import pytest
from pyspark.sql import functions as F

from placescore.operators import spatial


def test_pairs_round_a_distance_once_per_coordinate(spark):
    """before, every pair rounded its distance, and the facts were shuffled once more to learn which cells are heavy."""
    import __spark_entry__ as entry

    df = entry.queries()["j06_radius_join_rows_200m"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(_facts") < plan.index("round(")  # the explode stands above
    assert all("_fact#" not in line for line in plan.splitlines() if "round(" in line)
    physical = df._jdf.queryExecution().executedPlan().toString()
    facts = [line for line in physical.splitlines() if "Exchange hashpartitioning(cell" in line]
    assert len([line for line in facts if "_salt" not in line]) == 2  # the two counts of cells


def test_pairs_with_rounded_distances_are_the_same_pairs(spark):
    f = spark.createDataFrame([(i, f"n{i}", 40.71 + i % 60 * 0.0001, -74.0) for i in range(600)], "fact_id int, name string, lat double, lon double")
    t = spark.createDataFrame([(1, 40.71, -74.0), (2, 40.7123, -74.0001)], "target_id int, lat double, lon double")
    for facts in (f, f.drop("name"), f.drop("name", "fact_id")):
        kept = [c for c in ("target_id", "fact_id", "name", "lat") if c in ("target_id", *facts.columns)]
        plain = spatial.radius_join(t, facts, 200.0).select(*kept, F.round("distance_sq", 2).alias("distance_sq"))
        for most in (50_000, 40):
            got = spatial.radius_join(t, facts, 200.0, rows_per_task=most, digits=2).select(*kept, "distance_sq")
            assert sorted(got.collect()) == sorted(plain.collect()) and got.count() > 300
    heavy = spatial.radius_join(t, f.withColumn("name", F.when(F.col("fact_id") > 300, F.col("name"))).select("name", "lat", "lon"), 200.0)
    assert heavy.where("name IS NULL").count() > 100  # a row without its only other value is a row


def test_a_crowded_tile_is_taken_tally_by_tally(spark, monkeypatch):
    """before, a tile with too many facts around it went by pairs of targets and facts, and every 500 targets shuffled the facts once more."""
    from placescore.plans import signals
    from placescore.plans.signals import Signal, Tally

    f = spark.createDataFrame([(i, i % 40, i % 3, 40.71 + i % 50 * 0.0001, -74.0) for i in range(4000)], "id bigint, who int, kind int, lat double, lon double")
    t = spark.createDataFrame([(i, 40.71 + i * 0.0001, -74.0) for i in range(60)], "target_id bigint, lat double, lon double")
    one = Signal("one", f, 500.0, {n: Tally(F.col(c)) for n, c in (("who", "who"), ("kind", "kind"), ("all", "id"))})
    two = Signal("two", f.where("kind = 0"), 150.0, {"all": Tally(), "size": Tally(F.col("who"), amount=F.col("id") - 900)})
    keep, by_value = {("one", "who"): 7}, [("one", "kind")]
    want = sorted(map(tuple, signals.most_frequent(signals.tallies(t, [one, two]), keep, by_value).collect()))
    moved = []
    plain = signals.tallies
    monkeypatch.setattr(signals, "tallies", lambda targets, kept: moved.append({n for s in kept for n in s.tallies}) or plain(targets, kept))
    for most, left in ((3500, []), (1500, [{"all"}])):  # 4,000 facts of one tally, 2,000 of the next; then 4,000 are too many
        moved.clear()
        monkeypatch.setattr(signals, "TILE_ROWS", most)
        monkeypatch.setattr(signals, "TILE_TARGETS", 1)
        monkeypatch.setattr(signals, "ROWS_OUT", 50)
        assert sorted(map(tuple, signals.ranked_tallies(t, [one, two], keep, by_value).collect())) == want
        assert moved == left


def test_parts_of_targets_follow_the_cores(spark, monkeypatch):
    from placescore.plans import signals
    from placescore.plans.signals import Signal, Tally

    monkeypatch.setattr(signals, "TILE_TARGETS", 5)
    f = spark.createDataFrame([(i, 40.7101, -74.0) for i in range(50)], "id bigint, lat double, lon double")
    t = spark.range(4000).select(F.col("id").alias("target_id"), F.lit(40.71).alias("lat"), F.lit(-74.0).alias("lon"))
    out = signals.ranked_tallies(t, [Signal("one", f, 500.0, {"all": Tally()})], {})
    assert out.rdd.getNumPartitions() <= 4 * signals.PARTS_PER_CORE * spark.sparkContext.defaultParallelism
    assert out.where("n = 50 AND rank = 1").count() == 4000


def test_the_packing_program_is_solved_to_its_end():
    """before, the program stopped after 3 passes of 40 fillings; it covered few lengths, so best-fit placed nearly all."""
    from collections import Counter

    import numpy as np

    from placescore.llm import packing

    counts = {int(k): v for k, v in Counter(np.random.default_rng(1).integers(340, 520, 5_000).tolist()).items() if k % 4 == 0}
    program, bound = packing.fractional(counts, 1024, 3.0, 30, 0.05)
    held = Counter()
    for filling, times in program.items():
        for length, k in filling:
            held[length] += k * times
    share = {length: held[length] / n for length, n in counts.items()}
    assert max(share.values()) == pytest.approx(1.0) and set(share) == set(counts)
    placed = packing.rounded(program, left := dict(counts))
    assert sum(left.values()) < 0.3 * sum(counts.values()) and sum(placed.values()) > 0.7 * bound
    chosen, got = packing.plan(counts, 1024), Counter()
    for filling, times in chosen.items():
        assert sum(length * k for length, k in filling) <= 1024
        for length, k in filling:
            got[length] += k * times
    assert got == counts
    assert bound <= sum(chosen.values()) < sum(packing.best_fit(counts, 1024).values())
