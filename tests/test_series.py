"""Period hygiene, persistence, anomaly and patterns."""

import datetime as dt

from pyspark.sql import functions as F

from placescore.functions import clean
from placescore.operators import tables
from placescore.plans import series


def _series(spark, rows):
    return spark.createDataFrame(rows, "target_id int, signal string, quarter string, value double, period_complete boolean")


def test_persistence_breaks_on_gap_null_and_threshold(spark):
    rows = [
        *[(1, "a", f"2024Q{q}", 30.0, True) for q in (1, 2, 3, 4)],
        (1, "a", "2025Q1", 1.0, False),
        *[(2, "a", q, 30.0, True) for q in ("2024Q1", "2024Q3", "2024Q4")],
        (3, "a", "2024Q3", 30.0, True), (3, "a", "2024Q4", None, True),
        (4, "a", "2024Q3", 30.0, True), (4, "a", "2024Q4", 25.0, True),
    ]
    got = {r.target_id: r.consecutive_above for r in series.persistence(_series(spark, rows), ["target_id"], F.lit(25)).collect()}
    assert got == {1: 4, 2: 2, 3: 0, 4: 0}
    none = series.persistence(_series(spark, rows), ["target_id"], F.lit(None).cast("int")).collect()
    assert {r.consecutive_above for r in none} == {0}


def test_anomaly_cases(spark):
    rows = [(1, "a", f"2023Q{q}", v, True) for q, v in zip((1, 2, 3, 4), (10.0, 12.0, 11.0, 30.0))]
    rows += [(2, "a", f"2023Q{q}", 5.0, True) for q in (1, 2, 3)]
    rows += [(3, "a", f"2023Q{q}", v, True) for q, v in zip((1, 2, 3, 4), (5.0, 5.0, 5.0, 6.0))]
    got = {r.target_id: r for r in series.anomaly(_series(spark, rows), ["target_id"]).collect()}
    assert got[1].is_anomaly and got[1].context == "above_historical_mean" and got[1].latest_period == "2023Q4"
    assert got[2].context == "insufficient_history" and got[2].z_score is None
    assert got[3].is_anomaly and got[3].z_score is None


def test_bad_dates_are_quarantined(spark):
    rows = [("1900-01-01",), ("0219-07-01",), ("2024-05-02",), ("2099-01-01",), (None,)]
    df = spark.createDataFrame(rows, "d string").select(F.lit(1).alias("k"), F.col("d").try_cast("date").alias("d"))
    got = tables.quarterly(df, "k", "d", F.lit(dt.date(2026, 1, 1))).collect()
    assert [(r.quarter, r["count"]) for r in got] == [("2024Q2", 1)]


def test_canonical_quarters(spark):
    df = spark.createDataFrame([("2024Q1",), ("2024-Q1",), ("1999Q4",), ("2024Q5",), ("2027Q1",)], "q string")
    got = [r[0] for r in df.select(clean.canonical_quarter(F.col("q"), F.lit(dt.date(2026, 8, 1)))).collect()]
    assert got == ["2024-Q1", "2024-Q1", None, None, None]


def test_patterns_need_both_sides_stressed(spark):
    rows = []
    for t in (1, 2):
        for i in range(12):
            q = f"{2021 + i // 4}Q{i % 4 + 1}"
            rows += [(t, "x", q, float(i), True), (t, "y", q, float(i * i), True), (t, "z", q, float((i * 7) % 5), True)]
    d = spark.createDataFrame([(1, "x", "worsening"), (1, "y", "elevated"), (1, "z", "worsening"), (2, "x", "worsening"), (2, "y", "stable")], "target_id int, signal string, direction string")
    got = series.patterns(_series(spark, rows), d).collect()
    assert [(r.target_id, r.pattern_id, r.severity) for r in got] == [(1, "pattern_x_y", "high")]
    assert got[0].title == "x and y are diverging stress (rho=+1.00)"


def test_evidence_and_verification(spark):
    q = spark.createDataFrame([(1, "rodent_500m", "old"), (1, "rodent_500m", "older")], "target_id int, evidence_id string, summary string")
    t = spark.createDataFrame([(1, "rodent", "s")], "target_id int, signal string, summary string")
    e = series.evidence(q, t)
    assert {(r.evidence_id, r.summary) for r in e.collect()} == {("rodent_500m", "older"), ("trend_rodent", "s")}
    a = spark.createDataFrame([(1, "rodent", ["rodent_500m", "trend_rodent"]), (1, "fire", ["fire", "trend_fire"])], "target_id int, signal string, evidence_ids array<string>")
    assert [r.signal for r in series.verify(a, e).collect()] == ["rodent"]
