"""Small cases of the third round's findings."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from placescore.functions import cells
from placescore.plans import series, signals
from placescore.plans.signals import Signal, Tally


def test_a_zero_has_no_sign(spark):
    """both engines say +0.0 of a change that rounds to nothing."""
    row = "'x' AS signal, 4 AS last_30d, 4 AS prev_30d, -0.0D AS recent, 1 AS last_90d, 1 AS same_90d_last_year, -0.0D AS seasonal, -0.0D AS gap, 'average' AS gap_label, 0 AS persistence"
    told = spark.sql(f"SELECT {row}").select(series.trend_sentence(spark.sql(f"SELECT {row}"))).first()[0]
    assert "-0.0" not in told and told.count("(+0.0 %)") == 2 and "to baseline +0.0 %" in told
    said = entry.oracle_sql()["d21_trend_evidence"]
    assert all(f"printf('%+.1f %%', {c} + 0.0)" in said for c in ("recent", "seasonal", "gap"))


def test_scan_quality_sql_knows_copies_and_zeros():
    """rows equal but for their id, and zeros among balances, are faults by the query's rule."""
    con = duckdb.connect()
    rows = "SELECT 2310 * r.i AS c_custkey, 'n' AS c_name, 'S' AS c_mktsegment, CASE WHEN r.i < 3 THEN 5.0::DOUBLE WHEN r.i = 3 THEN 0.0 ELSE r.i::DOUBLE END AS c_acctbal FROM range(0, 9) r(i)"
    con.execute(f"CREATE TABLE customer AS SELECT c_custkey * 4200000 AS c_custkey, * EXCLUDE (c_custkey) FROM ({rows})")
    got = {r[0]: r[2] for r in con.execute(entry.oracle_sql()["d36_scan_quality"]).fetchall()}
    assert got["exact_row_duplicates"] == 4 and got["suspicious_zero"] == 1


def test_wkt_texts_are_read_once(spark):
    """a pair is taken by one pass, and a run of digits without a point costs no retries."""
    t = spark.sql("SELECT concat('LINESTRING (', repeat('1', 20000), ' 5 7, -73.5 40.25, 8 9, 1.0  -2.5)') AS w, 'POLYGON ((0.0 0.0, 2.0 0.0, 2.0 2.0, 0.0 2.0, 0.0 0.0))' AS p")
    got = t.select(cells.wkt_vertices(F.col("w")).alias("v"), cells.polygon_centroid(F.col("p")).alias("c"), cells.polygon_centroid(F.col("w")).alias("none")).first()
    assert [tuple(x) for x in got.v] == [(-73.5, 40.25), (1.0, -2.5)] and tuple(got.c) == (1.0, 1.0) and got.none is None


def test_distinct_values_are_counted_without_a_list(spark, monkeypatch):
    """evidence needs the number of businesses, not a row per business and target."""
    f = spark.createDataFrame([(i, i % 40, 40.71 + (i % 9) * 1e-4, -74.0) for i in range(400)], "id int, who int, lat double, lon double")
    t = spark.createDataFrame([(1, 40.71, -74.0), (2, 40.9, -73.7)], "target_id int, lat double, lon double")
    s = Signal("b", f, 500.0, {"all": Tally(), "who": Tally(F.col("who"), F.col("who") < 30), "listed": Tally(F.col("id"))})
    made = []
    plain = signals.tally_cells
    monkeypatch.setattr(signals, "tally_cells", lambda x: made.extend(x.tallies) or plain(x))
    got = signals.state(t, [s], {"n": ("b", "all", "n", ""), "whos": ("b", "who", "values", "")}).orderBy("target_id").collect()
    assert [tuple(r) for r in got] == [(1, 400, 30), (2, 0, 0)] and made == ["all"]


def test_packing_turns_few_documents_into_texts_at_once():
    """Pipeline: the texts of a whole Arrow batch took it over the memory of an executor."""
    import pyarrow as pa

    from placescore.llm import packing

    got = list(packing.few_rows(iter([pa.record_batch({"doc_id": list(range(2500))}), pa.record_batch({"doc_id": [9]})])))
    assert [b.num_rows for b in got] == [1000, 1000, 500, 1] and [x for b in got for x in b.column(0).to_pylist()] == [*range(2500), 9]
