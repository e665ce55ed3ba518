"""The driver contract, and a sample of registered queries against their SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ["nation", "region", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations"]


def test_entry_and_registry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120


@pytest.mark.parametrize("name", ["flagship_worst_cells", "j06_radius_measures_500m", "j08_nearest_place", "d12_overview_tiles", "w12_anomaly"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    norm = lambda v: round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    want = sorted((tuple(norm(x) for x in r) for r in cur.fetchall()), key=str)
    got = sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=str)
    assert got == want


def test_sensitivity_is_registered_with_the_draws_of_the_reference(spark):
    from query_catalog import statistics
    from query_catalog.fixtures import ORACLES, QUERIES

    for name in ("d24_sensitivity_1000_draws", "a34_branch_effects_1000_draws", "d25_uncertainty_lookup_1000_draws"):
        assert name in QUERIES and "range(1000) r(i)" in ORACLES[name] and "range(60)" not in ORACLES[name]
    drawn = statistics.draws(spark, "/root/testdata/sf0.001", statistics.FULL_DRAWS)
    assert drawn.select("draw").distinct().count() == 1000
