"""Cleaning vocabulary, scanners, readers, publication gates."""

import json
import random

import pytest
from pyspark.sql import functions as F

from placescore.functions import text
from placescore.operators import tables
from placescore.plans import evals, quality, search
from placescore.session import scratch_path
from placescore.sources import publish, readers


def test_scanner_examples_and_severity(spark):
    rows = [(1, " a", "2024-01-01", 5.0, 95.0), (2, "b", "01/02/2024", -1.0, 40.0), (3, "B", "2024-13-45", 0.0, 40.0), (4, "c", "2024-02-01", 3.0, None)]
    df = spark.createDataFrame(rows, "id int, name string, day string, price double, lat double")
    got = {(r.type, r["column"]): r for r in quality.scan_quality(df, "id").collect()}
    assert got[("whitespace_drift", "name")].example_rows == [1]
    assert got[("casing_inconsistency", "name")].n == 1
    assert got[("mixed_date_formats", "day")].severity == "high"
    assert got[("invalid_dates", "day")].example_rows == [3]
    assert got[("negative_value_unexpected", "price")].example_rows == [2]
    assert got[("suspicious_zero", "price")].n == 1
    assert got[("geographic_out_of_bounds", "lat")].example_rows == [1]


def test_every_operation_runs(spark):
    df = spark.createDataFrame(
        [(1, " Ab ", "1", "yes", 40.7, -74.0, "POLYGON ((0.0 0.0, 2.0 0.0, 2.0 2.0, 0.0 2.0, 0.0 0.0))", "12"), (1, " Ab ", "1", "yes", 40.7, -74.0, None, "x")],
        "id int, name string, n string, flag string, lat double, lon double, geom string, extra string",
    )
    plan = [
        {"op": "strip_whitespace", "column": "name"},
        {"op": "transform_case", "column": "name", "mode": "upper"},
        {"op": "replace_values", "column": "name", "mapping": {"AB": "X"}},
        {"op": "cast_type", "column": "n", "target_type": "BIGINT"},
        {"op": "cast_type", "column": "flag", "target_type": "BOOLEAN"},
        {"op": "cast_type", "column": "extra", "target_type": "UTINYINT"},
        {"op": "add_cell_index", "lat_col": "lat", "lon_col": "lon"},
        {"op": "transform_coords", "x_col": "lon", "y_col": "lat", "source_crs": "EPSG:4326"},
        {"op": "polygon_centroid", "geom_col": "geom"},
        {"op": "drop_nulls", "column": "geom"},
        {"op": "filter_rows", "column": "n", "condition": "neq", "value": 5},
        {"op": "rename_column", "old_name": "n", "new_name": "count"},
        {"op": "drop_column", "column": "extra"},
        {"op": "drop_duplicates"},
    ]
    out, log = quality.run_plan(df, plan)
    assert {r.status for r in log.collect()} == {"ok"}
    r = out.first()
    assert (r.name, r["count"], r.flag, r.centroid_lon, r.centroid_lat) == ("X", 1, True, 1.0, 1.0)
    assert set(quality.OPERATIONS) == {p["op"] for p in plan}


def test_refused_parameters(spark):
    df = spark.createDataFrame([(1, "a")], "id int, name string")
    plan = [
        {"op": "cast_type", "column": "id", "target_type": "MONEY"}, {"op": "rename_column", "old_name": "id", "new_name": "name"},
        {"op": "filter_rows", "column": "id", "condition": "between", "value": 1}, {"op": "transform_case", "column": "name", "mode": "camel"}, {"op": "nope"},
    ]
    out, log, _ = quality.apply_plan(df, plan)
    assert [e["status"] for e in log] == ["skipped"] * 5 and out.columns == ["id", "name"]


def test_domain_gate_raises(spark):
    from placescore.plans import datasets

    good = spark.createDataFrame([("10001", 1), ("10002", 5)], "zip string, ordinal int")
    assert {r.score for r in datasets.build_ordinal(good, "zip", "ordinal").collect()} == {100, 0}
    bad = spark.createDataFrame([("10001", 9)], "zip string, ordinal int")
    with pytest.raises(Exception, match="ordinal out of domain"):
        datasets.build_ordinal(bad, "zip", "ordinal").collect()


def test_csv_encodings_and_na(spark, tmp_path):
    (tmp_path / "latin.csv").write_bytes("id,name\n1,Caf\xe9\n2,N/A\n".encode("latin-1"))
    got = {r.id: r.name for r in readers.read_csv_na(spark, str(tmp_path / "latin.csv")).collect()}
    assert got == {"1": "Café", "2": None}
    (tmp_path / "mark.csv").write_bytes("﻿id,name\n1,é\n".encode())
    r = readers.read_csv_na(spark, str(tmp_path / "mark.csv"))
    assert r.columns == ["id", "name"] and r.first().name == "é"
    (tmp_path / "bad.csv").write_text("id,name\n1,a\n2,b,c,d\n")
    with pytest.raises(Exception):  # noqa: B017
        readers.count_strict(spark, str(tmp_path / "bad.csv"))


def test_acs_features_and_responses(spark, tmp_path):
    (tmp_path / "acs.dat").write_text("GEO_ID|E|M\n1400000US36061000100|9000|100\n1400000US34017000100|1|1\n")
    a = readers.read_acs(spark, str(tmp_path / "acs.dat"), ["36061"], "E", "M").collect()
    assert [tuple(r) for r in a] == [("36061000100", 9000.0, 100.0)]
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"NTAName": "A"}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
        {"type": "Feature", "properties": {"ntaname": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}},
    ]}
    (tmp_path / "z.geojson").write_text(json.dumps(doc, indent=1))
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        f = readers.read_features(spark, str(tmp_path / "z.geojson"), {"zone_name": ["NTAName", "ntaname"]}).collect()
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")
    assert {r.zone_name: len(r["shape"]) for r in f} == {"A": 1, "B": 2}
    (tmp_path / "r.jsonl").write_text('{"case_id": "a", "response": {"answer": "x"}}\n{"case_id": "b", "answer": "y"}\n\n')
    got = {r.case_id: json.loads(r.response) for r in readers.read_responses(spark, str(tmp_path / "r.jsonl")).collect()}
    assert got["a"] == {"answer": "x"} and got["b"]["answer"] == "y"


def test_publication_gate_fails_closed(spark):
    path = scratch_path(spark, "table")
    publish.publish(spark.range(100).withColumn("v", F.col("id") * 2), path)
    m = spark.createDataFrame(publish.make_manifest(spark, path, "1.0").collect())
    assert publish.read_published(spark, path, m, "1.0").count() == 100
    assert publish.read_published(spark, path, m, "2.0") is None
    assert publish.read_published(spark, path, None, "1.0") is not None
    publish.publish(spark.range(100).withColumn("v", F.col("id") * 3), path)
    assert publish.read_published(spark, path, m, "1.0") is None
    assert publish.read_published(spark, path + "x", None, "1.0") is None
    files = publish.fingerprint(spark, path).where("path like '%.parquet'")
    declared = files.select(F.substring_index("path", "/", -1).alias("file"), "sha256", "size_bytes")
    assert publish.validate_snapshot(declared, files).isEmpty()
    assert publish.validate_snapshot(declared.withColumn("sha256", F.lit("0")), files).count() == declared.count()


def test_gate_refusal_leaves_the_old_table(spark):
    path = scratch_path(spark, "gated")
    publish.publish(spark.range(5), path)
    with pytest.raises(RuntimeError, match="gate refused"):
        publish.rebuild(spark.range(7), path, lambda d: d.agg(F.count_if(F.col("id") > 5).alias("too_big")))
    assert spark.read.parquet(path).count() == 5


def test_filter_document_shapes(spark):
    df = spark.createDataFrame([(i, "x" if i % 2 else "y") for i in range(10)], "n int, k string")
    r = search.query_rows(df, {"n": {"min": 3}, "k": "x", "zz": 1, "n2": []}, ["n"], 2).collect()
    assert [(x.n, x.total, x.unapplied) for x in r] == [(3, 4, "zz,n2"), (5, 4, "zz,n2")]
    assert search.query_rows(df, {"n": {"around": 3}}, ["n"]).first().error == "unsupported filter for n"


def test_search_borough_and_source_order(spark):
    a = spark.createDataFrame([(1, "350 5 AVENUE", "MANHATTAN"), (2, "350 6 AVENUE", "BROOKLYN"), (3, "1350 5 AVENUE", "MANHATTAN")], "place_id int, name string, borough string")
    b = spark.createDataFrame([(9, "Union Square"), (10, "Union Square Park North")], "place_id int, name string")
    q = spark.createDataFrame([(1, "350 5th Avenue, Manhattan, NY"), (2, "union square Manhattan"), (3, "nowhere"), (4, "350 avenue Brooklyn")], "query_id int, query string")
    got = sorted((r.query_id, r.place_id, r["rank"]) for r in search.search(q, [a, b]).collect())
    assert got == [(1, 1, 1), (2, 9, 1), (2, 10, 2), (4, 2, 1)]


def test_text_helpers(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(text.canon(F.lit("it‘s “ok”​ –"))) == "it's \"ok\" -"
    assert one(text.json_object(F.lit('say ```json\n{"a": 1}\n``` end'))) == '{"a": 1}'
    assert one(text.json_object(F.lit("{broken"))) is None
    assert one(text.is_subsequence(F.array(F.lit("a"), F.lit("c")), F.array(F.lit("a"), F.lit("b"), F.lit("c")))) is True
    assert one(text.is_subsequence(F.array(F.lit("c"), F.lit("a")), F.array(F.lit("a"), F.lit("b"), F.lit("c")))) is False
    assert one(text.sentence_count(F.lit("At 40.72 N. See approx. this! Done?"))) == 3


def test_counts_run_on_a_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(100).select((40.70 + F.col("id") / 10000).alias("lat"), F.lit(-74.0).alias("lon")).write.parquet(src)
    from placescore.operators.spatial import with_cell

    stream = spark.readStream.schema("lat double, lon double").parquet(src)
    counted = tables.count_by(with_cell(stream), "cell")
    run = counted.writeStream.outputMode("complete").format("memory").queryName("live_cells").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    batch = tables.count_by(with_cell(spark.read.parquet(src)), "cell")
    assert sorted(map(tuple, spark.table("live_cells").collect())) == sorted(map(tuple, batch.collect()))


def _plain_label(token, pool):
    v, values = float(token), [float(t) for t in pool]

    def near(other):
        return abs(v - other) <= max(0.005, 0.0005 * max(abs(v), abs(other)))

    if token in pool:
        return "literal"
    if any(abs(v - p) <= 0.5 for p in values):
        return "rounded"
    if any(near(a - b) or near(a + b) or (b != 0 and near(a / b * 100)) for a in values for b in values):
        return "derived"
    return "unsupported"


def test_a_large_pool_grounds_its_largest_values(spark):
    pool = [str(x) for x in range(1000, 1200)] + ["5000"]
    rows = spark.createDataFrame([(1, ["5000.4", "1100", "4999.7", "6100", "88", "999999"], pool), (2, ["55"], [])], "k int, c array<string>, s array<string>")
    got = {(r.k, r.token): r.label for r in evals.classify_numbers(rows, "k", "c", "s").collect()}
    assert got == {(1, "5000.4"): "rounded", (1, "1100"): "literal", (1, "4999.7"): "rounded", (1, "6100"): "derived", (1, "88"): "derived", (1, "999999"): "unsupported", (2, "55"): "unsupported"}


def test_grounding_equals_the_plain_rule(spark, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(evals, "VALUES_PER_PART", 3)
    number = lambda: rng.choice([str(rng.randint(10, 99)), f"{rng.uniform(0, 5):.3f}", str(rng.randint(1000, 10**6)), f"{rng.uniform(0, 0.1):.5f}", "0.0", str(rng.randint(10**14, 10**16)), f"{rng.uniform(100, 9000):.2f}"])
    groups = [(k, [number() for _ in range(40)], [number() for _ in range(rng.choice([0, 1, 3, 6]))]) for k in range(12)]
    rows = spark.createDataFrame(groups, "k int, c array<string>, s array<string>")
    got = {(r.k, r.token): r.label for r in evals.classify_numbers(rows, "k", "c", "s").collect()}
    assert got == {(k, t): _plain_label(t, set(s)) for k, c, s in groups for t in c}
    assert set(got.values()) == {"literal", "rounded", "derived", "unsupported"} or len(set(got.values())) >= 3


def test_no_literal_or_cast_ends_a_cleaning_run(spark):
    rows = [(1, 5.0, "a", "1"), (2, None, "7", "x"), (3, 3.0, None, "0"), (4, float("nan"), "A", None)]
    df = spark.createDataFrame(rows, "id int, n double, t string, f string")
    keep = lambda **step: sorted(r.id for r in quality.run_plan(df, [{"op": "filter_rows", **step}])[0].collect())
    assert keep(column="t", condition="in", values=[1, "a"]) == [1]
    assert keep(column="t", condition="in", values=[7, "a", True]) == [1, 2]
    assert keep(column="n", condition="in", values=["x", 3]) == [3]
    assert keep(column="n", condition="neq", value="abc") == [1, 2, 3, 4]
    assert keep(column="n", condition="gt", value="abc") == [1, 2, 3, 4]  # skipped
    plan = [{"op": "filter_rows", "column": "n", "condition": "gt", "value": "abc"}, {"op": "cast_type", "column": "f", "target_type": "INTEGER"}, {"op": "filter_rows", "column": "t", "condition": "lt", "value": 8}, {"op": "cast_type", "column": "t", "target_type": "DATE"}]
    out, log = quality.run_plan(df, plan)
    assert [(r.status, r.rows_before, r.rows_after, r.faults) for r in log.orderBy("step").collect()] == [("skipped", 4, 4, 0), ("ok", 4, 4, 1), ("ok", 4, 1, 2), ("ok", 1, 1, 1)]
    assert [(r.id, r.f, r.t) for r in out.collect()] == [(2, None, None)]


def test_filter_document_meets_each_literal_as_what_it_is(spark):
    df = spark.createDataFrame([(1, "a"), (2, "1"), (3, "2.5")], "id int, t string")
    ids = lambda filters: sorted(r.id for r in df.where(search.fold_filters(df, filters)[0]).collect())
    assert ids({"t": [1, "a"]}) == [1, 2] and ids({"id": ["x", 3]}) == [3] and ids({"id": "x"}) == [] and ids({"t": {"min": 1, "max": 2.5}}) == [2, 3]
    assert search.fold_filters(df, {"id": {"min": "x"}})[2] == ["id"] and search.fold_filters(df, {"t": {"min": [1]}})[2] == ["t"]


def test_table_digest_ignores_order_and_sees_a_doubled_file(spark):
    one = spark.createDataFrame([("a" * 64,), ("b" * 64,), ("0" * 63 + "1",)], "sha256 string")
    digest = lambda df: publish.folded(df).first().sha256
    assert digest(one) == digest(one.orderBy(F.desc("sha256")).repartition(3)) != digest(one.unionByName(one.limit(1)))
    assert digest(one.limit(0)) != digest(one)


def test_large_files_are_hashed_as_a_stream(spark, tmp_path):
    import hashlib

    for i, n in enumerate((10, 5000, 300_000)):
        (tmp_path / f"f{i}.txt").write_bytes(bytes(range(256)) * (n // 256) + b"x" * (n % 256))
    want = {p.name: (hashlib.sha256(p.read_bytes()).hexdigest(), p.stat().st_size) for p in tmp_path.iterdir()}
    for limit in (1, 1000, 1 << 30):
        got = {r.path.rsplit("/", 1)[1]: (r.sha256, r.size_bytes) for r in publish.fingerprint(spark, str(tmp_path), limit).collect()}
        assert got == want


def test_a_burst_in_one_moment_is_split_and_counted(spark):
    rng = random.Random(6)
    rows = [(rng.randint(0, 50), f"2024-01-01 00:{m:02d}:00") for m in range(60) for _ in range(5)]
    rows += [(rng.randint(0, 5000), "2024-01-01 00:30:00") for _ in range(2000)] + [(7, "2024-01-01 00:40:00")] * 500
    df = spark.createDataFrame(rows, "k int, t string").withColumn("t", F.to_timestamp("t"))
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    want = sum(b[0] <= a[0] for a, b in zip(ordered, ordered[1:], strict=False))
    got = quality.increasing_violations(df.repartition(7), "k", "t").first()
    assert (got.violations, got.rows) == (want, len(rows))
    assert quality.increasing_violations(df.limit(1), "k", "t").first().violations == 0
