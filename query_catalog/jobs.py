"""Composite jobs: dataset builds, composite scores, roll-ups, trends, priorities, evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from placescore.functions import cells, clean, score
from placescore.operators import spatial, tables
from placescore.plans import composite, datasets, registry, rollup, series
from placescore.session import cut_lineage
from query_catalog.fixtures import (
    FACTS, INCIDENTS, KIND_METRIC, PLACES, TARGETS, ZONES, as_of, cell_counts, ctes, facts, incidents, places, query, sql_cell,
    sql_clamp, sql_in_zone, sql_ix, sql_iy, sql_parent, sql_pct, table, targets, with_as_of, zones,
)

# ---- dataset builds ----------------------------------------------------------------------------


def raw_restaurants(spark, sf):
    """Inspection rows as text, the way a CSV delivers them."""
    i = incidents(spark, sf)
    return i.select(
        F.col("entity_id").cast("string").alias("CAMIS"),
        F.concat(F.lit("R"), F.col("entity_id").cast("string")).alias("DBA"),
        F.date_format("event_ts", "MM/dd/yyyy").alias("INSPECTION DATE"),
        F.when(F.col("kind") == "error", "Critical").otherwise("Not Critical").alias("CRITICAL FLAG"),
        F.lit("A").alias("GRADE"),
        F.col("lat").cast("string").alias("Latitude"),
        F.col("lon").cast("string").alias("Longitude"),
        F.lit("10001.0").alias("ZIPCODE"),
        F.lit("mn").alias("BORO"),
    )


@query(
    "d01_point_dataset_scores",
    ctes(INCIDENTS, """c AS (SELECT cell, count(DISTINCT entity_id) AS raw_count, count(*) AS inspection_count, count(*) FILTER (kind = 'error') AS critical_count,
      round_even(count(*) FILTER (kind = 'error') / count(*), 3) AS critical_rate FROM incidents GROUP BY cell)""",
         f"b AS (SELECT *, {sql_pct('raw_count')} AS a, {sql_pct('critical_rate', False)} AS q FROM c)")
    + f"SELECT cell, raw_count, inspection_count, critical_count, critical_rate, {sql_clamp('(a + q) / 2.0::DOUBLE')} AS score FROM b",
)
def d01(spark, sf):
    spec = registry.DATASETS_BY_NAME["amenities_restaurants"]
    return datasets.build(spec, raw_restaurants(spark, sf))["scores"]


@query(
    "d01_point_dataset_quarterly",
    ctes(INCIDENTS) + "SELECT cell, year(event_ts) || 'Q' || quarter(event_ts) AS quarter, count(*) AS count FROM incidents GROUP BY 1, 2",
)
def d01q(spark, sf):
    spec = registry.DATASETS_BY_NAME["amenities_restaurants"]
    return datasets.build(spec, raw_restaurants(spark, sf))["quarterly"]


@query(
    "d02_zip_response",
    f"""WITH z AS (SELECT lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS zip, round(avg(o_totalprice), 4) AS avg_response_seconds, count(*) AS incident_count FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
    SELECT *, {sql_pct('avg_response_seconds', False)} AS score FROM z""",
)
def d02(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    raw = table(spark, sf, "orders").join(c, "o_custkey").select(
        F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("ZIPCODE"),
        F.col("o_totalprice").cast("string").alias("INCIDENT_RESPONSE_SECONDS_QY"),
        F.lit("QN").alias("BOROUGH"),
    )
    out = datasets.build(registry.DATASETS_BY_NAME["safety_ems"], raw)["scores"]
    return out.withColumn("avg_response_seconds", F.round("avg_response_seconds", 4))


@query(
    "d03_zip_sum",
    f"""WITH z AS (SELECT lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS zip, sum(l_quantity) AS total_value, count(*) AS record_count FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)
    SELECT *, {sql_pct('total_value')} AS score FROM z""",
)
def d03(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    raw = table(spark, sf, "lineitem").select("l_suppkey", "l_quantity").join(s, "l_suppkey").select(
        F.lit("p").alias("NAME311"), F.col("l_quantity").cast("string").alias("ACRES"), F.lpad(F.col("s_nationkey").cast("string"), 5, "0").alias("ZIPCODE"), F.lit("SI").alias("BOROUGH"), F.lit("No").alias("WATERFRONT")
    )
    return datasets.build(registry.DATASETS_BY_NAME["amenities_parks"], raw)["scores"]


@query(
    "d04_location_index",
    ctes(PLACES) + "SELECT name AS matched_address, 'BROOKLYN' AS borough, zip, 'pluto_' || place_id AS canonical_location_id FROM places",
)
def d04(spark, sf):
    raw = places(spark, sf).select(
        F.col("name").alias("address"), F.lit("bk").alias("borough"), F.col("zip").alias("postcode"), F.col("lat").cast("string").alias("latitude"),
        F.col("lon").cast("string").alias("longitude"), F.when(F.col("place_id") % 2 == 0, F.col("place_id")).cast("string").alias("BBL"), F.col("place_id").cast("string").alias("appbbl"),
    )
    out = datasets.build(registry.DATASETS_BY_NAME["location_pluto"], raw)["indexed"]
    return out.select("matched_address", "borough", "zip", "canonical_location_id")


_LINE = ctes(PLACES, f"v AS (SELECT place_id, {sql_cell('round(lat, 9)', 'round(lon, 9)')} AS cell FROM places UNION ALL SELECT place_id, {sql_cell('round(lat, 9)', 'round(lon + 0.004::DOUBLE, 9)')} FROM places)",
             "c AS (SELECT cell, count(DISTINCT place_id) AS raw_count FROM v GROUP BY cell)")


def lines(spark, sf):
    n = lambda c: F.format_string("%.9f", c)
    return places(spark, sf).select(
        F.concat(F.lit("LINESTRING ("), n(F.col("lon")), F.lit(" "), n(F.col("lat")), F.lit(", "), n(F.col("lon") + 0.004), F.lit(" "), n(F.col("lat")), F.lit(")")).alias("the_geom"),
        F.col("place_id").cast("string").alias("segmentid"), F.lit("Current").alias("status"), F.col("name").alias("street"), F.lit("1").alias("boro"), F.lit("I").alias("allclasses"),
    )


@query("d05_line_dataset", _LINE + f"SELECT cell, raw_count, {sql_pct('raw_count')} AS score FROM c")
def d05(spark, sf):
    return datasets.build(registry.DATASETS_BY_NAME["transit_bike_routes"], lines(spark, sf))["scores"]


@query(
    "a19_apportioned_length",
    ctes(PLACES, "l AS (SELECT place_id, lat, lon, 0.004::DOUBLE * 111320::DOUBLE * 0.7580107::DOUBLE AS len FROM places)", "n AS (SELECT *, greatest(2, CAST(floor(len / 20) AS INT) + 1) AS n FROM l)",
         f"s AS (SELECT {sql_cell('lat', 'lon + i * 0.004::DOUBLE / (n - 1)')} AS cell, len / n AS share FROM n, range(40) r(i) WHERE i < n)")
    + "SELECT round(sum(share), 3) AS metres, count(DISTINCT cell) > 100 AS many_cells FROM s",
)
def a19(spark, sf):
    """Total length survives; per-cell shares are tested on a small fixture, samples on a cell edge may fall either side."""
    from placescore.operators import polygons

    v = places(spark, sf).select(
        "place_id", F.array(F.struct("lon", "lat"), F.struct((F.col("lon") + 0.004).alias("lon"), F.col("lat").alias("lat"))).alias("vertices")
    )
    e = polygons.apportion_length(v, "place_id")
    return e.agg(F.round(F.sum("exposure"), 3).alias("metres"), (F.count(F.lit(1)) > 100).alias("many_cells"))


@query("d06_rescore_from_index", ctes(INCIDENTS, "counts AS (SELECT cell, count(*) AS raw_count FROM incidents GROUP BY cell)") + f"SELECT cell, raw_count, {sql_pct('raw_count', False)} AS score FROM counts")
def d06(spark, sf):
    return datasets.rescore(registry.DATASETS_BY_NAME["safety_collisions"], incidents(spark, sf))


@query(
    "d08_rate_score",
    ctes(INCIDENTS, "m AS (SELECT max(CAST(event_ts AS DATE)) AS hi FROM incidents)",
         "c AS (SELECT cell, count(*) AS n, count(*) FILTER (kind = 'error') AS k FROM incidents, m WHERE CAST(event_ts AS DATE) BETWEEN hi - INTERVAL 3 YEAR AND hi GROUP BY cell)",
         "a AS (SELECT sum(k)::DOUBLE / sum(n)::DOUBLE AS mean, sum(n * (k / n) * (k / n)) / sum(n)::DOUBLE AS sq FROM c)", "v AS (SELECT mean, sq - mean * mean AS var FROM a)",
         "p AS (SELECT mean * greatest(mean * (1 - mean) / var - 1, 1.0) AS alpha, (1 - mean) * greatest(mean * (1 - mean) / var - 1, 1.0) AS beta FROM v)",
         "r AS (SELECT cell, n AS inspections, k AS positives, round((k + alpha) / (n + alpha + beta), 9) AS rate, round_even(k / n, 4) AS raw_rate FROM c, p)")
    + f"SELECT cell, inspections, positives, round(rate, 6) AS raw_count, raw_rate, {sql_pct('rate', False)} AS score FROM r",
)
def d08(spark, sf):
    """Ties in the shrunk rate are exact in both engines because equal (k, n) give equal rates."""
    i = tables.anchored_window(incidents(spark, sf), "event_ts", 3, F.lit("2030-01-01").cast("date"))
    return datasets.build_rate_score(i, F.col("kind") == "error").withColumn("raw_count", F.round("raw_count", 6))


@query(
    "d10_ordinal_scores",
    "SELECT CAST(10000 + p_partkey % 90000 AS VARCHAR) AS zip, p_size % 5 + 1 AS ordinal, CAST((5 - (p_size % 5 + 1)) * 25 AS INTEGER) AS score FROM part",
)
def d10(spark, sf):
    p = table(spark, sf, "part").select((10000 + F.col("p_partkey") % 90000).cast("string").alias("zip"), (F.col("p_size") % 5 + 1).alias("ordinal"))
    return datasets.build_ordinal(p, "zip", "ordinal")


@query(
    "d11_raster_scores",
    ctes(INCIDENTS, """raster AS (SELECT CAST(floor((lon + 74.0::DOUBLE) / 0.001::DOUBLE) AS INT) AS col, CAST(floor((40.74::DOUBLE - lat) / 0.0008::DOUBLE) AS INT) AS row, round(avg(value), 4) AS value FROM incidents GROUP BY 1, 2)""",
         ZONES, """grid AS (SELECT CAST(a.i + 1048576 AS BIGINT) * 2097152 + b.i + 1048576 AS cell, ((b.i + 0.5::DOUBLE) * 300::DOUBLE) / 111320::DOUBLE + 40.45::DOUBLE AS lat,
           ((a.i + 0.5::DOUBLE) * 300::DOUBLE) / 111320::DOUBLE / 0.7580107::DOUBLE - 74.30::DOUBLE AS lon FROM range(80, 105) a(i), range(90, 110) b(i))""",
         f"f AS (SELECT DISTINCT cell, lat, lon FROM grid JOIN zones ON {sql_in_zone('lat', 'lon')})",
         "v AS (SELECT cell, value AS raw_count FROM f JOIN raster ON raster.col = floor((lon + 74.0::DOUBLE) / 0.001::DOUBLE) AND raster.row = floor((40.74::DOUBLE - lat) / 0.0008::DOUBLE))")
    + f"SELECT cell, raw_count, {sql_pct('raw_count', False)} AS score FROM v",
)
def d11(spark, sf):
    """A surface gridded from incident values, sampled at the cell centres of the zones."""
    i = incidents(spark, sf)
    raster = i.groupBy(
        F.floor((F.col("lon") + 74.0) / 0.001).cast("int").alias("col"), F.floor((40.74 - F.col("lat")) / 0.0008).cast("int").alias("row")
    ).agg(F.round(F.avg("value"), 4).alias("value"))
    return datasets.build_raster_score(zones(spark), raster, {"x0": -74.0, "y0": 40.74, "pixel_w": 0.001, "pixel_h": 0.0008, "nodata": -9999.0})


# ---- long score table and roll-ups -------------------------------------------------------------


def metric_scores(spark, sf):
    """(cell, metric, raw_count, score) of the five metrics the event kinds stand for; one job for all."""
    metric = F.element_at(clean.literal_map(KIND_METRIC), F.col("kind"))
    counted = incidents(spark, sf).groupBy("cell", metric.alias("metric")).agg(F.count(F.lit(1)).alias("raw_count"))
    better = F.element_at(clean.literal_map({m.id: m.higher_is_better for m in registry.METRICS}), F.col("metric"))
    return tables.percentile_score(cut_lineage(counted), "raw_count", better, by=["metric"])


METRIC_SCORES = f"""mc AS (SELECT cell, CASE kind WHEN 'error' THEN 'collision' WHEN 'click' THEN '311_sanitation' WHEN 'view' THEN 'subway' WHEN 'purchase' THEN 'trees' ELSE 'linknyc' END AS metric, count(*) AS raw_count FROM incidents GROUP BY 1, 2),
  ms AS (SELECT cell, metric, raw_count, CASE WHEN metric IN ('subway', 'trees', 'linknyc') THEN {sql_pct('raw_count', True, 'metric')} ELSE {sql_pct('raw_count', False, 'metric')} END AS score FROM mc)"""

_REG = """reg AS (SELECT * FROM (VALUES ('collision', 'safety', 0.3125::DOUBLE), ('311_sanitation', 'safety', 0.125::DOUBLE), ('subway', 'transit', 5 / 14::DOUBLE), ('trees', 'amenities', 0.15::DOUBLE), ('linknyc', 'amenities', 0.10::DOUBLE)) AS r(metric, category, weight)),
  tot AS (SELECT * FROM (VALUES ('safety', 3, 0.5625::DOUBLE, 0.4::DOUBLE), ('transit', 4, 1.0::DOUBLE, 0.3::DOUBLE), ('amenities', 5, 0.75::DOUBLE, 0.3::DOUBLE)) AS t(category, total, w_total, w_overall))"""
# cell-grain weights: safety has collision, rodent, 311; amenities everything but the parks
_TILE = ctes(INCIDENTS, METRIC_SCORES, _REG, f"pm AS (SELECT {sql_parent('cell')} AS parent, metric, avg(score) AS v FROM ms GROUP BY 1, 2)",
             "cat AS (SELECT parent, category, sum(v * weight) / sum(weight) AS score, count(*) AS n, sum(weight) AS w FROM pm JOIN reg USING (metric) GROUP BY 1, 2)",
             """ov AS (SELECT parent, CAST(round_even(sum(score * w_overall) / sum(w_overall), 0) AS INTEGER) AS overall_score, sum(n) AS overall_coverage_n, round(sum(n) / 12, 4) AS overall_coverage_fraction,
               round(sum(round(w / w_total, 4) * w_overall), 4) AS overall_coverage_ratio FROM cat JOIN tot USING (category) GROUP BY 1)""")


@query(
    "d12_overview_tiles",
    _TILE + """SELECT parent, overall_score, overall_coverage_n, overall_coverage_fraction, overall_coverage_ratio,
      CASE WHEN overall_score >= 65 THEN 'low' WHEN overall_score >= 40 THEN 'moderate' ELSE 'high' END AS risk_level,
      (SELECT round(score, 6) FROM cat c WHERE c.parent = ov.parent AND category = 'safety') AS safety_score,
      (SELECT round(score, 6) FROM cat c WHERE c.parent = ov.parent AND category = 'amenities') AS amenities_score,
      coalesce((SELECT round(w / 0.75, 4) FROM cat c WHERE c.parent = ov.parent AND category = 'amenities'), 0) AS amenities_coverage_ratio FROM ov""",
)
def d12(spark, sf):
    metrics = [m for m in registry.METRICS if m.category in ("safety", "transit", "amenities")]
    t = rollup.build_overview(metric_scores(spark, sf), metrics, registry.CATEGORIES)
    return t.select(
        "parent", "overall_score", "overall_coverage_n", "overall_coverage_fraction", "overall_coverage_ratio", "risk_level",
        F.round("safety_score", 6).alias("safety_score"), F.round("amenities_score", 6).alias("amenities_score"), "amenities_coverage_ratio",
    )


@query(
    "a12_weighted_present",
    ctes(INCIDENTS, METRIC_SCORES, _REG, "t5 AS (SELECT category, count(*) AS total, sum(weight) AS wt FROM reg GROUP BY 1)")
    + """SELECT cell, category, round(sum(score * weight) / sum(weight), 6) AS score, count(*) AS available, any_value(total) AS total, round(count(*) / any_value(total), 4) AS fraction,
      round(sum(weight) / any_value(wt), 4) AS weight_ratio FROM ms JOIN reg USING (metric) JOIN t5 USING (category) GROUP BY 1, 2""",
)
def a12(spark, sf):
    long = metric_scores(spark, sf).select("cell", "metric", F.col("score").alias("value"))
    reg = registry.metrics_table(spark, ids=list(KIND_METRIC.values())).select("metric", "category", "weight")
    return tables.weighted_present(long, ["cell"], reg).withColumn("score", F.round("score", 6))


@query(
    "d13_zone_rollup",
    _TILE[:-1] + f""", {ZONES}, tl AS (SELECT parent, overall_score, overall_coverage_n, ((({sql_iy('parent')}) + 0.5::DOUBLE) * 900::DOUBLE) / 111320::DOUBLE + 40.45::DOUBLE AS lat,
       ((({sql_ix('parent')}) + 0.5::DOUBLE) * 900::DOUBLE) / 111320::DOUBLE / 0.7580107::DOUBLE - 74.30::DOUBLE AS lon, overall_coverage_ratio AS r FROM ov)
    SELECT zone_id, any_value(zone_name) AS zone_name, count(*) AS cell_count, CAST(round_even(avg(overall_score), 0) AS INTEGER) AS overall_score, sum(overall_coverage_n) AS overall_coverage_n, count(*) * 12 AS overall_coverage_total,
      round(avg(r), 4) AS overall_coverage_ratio, round(sum(overall_coverage_n) / (count(*) * 12), 4) AS overall_coverage_fraction,
      CASE WHEN round_even(avg(overall_score), 0) >= 65 THEN 'low' WHEN round_even(avg(overall_score), 0) >= 40 THEN 'moderate' ELSE 'high' END AS risk_level
    FROM tl JOIN zones ON {sql_in_zone('lat', 'lon')} GROUP BY zone_id""",
)
def d13(spark, sf):
    metrics = [m for m in registry.METRICS if m.category in ("safety", "transit", "amenities")]
    t = rollup.build_overview(metric_scores(spark, sf), metrics, registry.CATEGORIES)
    return rollup.build_zones(t, zones(spark), ["overall"])


@query(
    "d14_population_denominator",
    ctes(INCIDENTS, ZONES, f"h AS (SELECT zone_id, count(*)::DOUBLE AS total FROM incidents JOIN zones ON {sql_in_zone('lat', 'lon')} GROUP BY 1)",
         """grid AS (SELECT CAST(a.i + 1048576 AS BIGINT) * 2097152 + b.i + 1048576 AS cell, ((b.i + 0.5::DOUBLE) * 300::DOUBLE) / 111320::DOUBLE + 40.45::DOUBLE AS lat,
           ((a.i + 0.5::DOUBLE) * 300::DOUBLE) / 111320::DOUBLE / 0.7580107::DOUBLE - 74.30::DOUBLE AS lon FROM range(80, 105) a(i), range(90, 110) b(i))""",
         f"f AS (SELECT zone_id, cell FROM grid JOIN zones ON {sql_in_zone('lat', 'lon')})", "n AS (SELECT zone_id, count(*) AS k FROM f GROUP BY 1)")
    + "SELECT cell, round(sum(total / k), 6) AS population, round(sqrt(sum((sqrt(total) / k) ** 2)), 6) AS moe, count(DISTINCT zone_id) AS contributors FROM f JOIN h USING (zone_id) JOIN n USING (zone_id) GROUP BY cell",
)
def d14(spark, sf):
    from placescore.operators import polygons

    z = zones(spark)
    h = polygons.pip_join(incidents(spark, sf), z, "event_id").groupBy("zone_id").agg(F.count(F.lit(1)).cast("double").alias("total"))
    cells_out, _ = rollup.build_denominator(h.withColumn("moe", F.sqrt("total")), z)
    return cells_out.select("cell", F.round("population", 6).alias("population"), F.round("moe", 6).alias("moe"), "contributors")


def quarterly_cells(spark, sf):
    """Quarterly counts per cell of the orders' customers: many quarters, many cells."""
    p = places(spark, sf).select(F.col("place_id").alias("o_custkey"), cells.cell(F.col("lat"), F.col("lon")).alias("cell"))
    o = table(spark, sf, "orders").select("o_custkey", "o_orderdate").join(p, "o_custkey")
    return tables.quarterly(o, "cell", "o_orderdate")


_QC = f"qc AS (SELECT {sql_cell('lat', 'lon')} AS cell, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, count(*) AS n FROM orders JOIN places ON o_custkey = place_id WHERE true GROUP BY 1, 2)"


@query("w13_last_periods", ctes(PLACES, _QC) + "SELECT cell, quarter, n AS count FROM qc WHERE quarter IN (SELECT quarter FROM (SELECT DISTINCT quarter FROM qc) ORDER BY quarter DESC LIMIT 4)")
def w13(spark, sf):
    return series.last_periods(quarterly_cells(spark, sf), 4)


@query(
    "d30_timeline",
    ctes(PLACES, _QC, "k AS (SELECT quarter FROM (SELECT DISTINCT quarter FROM qc) ORDER BY quarter DESC LIMIT 6)", f"pp AS (SELECT DISTINCT {sql_parent('cell')} AS parent FROM qc)",
         f"s AS (SELECT {sql_parent('cell')} AS parent, quarter, sum(n) AS c FROM qc GROUP BY 1, 2)", "f AS (SELECT pp.parent, k.quarter, coalesce(c, 0) AS count FROM pp, k LEFT JOIN s ON s.parent = pp.parent AND s.quarter = k.quarter)".replace("pp, k LEFT", "pp CROSS JOIN k LEFT"),
         "b AS (SELECT quarter, min(count) AS lo, quantile_cont(count::DOUBLE, 0.25) AS q1, quantile_cont(count::DOUBLE, 0.5) AS q2, quantile_cont(count::DOUBLE, 0.75) AS q3 FROM f GROUP BY 1)")
    + "SELECT parent, quarter, count, (q1 > lo AND count >= round(q1, 2))::INT + (q2 > lo AND q2 > q1 AND count >= round(q2, 2))::INT + (q3 > lo AND q3 > q2 AND count >= round(q3, 2))::INT AS class FROM f JOIN b USING (quarter)",
)
def d30(spark, sf):
    return rollup.timeline(quarterly_cells(spark, sf), 6)


@query(
    "w14_class_breaks",
    ctes(INCIDENTS, "counts AS (SELECT cell, count(*) AS n FROM incidents GROUP BY cell)", "b AS (SELECT min(n) AS lo, quantile_cont(n::DOUBLE, 0.2) AS a, quantile_cont(n::DOUBLE, 0.4) AS b, quantile_cont(n::DOUBLE, 0.6) AS c, quantile_cont(n::DOUBLE, 0.8) AS d FROM counts)")
    + "SELECT cell, n, (a > lo AND n >= round(a, 2))::INT + (b > lo AND b > a AND n >= round(b, 2))::INT + (c > lo AND c > b AND n >= round(c, 2))::INT + (d > lo AND d > c AND n >= round(d, 2))::INT AS class FROM counts, b",
)
def w14(spark, sf):
    c = cell_counts(spark, sf, "n")
    b = rollup.class_breaks(c, "n", 5)
    return c.join(F.broadcast(b), F.lit(True)).select("cell", "n", rollup.class_index(F.col("n"), F.col("breaks")).alias("class"))


@query(
    "d29_bivariate_classes",
    ctes(INCIDENTS, "p AS (SELECT cell, count(*) FILTER (kind = 'error') AS a, count(*) FILTER (kind = 'view') AS b FROM incidents GROUP BY cell)",
         "q AS (SELECT min(a) AS la, quantile_cont(a::DOUBLE, 1/3::DOUBLE) AS a1, quantile_cont(a::DOUBLE, 2/3::DOUBLE) AS a2, min(b) AS lb, quantile_cont(b::DOUBLE, 1/3::DOUBLE) AS b1, quantile_cont(b::DOUBLE, 2/3::DOUBLE) AS b2 FROM p)")
    + """SELECT cell, ((a1 > la AND a >= round(a1, 2))::INT + (a2 > la AND a2 > a1 AND a >= round(a2, 2))::INT) AS class_a, ((b1 > lb AND b >= round(b1, 2))::INT + (b2 > lb AND b2 > b1 AND b >= round(b2, 2))::INT) AS class_b FROM p, q""",
)
def d29(spark, sf):
    p = incidents(spark, sf).groupBy("cell").agg(F.count_if(F.col("kind") == "error").alias("a"), F.count_if(F.col("kind") == "view").alias("b"))
    return rollup.bivariate(p, "a", "b").select("cell", "class_a", "class_b")


# ---- series, trends, priorities ----------------------------------------------------------------


def place_series(spark, sf):
    """(target_id, signal, quarter, value, period_complete) of all facts."""
    f = with_as_of(facts(spark, sf), "day")
    q = f.groupBy(F.col("place").alias("target_id"), "signal", clean.quarter_label(F.col("day")).alias("quarter"), clean.quarter_label(F.col("as_of")).alias("_now")).agg(F.count(F.lit(1)).alias("value"))
    return q.withColumn("period_complete", F.col("quarter") != F.col("_now")).drop("_now")


SERIES = """sr AS (SELECT place AS target_id, signal, year(day) * 4 + quarter(day) - 1 AS qi, year(day) || 'Q' || quarter(day) AS quarter, count(*) AS value, any_value(year(day) * 4 + quarter(day)) <> any_value(mq) AS period_complete
  FROM facts, (SELECT year(max(day)) * 4 + quarter(max(day)) AS mq FROM facts) GROUP BY 1, 2, 3, 4)"""
_RUNS = """pr AS (SELECT *, row_number() OVER (PARTITION BY target_id, signal ORDER BY qi DESC) AS r, first_value(qi) OVER (PARTITION BY target_id, signal ORDER BY qi DESC) AS top FROM sr WHERE period_complete),
  runs AS (SELECT target_id, signal, coalesce(min(r) FILTER (top - qi + 1 <> r OR value <= 2) - 1, max(r)) AS consecutive_above FROM pr GROUP BY 1, 2)"""


@query("w11_persistence", ctes(FACTS, SERIES, _RUNS) + "SELECT * FROM runs")
def w11(spark, sf):
    return series.persistence(place_series(spark, sf), ["target_id", "signal"], F.lit(2))


@query(
    "w12_anomaly",
    ctes(FACTS, SERIES, "o AS (SELECT *, row_number() OVER (PARTITION BY target_id, signal ORDER BY qi DESC) AS r FROM sr WHERE period_complete)",
         "s AS (SELECT target_id, signal, count(*) AS n, avg(value) FILTER (r > 1) AS m, stddev_pop(value) FILTER (r > 1) AS sd, max(value) FILTER (r = 1) AS v, max(quarter) FILTER (r = 1) AS p FROM o GROUP BY 1, 2)")
    + """SELECT target_id, signal, n AS n_observations, n >= 4 AND CASE WHEN sd = 0 THEN v <> m ELSE abs((v - m) / sd) > 1.5 END AS is_anomaly, CASE WHEN n >= 4 AND sd <> 0 THEN round((v - m) / sd, 2) END AS z_score,
      CASE WHEN n < 4 THEN 'insufficient_history' WHEN sd = 0 THEN CASE WHEN v <> m THEN 'zero_variance_baseline' ELSE 'no_variance' END WHEN (v - m) / sd > 1.5 THEN 'above_historical_mean' WHEN (v - m) / sd < -1.5 THEN 'below_historical_mean' ELSE 'within_normal_range' END AS context,
      CASE WHEN n >= 4 THEN p END AS latest_period FROM s""",
)
def w12(spark, sf):
    return series.anomaly(place_series(spark, sf), ["target_id", "signal"])


def place_trends(spark, sf):
    f = with_as_of(facts(spark, sf).withColumnRenamed("place", "target_id"), "day")
    w = cut_lineage(tables.window_counts(f, ["target_id", "signal"], "day", F.col("as_of"), total="value"))
    now = w.select("target_id", "signal", "value")
    w = w.drop("value")
    from placescore.operators import ordering

    q = ordering.exact_quantiles(now, "value", [0.25, 0.5, 0.75], by=["signal"])
    base = q.select("signal", *[F.col("quantiles")[i].alias(p) for i, p in enumerate(("p25", "p50", "p75"))])
    runs = series.persistence(place_series(spark, sf), ["target_id", "signal"], F.lit(2))
    return cut_lineage(series.trends(w, runs, now, base, ["target_id", "signal"]))


TRENDS = """ag AS (SELECT place AS target_id, signal, date_diff('day', day, (SELECT max(day) FROM facts)) AS age FROM facts),
  wc AS (SELECT target_id, signal, count(*) AS value, count(*) FILTER (age > 0 AND age <= 30) AS a, count(*) FILTER (age > 30 AND age <= 60) AS b, count(*) FILTER (age > 0 AND age <= 90) AS c, count(*) FILTER (age > 365 AND age <= 455) AS d FROM ag GROUP BY 1, 2),
  bs AS (SELECT signal, quantile_cont(value::DOUBLE, 0.25) AS p25, quantile_cont(value::DOUBLE, 0.5) AS p50, quantile_cont(value::DOUBLE, 0.75) AS p75 FROM wc GROUP BY 1),
  tr AS (SELECT target_id, signal, value, p75, round(CASE WHEN b <> 0 THEN (a - b) / b * 100 END, 1) AS recent, round(CASE WHEN d <> 0 THEN (c - d) / d * 100 END, 1) AS seasonal, round((value - p50) / p50 * 100, 1) AS gap, coalesce(consecutive_above, 0) AS persistence
    FROM wc JOIN bs USING (signal) LEFT JOIN runs USING (target_id, signal)),
  td AS (SELECT *, CASE WHEN coalesce(recent > 10, false) OR coalesce(seasonal > 15, false) OR persistence >= 2 THEN 'worsening' WHEN coalesce(gap > 30, false) THEN 'elevated' ELSE 'stable' END AS direction FROM tr)"""


@query("d18_trends", ctes(FACTS, SERIES, _RUNS, TRENDS) + "SELECT * FROM td")
def d18(spark, sf):
    return place_trends(spark, sf).drop("recent_label", "seasonal_label", "gap_label")


_ACT = {"1-URGENT": 0.80, "2-HIGH": 0.85, "3-MEDIUM": 0.75, "4-NOT SPECIFIED": 0.70, "5-LOW": 0.60}
_ACT_SQL = "CASE signal WHEN '1-URGENT' THEN 0.80 WHEN '2-HIGH' THEN 0.85 WHEN '3-MEDIUM' THEN 0.75 WHEN '4-NOT SPECIFIED' THEN 0.70 ELSE 0.60 END::DOUBLE"
_PRIO = f"""sv AS (SELECT *, least(value / p75, 1.0)::DOUBLE AS sev, (CASE WHEN recent > 0 THEN least(recent / 50, 0.4) ELSE 0 END + CASE WHEN seasonal > 0 THEN least(seasonal / 50, 0.3) ELSE 0 END + CASE WHEN gap > 0 THEN least(gap / 100, 0.2) ELSE 0 END + least(persistence * 0.1, 0.3))::DOUBLE AS m0 FROM td),
  mo AS (SELECT *, least(CASE WHEN m0 = 0 AND direction = 'elevated' THEN 0.15 WHEN m0 = 0 AND sev >= 0.15 THEN 0.12 ELSE m0 END, 1.0)::DOUBLE AS mom FROM sv),
  sc AS (SELECT *, (sev * mom * 1.0 * {_ACT_SQL} * (1.0 + sqrt(0.72::DOUBLE) * 2.0))::DOUBLE AS s FROM mo),
  pa AS (SELECT target_id, signal, round(sev, 2) AS severity, round(mom, 2) AS momentum, 1.0 AS confidence, round(s, 3) AS priority_score, row_number() OVER (PARTITION BY target_id ORDER BY round(s, 3) DESC, signal) AS rank FROM sc WHERE s > 0.005)"""


@query("d20_priority_actions", ctes(FACTS, SERIES, _RUNS, TRENDS, _PRIO) + "SELECT * FROM pa WHERE rank <= 5")
def d20(spark, sf):
    return composite.priority_actions(place_trends(spark, sf), _ACT, F.lit(0.72))


@query("d31_watchlist", ctes(FACTS, SERIES, _RUNS, TRENDS, _PRIO) + "SELECT target_id, max(priority_score) AS top_priority, count(*) AS n_actions FROM pa WHERE rank <= 5 GROUP BY 1")
def d31(spark, sf):
    return composite.watchlist(composite.priority_actions(place_trends(spark, sf), _ACT, F.lit(0.72)))


@query("d21_why_now", ctes(FACTS, SERIES, _RUNS, TRENDS) + "SELECT target_id, reason, rank FROM (SELECT target_id, signal || ' is ' || direction AS reason, row_number() OVER (PARTITION BY target_id ORDER BY signal) AS rank FROM td WHERE direction IN ('worsening', 'elevated')) WHERE rank <= 5")
def d21(spark, sf):
    return series.why_now(place_trends(spark, sf))


_SAID = """h AS (SELECT target_id, signal, string_agg(quarter || '=' || value, ' ' ORDER BY qi) AS chain FROM (SELECT *, row_number() OVER (PARTITION BY target_id, signal ORDER BY qi DESC) AS r FROM sr) WHERE r <= 4 GROUP BY 1, 2),
  oo AS (SELECT *, row_number() OVER (PARTITION BY target_id, signal ORDER BY qi DESC) AS r FROM sr WHERE period_complete),
  an AS (SELECT target_id, signal, count(*) AS n, avg(value) FILTER (r > 1) AS m, stddev_pop(value) FILTER (r > 1) AS sd, max(value) FILTER (r = 1) AS v FROM oo GROUP BY 1, 2),
  ax AS (SELECT target_id, signal, CASE WHEN n >= 4 AND CASE WHEN sd = 0 THEN v <> m ELSE abs((v - m) / sd) > 1.5 END THEN 'unusual' || CASE WHEN sd <> 0 THEN ' by z ' || printf('%+.2f', round((v - m) / sd, 2) + 0.0) ELSE '' END || ' [' ||
    CASE WHEN sd = 0 THEN 'zero_variance_baseline' WHEN v > m THEN 'above_historical_mean' ELSE 'below_historical_mean' END || ']' END AS odd FROM an),
  sy AS (SELECT td.target_id, td.signal, td.signal || ': ' || concat_ws('; ', '30 d: ' || a || ' after ' || b || coalesce(' (' || printf('%+.1f %%', recent + 0.0) || ')', ''), '90 d: ' || c || ', a year before ' || d || coalesce(' (' || printf('%+.1f %%', seasonal + 0.0) || ')', ''), chain,
    'to baseline ' || printf('%+.1f %%', gap + 0.0) || ', ' || CASE WHEN td.value <= p25 THEN 'below_average' WHEN td.value <= p50 THEN 'average' WHEN td.value <= bs.p75 THEN 'above_average' ELSE 'high' END, CASE WHEN persistence > 0 THEN 'high for ' || persistence || ' quarters' END, odd) AS summary
    FROM td JOIN wc USING (target_id, signal) JOIN bs USING (signal) LEFT JOIN h USING (target_id, signal) LEFT JOIN ax USING (target_id, signal))"""


def told_trends(spark, sf):
    """Trend rows with everything their sentence tells."""
    t = place_trends(spark, sf)
    w = with_as_of(facts(spark, sf).withColumnRenamed("place", "target_id"), "day")
    counts = tables.window_counts(w, ["target_id", "signal"], "day", F.col("as_of"))
    return series.with_history(t.join(counts, ["target_id", "signal"]), place_series(spark, sf), ["target_id", "signal"])


@query("d21_trend_evidence", ctes(FACTS, SERIES, _RUNS, TRENDS, _SAID) + "SELECT target_id, 'trend_' || signal AS evidence_id, summary FROM sy")
def d21_trend_evidence(spark, sf):
    """Evidence sentences: windows, season, last quarters, gap, run and anomaly."""
    rows = told_trends(spark, sf)
    none = rows.sparkSession.createDataFrame([], "target_id bigint, evidence_id string, summary string")
    return series.evidence(none, rows.withColumn("summary", series.trend_sentence(rows)))


@query(
    "d21_verified_actions",
    ctes(FACTS, SERIES, _RUNS, TRENDS, _PRIO) + """SELECT target_id, signal, priority_score FROM pa WHERE rank <= 5 AND EXISTS (SELECT 1 FROM td WHERE td.target_id = pa.target_id AND td.signal = pa.signal)
      AND EXISTS (SELECT 1 FROM facts WHERE place = pa.target_id AND signal = pa.signal GROUP BY place HAVING max(amount) > 450000)""",
)
def d21v(spark, sf):
    """Actions stay only when both the trend row and the query row they cite exist."""
    t = place_trends(spark, sf)
    largest = facts(spark, sf).groupBy(F.col("place").alias("target_id"), "signal").agg(F.max("amount").alias("amount"))
    stands = largest.where("amount > 450000")  # the rule by which a query row exists, as a count above zero is elsewhere
    f = stands.select("target_id", F.concat(F.lit("q_"), "signal").alias("evidence_id"), F.concat(F.lit("largest fact "), F.col("amount").cast("string")).alias("summary"))
    rows = told_trends(spark, sf)
    e = series.evidence(f, rows.withColumn("summary", series.trend_sentence(rows)))
    actions = composite.priority_actions(t, _ACT, F.lit(0.72)).withColumn("evidence_ids", F.array(F.concat(F.lit("trend_"), "signal"), F.concat(F.lit("q_"), "signal")))
    return series.verify(actions, e).select("target_id", "signal", "priority_score")


_TOTALS = """cu AS (SELECT target_id, signal, quarter, sum(value) OVER (PARTITION BY target_id, signal ORDER BY qi) % 29 + qi * (length(signal) % 3) AS v FROM sr WHERE period_complete),
  pj AS (SELECT a.target_id, a.signal AS sa, b.signal AS sb, rank() OVER (PARTITION BY a.target_id, a.signal, b.signal ORDER BY a.v) + (count(*) OVER (PARTITION BY a.target_id, a.signal, b.signal, a.v) - 1) / 2.0 AS ra,
    rank() OVER (PARTITION BY a.target_id, a.signal, b.signal ORDER BY b.v) + (count(*) OVER (PARTITION BY a.target_id, a.signal, b.signal, b.v) - 1) / 2.0 AS rb FROM cu a JOIN cu b ON a.target_id = b.target_id AND a.quarter = b.quarter AND a.signal < b.signal),
  rh AS (SELECT target_id, sa, sb, corr(ra, rb) AS rho, count(*) AS n FROM pj GROUP BY 1, 2, 3)"""


@query(
    "d19_patterns",
    ctes(FACTS, SERIES, _RUNS, TRENDS, _TOTALS)
    + """SELECT rh.target_id, sa AS signal_a, sb AS signal_b, round(rho, 4) AS rho, n, CASE WHEN abs(rho) >= 0.85 THEN 'high' WHEN abs(rho) >= 0.7 THEN 'medium' ELSE 'low' END AS severity
    FROM rh JOIN td a ON a.target_id = rh.target_id AND a.signal = sa AND a.direction IN ('worsening', 'elevated') JOIN td b ON b.target_id = rh.target_id AND b.signal = sb AND b.direction IN ('worsening', 'elevated')
    WHERE abs(rho) > 0.6 AND abs(rho) * sqrt((n - 2) / (1 - rho * rho)) > CASE n WHEN 26 THEN 3.745399 WHEN 25 THEN 3.767627 WHEN 24 THEN 3.792131 WHEN 23 THEN 3.819277 WHEN 22 THEN 3.849516 WHEN 21 THEN 3.883406 ELSE 3.921646 END""",
)
def d19(spark, sf):
    """Co-movement of running totals (with a drift per signal so that some pairs really move together)."""
    from pyspark.sql import Window

    t = place_trends(spark, sf).select("target_id", "signal", "direction")
    s = place_series(spark, sf).where("period_complete").withColumn("_qi", clean.quarter_index(F.col("quarter")))
    w = Window.partitionBy("target_id", "signal").orderBy("_qi")
    v = F.sum("value").over(w) % 29 + F.col("_qi") * (F.length("signal") % 3)
    p = series.patterns(s.withColumn("value", v).drop("_qi"), t)
    return p.select("target_id", "signal_a", "signal_b", "rho", "n", "severity")


@query(
    "f23_f24_priority_weights",
    "SELECT r_regionkey, n, round(0.72::DOUBLE ** r_regionkey, 4) AS weight, round(1 + sqrt(round(0.72::DOUBLE ** r_regionkey, 4)) * 2, 4) AS boost FROM (SELECT n_regionkey AS r_regionkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)",
)
def f23(spark, sf):
    w = score.priority_weights(["0", "1", "2", "3", "4"])
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("r_regionkey"))
    c = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("k")).join(n, "c_nationkey").groupBy("r_regionkey").agg(F.sum("k").alias("n"))
    weight = F.element_at(clean.literal_map(w), F.col("r_regionkey").cast("string"))
    return c.select("r_regionkey", "n", weight.alias("weight"), F.round(score.preference_boost(weight), 4).alias("boost"))


# ---- signals of a point and composite scores ---------------------------------------------------


def signals(spark, sf):
    """Local state of every target: counts within 500 m and 1 km, fallback sub-scores' inputs."""
    i, t = incidents(spark, sf), targets(spark, sf)
    kinds = {"errors": "error", "clicks": "click", "purchases": "purchase", "signups": "signup"}
    near = spatial.radius_measures(t, i, 500.0, {n: (F.col("kind") == k).cast("int") for n, k in kinds.items()})
    wide = spatial.radius_measures(t, i, 1000.0, {"views": (F.col("kind") == "view").cast("int")})
    return near.join(wide, "target_id")


_D = "(((f.lat - t.lat) * 111320::DOUBLE) ** 2 + ((f.lon - t.lon) * 111320::DOUBLE * 0.7580107::DOUBLE) ** 2)"
SIGNALS = f"""sg AS (SELECT t.target_id, count(*) FILTER (kind = 'error' AND {_D} <= 250000) AS errors, count(*) FILTER (kind = 'click' AND {_D} <= 250000) AS clicks,
  count(*) FILTER (kind = 'purchase' AND {_D} <= 250000) AS purchases, count(*) FILTER (kind = 'signup' AND {_D} <= 250000) AS signups, count(*) FILTER (kind = 'view' AND {_D} <= 1000000) AS views
  FROM targets t LEFT JOIN incidents f ON abs(f.lat - t.lat) < 0.02 AND abs(f.lon - t.lon) < 0.02 GROUP BY 1)"""


@query("d17_point_signals", ctes(INCIDENTS, TARGETS, SIGNALS) + "SELECT * FROM sg")
def d17(spark, sf):
    return signals(spark, sf)


def _state(n=F.col):
    none = F.lit(None).cast("double")
    return {
        "safety_collisions": n("errors"), "transit_collisions": none, "injuries": n("views") / 40, "rodent": F.when(n("clicks") > 20, n("clicks")), "sanitation": n("clicks"),
        "ems_seconds": n("errors") * 10, "fire_seconds": none, "park_acres": none, "trees": n("purchases"), "toilets": F.when(n("signups") > 5, n("signups")), "kiosks": n("signups"),
        "restaurants": n("purchases"), "critical_rate": n("errors") / F.greatest(n("errors") + n("purchases"), F.lit(1)), "class_c": n("errors") / 20, "class_b": none, "aep": none,
    }


_P75 = {"collision": 40.0, "rodent": 12.0, "ems_response": 500.0, "fire_response": 300.0}


def _c(x: str) -> str:
    return sql_clamp(f"({x})::DOUBLE")


_SUB = f"""fb AS (SELECT target_id, {_c("100 - least(errors / 40 * 50, 60) - least(views / 40 * 2, 15)")} AS collision, CASE WHEN clicks > 20 THEN {_c("100 - least(clicks / 12 * 60, 60)")} END AS rodent,
  {_c("100 - least(clicks * 2.5, 55)")} AS san, {_c("100 - least(errors * 10 / 500 * 45, 55)")} AS ems, {_c("45 + least(purchases / 20, 20)")} AS trees, CASE WHEN signups > 5 THEN {_c("40 + least(signups * 7, 35)")} END AS toilets,
  {_c("45 + least(signups * 8, 30)")} AS kiosks, {_c("40 + least(purchases / 4, 25) - least(errors / greatest(errors + purchases, 1) * 25, 20)")} AS rest, {_c("100 - least(errors / 20 * 12, 45)")} AS viol FROM sg)"""


@query(
    "f21_fallback_scores",
    ctes(INCIDENTS, TARGETS, SIGNALS, _SUB) + "SELECT * FROM fb",
)
def f21(spark, sf):
    f = score.fallback_scores(_state(), {k: F.lit(v) for k, v in _P75.items()})
    return signals(spark, sf).select(
        "target_id", f["safety"]["collision"].alias("collision"), f["safety"]["rodent"].alias("rodent"), f["safety"]["311_sanitation"].alias("san"), f["safety"]["ems_response"].alias("ems"),
        f["amenities"]["trees"].alias("trees"), f["amenities"]["public_toilets"].alias("toilets"), f["amenities"]["linknyc"].alias("kiosks"), f["amenities"]["restaurant_context"].alias("rest"), f["building"]["housing_violations"].alias("viol"),
    )


@query(
    "d16_composite_with_coverage",
    ctes(INCIDENTS, TARGETS, SIGNALS, _SUB,
         f"""s AS (SELECT target_id, {sql_clamp("(collision * 0.3125::DOUBLE + coalesce(rodent, 0) * 0.125::DOUBLE + san * 0.125::DOUBLE + ems * 0.25::DOUBLE) / (0.3125::DOUBLE + CASE WHEN rodent IS NOT NULL THEN 0.125 ELSE 0 END::DOUBLE + 0.125::DOUBLE + 0.25::DOUBLE)")} AS safety_score,
           round(0.6875 + CASE WHEN rodent IS NOT NULL THEN 0.125 ELSE 0 END, 4) AS safety_ratio,
           {sql_clamp("(trees * 0.15::DOUBLE + coalesce(toilets, 0) * 0.15::DOUBLE + kiosks * 0.10::DOUBLE + rest * 0.20::DOUBLE) / (0.15::DOUBLE + CASE WHEN toilets IS NOT NULL THEN 0.15 ELSE 0 END::DOUBLE + 0.10::DOUBLE + 0.20::DOUBLE)")} AS amenities_score,
           round(0.45 + CASE WHEN toilets IS NOT NULL THEN 0.15 ELSE 0 END, 4) AS amenities_ratio, viol AS building_score FROM fb)""")
    + f"""SELECT target_id, safety_score, safety_ratio, amenities_score, amenities_ratio, building_score, CAST(NULL AS INTEGER) AS transit_score, {sql_clamp("(safety_score * 0.4::DOUBLE + amenities_score * 0.3::DOUBLE) / (0.4::DOUBLE + 0.3::DOUBLE)")} AS overall_score,
      0.7 AS overall_ratio, round(0.4 * safety_ratio + 0.3 * amenities_ratio, 4) AS overall_effective_ratio, least(safety_ratio, amenities_ratio) AS overall_weakest_ratio, 'fallback' AS safety_source, 'none' AS transit_source FROM s""",
)
def d16(spark, sf):
    f = score.fallback_scores(_state(), {k: F.lit(v) for k, v in _P75.items()})
    w = {c: registry.weights_of(c) for c in ("safety", "transit", "amenities", "building")}
    out = composite.composite(signals(spark, sf), {}, f, w, registry.CATEGORIES)
    return out.select(
        "target_id", "safety_score", "safety_ratio", "amenities_score", "amenities_ratio", "building_score", "transit_score", "overall_score", "overall_ratio", "overall_effective_ratio", "overall_weakest_ratio", "safety_source", "transit_source",
    )


def _wsum(parts: list[tuple[str, float]]) -> str:
    """Clamped weighted mean over the known parts, added in the given order."""
    top = " + ".join(f"coalesce({c} * {w}::DOUBLE, 0)" for c, w in parts)
    low = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {w}::DOUBLE END" for c, w in parts)
    return f"CASE WHEN ({low}) > 0 THEN " + sql_clamp(f"({top}) / ({low})") + " END"


@query(
    "d15_score_all_places",
    ctes(INCIDENTS, PLACES, METRIC_SCORES, ZONES, "t AS (SELECT place_id AS target_id, lat, lon FROM places)", "o AS (SELECT a.i AS dx, b.i AS dy FROM range(-3, 4) a(i), range(-3, 4) b(i))",
         "dk AS (SELECT target_id, cell FROM (SELECT t.target_id, lat, lon, dx, dy, (CAST(floor(((lon - (-74.30::DOUBLE)) * 111320::DOUBLE * 0.7580107::DOUBLE) / 300::DOUBLE) + dx AS BIGINT) + 1048576) * 2097152 + CAST(floor(((lat - 40.45::DOUBLE) * 111320::DOUBLE) / 300::DOUBLE) + dy AS BIGINT) + 1048576 AS cell FROM t, o) WHERE (dx = 0 AND dy = 0) OR "
         + "12742000::DOUBLE * asin(sqrt(least(1.0::DOUBLE, sin(radians((((cell % 2097152 - 1048576) + 0.5::DOUBLE) * 300::DOUBLE) / 111320::DOUBLE + 40.45::DOUBLE - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians((((cell % 2097152 - 1048576) + 0.5::DOUBLE) * 300::DOUBLE) / 111320::DOUBLE + 40.45::DOUBLE)) * sin(radians((((cell // 2097152 - 1048576) + 0.5::DOUBLE) * 300::DOUBLE) / 111320::DOUBLE / 0.7580107::DOUBLE - 74.30::DOUBLE - lon) / 2) ** 2))) <= 500)",
         "sub AS (SELECT target_id, metric, CAST(round_even(avg(score), 0) AS INT) AS s FROM dk JOIN ms USING (cell) GROUP BY 1, 2)", _REG,
         "pv AS (SELECT target_id, max(s) FILTER (metric = 'collision') AS co, max(s) FILTER (metric = '311_sanitation') AS sa, max(s) FILTER (metric = 'subway') AS su, max(s) FILTER (metric = 'trees') AS tr, max(s) FILTER (metric = 'linknyc') AS li FROM sub GROUP BY 1)",
         f"""cw AS (SELECT target_id, {_wsum([('co', 0.3125), ('sa', 0.125)])} AS a, {_wsum([('su', 1.0)])} AS b, {_wsum([('tr', 0.15), ('li', 0.1)])} AS c FROM pv)""",
         f"""ov AS (SELECT target_id, {_wsum([('a', 0.4), ('b', 0.3), ('c', 0.3)])} AS overall FROM cw)""",
         f"iz AS (SELECT DISTINCT place_id AS target_id FROM places JOIN zones ON {sql_in_zone('lat', 'lon')})")
    + "SELECT target_id, overall FROM ov JOIN iz USING (target_id)",
)
def d15(spark, sf):
    """Every parcel scored from the cells within 500 m, then kept when inside the zones."""
    from placescore.operators import polygons

    p = places(spark, sf).select(F.col("place_id").alias("target_id"), "lat", "lon")
    scored = composite.score_places(p, metric_scores(spark, sf), 500.0, registry.METRICS, registry.CATEGORIES)
    inside = polygons.pip_join(p, zones(spark), "target_id").select("target_id")
    return scored.join(inside, "target_id", "left_semi").select("target_id", F.col("overall_score").alias("overall"))


@query(
    "d31_similar_all_places",
    """WITH s AS (SELECT o_custkey AS target_id, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus = 'O') AS b, count(*) FILTER (o_orderstatus = 'P') AS c, round(avg(o_totalprice) / 10000, 0) AS d FROM orders GROUP BY 1)
    SELECT x.target_id, y.target_id AS similar_id, round(sqrt((y.a - x.a) ** 2 + (y.b - x.b) ** 2 + (y.c - x.c) ** 2 + (y.d - x.d) ** 2), 4) AS distance,
      CAST(row_number() OVER (PARTITION BY x.target_id ORDER BY round(sqrt((y.a - x.a) ** 2 + (y.b - x.b) ** 2 + (y.c - x.c) ** 2 + (y.d - x.d) ** 2), 4), y.target_id) AS INTEGER) AS rank
    FROM s x JOIN s y ON x.target_id <> y.target_id QUALIFY rank <= 5""",
)
def d31_all(spark, sf):
    """For every customer the five whose order counts by status and mean price lie closest."""
    o = table(spark, sf, "orders")
    counts = [F.count_if(F.col("o_orderstatus") == k).alias(n) for k, n in (("F", "a"), ("O", "b"), ("P", "c"))]
    s = o.groupBy(F.col("o_custkey").alias("target_id")).agg(*counts, F.round(F.avg("o_totalprice") / 10000, 0).alias("d"))
    return composite.similar_places(s, ["a", "b", "c", "d"], 5)


@query(
    "d31_similar_places",
    ctes(FACTS, "s AS (SELECT place AS target_id, count(*) FILTER (class = 'F') AS a, count(*) FILTER (class = 'O') AS b, count(*) FILTER (class = 'P') AS c FROM facts GROUP BY 1)")
    + "SELECT y.target_id, round(sqrt((y.a - x.a) ** 2 + (y.b - x.b) ** 2 + (y.c - x.c) ** 2), 4) AS distance FROM s x, s y WHERE x.target_id = 0 AND y.target_id <> 0 ORDER BY distance, y.target_id LIMIT 5",
)
def d31s(spark, sf):
    """The five places whose class counts lie closest to place 0."""
    s = facts(spark, sf).groupBy(F.col("place").alias("target_id")).agg(
        *[F.count_if(F.col("class") == k).alias(n) for k, n in (("F", "a"), ("O", "b"), ("P", "c"))]
    )
    return composite.similar(s, 0, ["a", "b", "c"], 5)
