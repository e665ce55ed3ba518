"""Counts, rates, sums, percentile scores and other grouped measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from placescore.functions import cells, clean, score
from placescore.operators import ordering, tables
from placescore.session import cut_lineage
from query_catalog.fixtures import (
    FACTS, INCIDENTS, PLACES, cell_counts, ctes, facts, incidents, places, query, sql_cell, sql_clamp, sql_parent,
    sql_pct, table, with_as_of,
)

COUNTS = "counts AS (SELECT cell, count(*) AS raw_count FROM incidents GROUP BY cell)"


@query(
    "flagship_worst_cells",
    ctes(INCIDENTS, "c AS (SELECT cell, count(*) AS inspection_count, count(DISTINCT entity_id) AS raw_count FROM incidents GROUP BY cell)",
         f"s AS (SELECT *, {sql_pct('raw_count', False)} AS score FROM c)")
    + "SELECT *, row_number() OVER (ORDER BY score DESC, cell) AS rank FROM s",
)
def flagship(spark, sf):
    """Which cells fare worst: index, count, percentile score, rank."""
    counted = cut_lineage(tables.measures_by(incidents(spark, sf), "cell", entity="entity_id"))
    scored = tables.percentile_score(counted, "raw_count", higher_is_better=False)
    return ordering.global_row_number(scored, "score", "cell")


@query("a01_count_by_cell", ctes(INCIDENTS, COUNTS) + "SELECT * FROM counts")
def a01(spark, sf):
    return tables.count_by(incidents(spark, sf), "cell")


@query(
    "a02_distinct_by_cell",
    ctes(INCIDENTS) + "SELECT cell, count(DISTINCT entity_id) AS raw_count, count(*) AS inspection_count FROM incidents GROUP BY cell",
)
def a02(spark, sf):
    return tables.measures_by(incidents(spark, sf), "cell", entity="entity_id")


@query(
    "a03_rate_by_cell",
    ctes(INCIDENTS) + """SELECT cell, count(*) AS raw_count, count(*) FILTER (kind = 'error') AS critical_count,
    round_even(count(*) FILTER (kind = 'error') / count(*), 3) AS critical_rate FROM incidents GROUP BY cell""",
)
def a03(spark, sf):
    return tables.measures_by(incidents(spark, sf), "cell", condition=F.col("kind") == "error")


@query(
    "a04_mean_by_zip",
    "SELECT lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS zip, round(avg(s_acctbal), 4) AS avg_value, count(*) AS incident_count FROM supplier GROUP BY 1",
)
def a04(spark, sf):
    s = table(spark, sf, "supplier").withColumn("zip", F.lpad(F.col("s_nationkey").cast("string"), 5, "0"))
    return tables.mean_by(s, "zip", "s_acctbal").withColumn("avg_value", F.round("avg_value", 4))


@query(
    "a05_sum_by_zip",
    """SELECT lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS zip, sum(l_quantity) AS total_value, count(*) AS record_count
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""",
)
def a05(spark, sf):
    # quantities are summed per supplier before the join, so the join moves one row per supplier
    per = tables.sum_by(table(spark, sf, "lineitem"), "l_suppkey", "l_quantity")
    s = table(spark, sf, "supplier").select("s_suppkey", F.lpad(F.col("s_nationkey").cast("string"), 5, "0").alias("zip"))
    joined = per.join(s, per.l_suppkey == s.s_suppkey)
    return joined.groupBy("zip").agg(
        F.sum("total_value").alias("total_value"), F.sum("record_count").alias("record_count")
    )


@query(
    "a06_mean_positive_by_zip",
    """SELECT lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS zip, round(avg(c_acctbal), 4) AS avg_value, count(*) AS incident_count
    FROM customer WHERE c_acctbal > 0 GROUP BY 1""",
)
def a06(spark, sf):
    c = table(spark, sf, "customer").withColumn("zip", F.lpad(F.col("c_nationkey").cast("string"), 5, "0"))
    return tables.mean_by(c, "zip", "c_acctbal", positive_only=True).withColumn("avg_value", F.round("avg_value", 4))


QUARTER = "year(day) || 'Q' || quarter(day)"


@query(
    "a07_quarterly_counts",
    ctes(FACTS) + f"SELECT place, {QUARTER} AS quarter, count(*) AS count FROM facts WHERE day >= DATE '2000-01-01' GROUP BY 1, 2",
)
def a07(spark, sf):
    f = with_as_of(facts(spark, sf), "day")
    return tables.quarterly(f, "place", "day", F.col("as_of"))


@query(
    "a09_distinct_records_by_cell",
    ctes(INCIDENTS) + "SELECT cell, count(DISTINCT entity_id) AS n_records FROM incidents GROUP BY cell",
)
def a09(spark, sf):
    """A record spread over many rows counts once per cell."""
    return incidents(spark, sf).groupBy("cell").agg(F.count_distinct("entity_id").alias("n_records"))


SCORED = f"scored AS (SELECT cell, raw_count, {sql_pct('raw_count', False)} AS score FROM counts)"


def scored_cells(spark, sf):
    return tables.percentile_score(cell_counts(spark, sf), "raw_count", False)


@query(
    "a11_parent_mean",
    ctes(INCIDENTS, COUNTS, SCORED) + f"SELECT {sql_parent('cell')} AS parent, round(avg(score), 6) AS score, count(*) AS cell_count FROM scored GROUP BY 1",
)
def a11(spark, sf):
    s = scored_cells(spark, sf)
    return s.groupBy(cells.parent(F.col("cell")).alias("parent")).agg(
        F.round(F.avg("score"), 6).alias("score"), F.count(F.lit(1)).alias("cell_count")
    )


@query(
    "a14_baseline_quartiles",
    ctes(INCIDENTS, COUNTS) + """
    SELECT 'incidents' AS "table", 'raw_count' AS metric, round(quantile_cont(raw_count::DOUBLE, 0.25), 2) AS p25,
      round(quantile_cont(raw_count::DOUBLE, 0.5), 2) AS p50, round(quantile_cont(raw_count::DOUBLE, 0.75), 2) AS p75 FROM counts
    UNION ALL SELECT 'orders', 'total_value', round(quantile_cont(o_totalprice, 0.25), 2), round(quantile_cont(o_totalprice, 0.5), 2),
      round(quantile_cont(o_totalprice, 0.75), 2) FROM orders""",
)
def a14(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_totalprice").alias("total_value"))
    return tables.baselines({"incidents": cell_counts(spark, sf), "orders": o})


@query(
    "a15_score_domain",
    ctes(INCIDENTS, COUNTS, SCORED) + """, q AS (SELECT round_even(quantile_cont(score::DOUBLE, 0.02), 0) AS lo,
      round_even(quantile_cont(score::DOUBLE, 0.5), 0) AS mi, round_even(quantile_cont(score::DOUBLE, 0.98), 0) AS hi FROM scored),
    w AS (SELECT CASE WHEN hi - lo < 4 THEN greatest(0, lo - 2) ELSE lo END AS low,
      CASE WHEN hi - lo < 4 THEN least(100, hi + 2) ELSE hi END AS high, mi FROM q)
    SELECT 'score' AS "column", low, CASE WHEN mi > low AND mi < high THEN mi ELSE (low + high) / 2 END AS mid, high FROM w""",
)
def a15(spark, sf):
    return tables.score_domain(scored_cells(spark, sf), ["score"])


def _hist(expr: str) -> str:
    return (
        ctes(INCIDENTS, COUNTS, SCORED)
        + f""", b AS (SELECT least(19, greatest(0, CAST({expr} AS INTEGER))) AS bin, count(*) AS n FROM scored GROUP BY 1)
    SELECT CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(20) r(i) LEFT JOIN b ON b.bin = r.i"""
    )


@query("a16_histogram_floor", _hist("floor(score / 5.0::DOUBLE)"))
def a16(spark, sf):
    return tables.histogram(scored_cells(spark, sf), "score")


@query("a16_histogram_round", _hist("round_even(score / 5.0::DOUBLE, 0)"))
def a16_round(spark, sf):
    return tables.histogram(scored_cells(spark, sf), "score", mode="round")


@query(
    "a17_table_stats",
    """SELECT count(*) AS rows, count(value) AS non_null, count(DISTINCT value) AS n_distinct, min(value) AS min_value,
    max(value) AS max_value, round(avg(value), 1) AS mean_value FROM events""",
)
def a17(spark, sf):
    return tables.table_stats(table(spark, sf, "events"), "value")


@query(
    "a20_shrunk_rate",
    ctes(INCIDENTS, "c AS (SELECT cell, count(*) AS n, count(*) FILTER (kind = 'error') AS k FROM incidents GROUP BY cell)",
         "m AS (SELECT sum(k)::DOUBLE / sum(n)::DOUBLE AS mean, sum(n * (k / n) * (k / n)) / sum(n)::DOUBLE AS sq FROM c)",
         "v AS (SELECT mean, sq - mean * mean AS var FROM m)",
         "p AS (SELECT CASE WHEN var <= 0 OR mean <= 0 OR mean >= 1 THEN 1.0 ELSE mean * greatest(mean * (1 - mean) / var - 1, 1.0) END AS alpha, "
         "CASE WHEN var <= 0 OR mean <= 0 OR mean >= 1 THEN greatest(1 / greatest(mean, 1e-6) - 1, 1.0) ELSE (1 - mean) * greatest(mean * (1 - mean) / var - 1, 1.0) END AS beta FROM v)")
    + "SELECT cell, k, n, round((k + alpha) / (n + alpha + beta), 6) AS rate FROM c, p",
)
def a20(spark, sf):
    c = incidents(spark, sf).groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "error").alias("k")
    )
    return tables.shrink(c, "k", "n").select("cell", "k", "n", F.round("rate", 6).alias("rate"))


@query(
    "a18_exposure_rate",
    ctes(INCIDENTS, PLACES,
         f"p AS (SELECT {sql_cell('lat', 'lon')} AS cell, count(*) / 10.0::DOUBLE AS exposure FROM places GROUP BY 1)",
         "s AS (SELECT cell, sum(3 * (kind = 'error')::INT + (kind = 'view')::INT) AS severity, count(*) AS raw_count FROM incidents GROUP BY cell)",
         "r AS (SELECT s.cell, severity, raw_count, severity / greatest(exposure, 0.05) AS rate FROM s JOIN p ON s.cell = p.cell)")
    + f"""SELECT cell, severity, raw_count, round(rate, 6) AS rate, {sql_pct('rate', False)} AS score,
      (SELECT count(*) FROM s ANTI JOIN p ON s.cell = p.cell) AS dropped_cells FROM r""",
)
def a18(spark, sf):
    p = places(spark, sf).withColumn("cell", cells.cell(F.col("lat"), F.col("lon")))
    exposure = p.groupBy("cell").agg((F.count(F.lit(1)) / 10.0).alias("exposure"))
    rated, lost = tables.exposure_rate(
        incidents(spark, sf), exposure, "cell", (F.col("kind") == "error").cast("int"), (F.col("kind") == "view").cast("int")
    )
    scored = tables.percentile_score(cut_lineage(rated), "rate", False)
    return scored.join(F.broadcast(lost), F.lit(True)).select(
        "cell", "severity", "raw_count", F.round("rate", 6).alias("rate"), "score", "dropped_cells"
    )


@query(
    "a23_top_values",
    ctes(INCIDENTS) + """SELECT entity_id, kind, n, rank FROM (SELECT entity_id, kind, count(*) AS n,
      row_number() OVER (PARTITION BY entity_id ORDER BY count(*) DESC, kind) AS rank FROM incidents GROUP BY 1, 2) WHERE rank <= 3""",
)
def a23(spark, sf):
    return tables.top_values(incidents(spark, sf), "entity_id", "kind", 3)


@query(
    "a24_grade_summary",
    ctes("g AS (SELECT l_suppkey AS k, CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'R' THEN 'B' ELSE 'C' END AS g, lpad(CAST(l_partkey AS VARCHAR), 6, '0') AS name FROM lineitem)",
         "b AS (SELECT k, array_to_string(list(name ORDER BY name), '|') AS a_names FROM (SELECT DISTINCT k, name, dense_rank() OVER (PARTITION BY k ORDER BY name) AS r FROM g WHERE g = 'A') WHERE r <= 4 GROUP BY k)")
    + """SELECT g.k AS target_id, count(*) FILTER (g = 'A') AS grade_a, count(*) FILTER (g = 'B') AS grade_b,
      count(*) FILTER (g = 'C') AS grade_c, count(*) AS graded, any_value(a_names) AS a_names FROM g LEFT JOIN b ON g.k = b.k GROUP BY g.k""",
)
def a24(spark, sf):
    g = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("target_id"),
        F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "R", "b").otherwise(" c").alias("grade"),
        F.lpad(F.col("l_partkey").cast("string"), 6, "0").alias("name"),
    )
    return tables.grade_summary(g, "target_id", "grade", "name")


@query(
    "a25_time_buckets",
    """SELECT event_type AS kind, count(*) FILTER (hour(ts) BETWEEN 6 AND 11) AS morning, count(*) FILTER (hour(ts) BETWEEN 12 AND 17) AS afternoon,
    count(*) FILTER (hour(ts) BETWEEN 18 AND 23) AS evening, count(*) FILTER (hour(ts) BETWEEN 0 AND 5) AS night FROM events GROUP BY 1""",
)
def a25(spark, sf):
    return tables.time_buckets(incidents(spark, sf), "kind", F.date_format("event_ts", "H:mm"))


@query(
    "a26_age_summary",
    ctes(FACTS) + """SELECT place, CAST(round_even(avg(date_diff('day', day, m)), 0) AS INTEGER) AS mean_age, max(date_diff('day', day, m)) AS max_age,
      count(*) FILTER (date_diff('day', day, m) > 365) AS over_1y, count(*) FILTER (date_diff('day', day, m) > 730) AS over_2y
      FROM facts, (SELECT max(day) AS m FROM facts) GROUP BY place""",
)
def a26(spark, sf):
    return tables.age_summary(with_as_of(facts(spark, sf), "day"), "place", "day", F.col("as_of"))


@query(
    "a27_window_counts",
    ctes(FACTS, "a AS (SELECT *, date_diff('day', day, (SELECT max(day) FROM facts)) AS age FROM facts)") + """SELECT place, signal,
      count(*) FILTER (age > 0 AND age <= 30) AS last_30d, count(*) FILTER (age > 30 AND age <= 60) AS prev_30d,
      count(*) FILTER (age > 0 AND age <= 90) AS last_90d, count(*) FILTER (age > 365 AND age <= 455) AS same_90d_last_year FROM a GROUP BY 1, 2""",
)
def a27(spark, sf):
    return tables.window_counts(with_as_of(facts(spark, sf), "day"), ["place", "signal"], "day", F.col("as_of"))


@query(
    "a30_mean_curve_w08_running_max",
    ctes(INCIDENTS, "c AS (SELECT cell, count(*) AS x, avg(value) AS y FROM incidents GROUP BY cell)", "m AS (SELECT x, avg(y) AS y FROM c GROUP BY x)")
    + "SELECT x, round(y, 6) AS y, round(max(y) OVER (ORDER BY x), 3) AS running FROM m",
)
def a30(spark, sf):
    from placescore.plans import stats

    c = incidents(spark, sf).groupBy("cell").agg(F.count(F.lit(1)).alias("x"), F.avg("value").alias("y"))
    return stats.running_max(cut_lineage(stats.mean_curve(c, "x", "y")), "x", "y").select("x", F.round("y", 6).alias("y"), F.round("running", 3).alias("running"))


@query(
    "a31_slope",
    ctes(INCIDENTS, "c AS (SELECT cell, count(*)::DOUBLE AS x, sum(value) AS y FROM incidents GROUP BY cell)") + "SELECT round(regr_slope(y, x), 6) AS slope, count(*) AS n FROM c",
)
def a31(spark, sf):
    from placescore.plans import stats

    c = incidents(spark, sf).groupBy("cell").agg(F.count(F.lit(1)).cast("double").alias("x"), F.sum("value").alias("y"))
    return stats.slope(c, "x", "y")


# ---- windows -----------------------------------------------------------------------------------


@query("w01_percentile_score", ctes(INCIDENTS, COUNTS) + f"SELECT cell, raw_count, {sql_pct('raw_count')} AS score FROM counts")
def w01(spark, sf):
    return tables.percentile_score(cell_counts(spark, sf), "raw_count")


@query("w01_percentile_score_rows", f"SELECT o_orderkey, {sql_pct('o_totalprice')} AS score FROM orders")
def w01_rows(spark, sf):
    """The same score over a long table of near-distinct values."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return tables.percentile_score(o, "o_totalprice").select("o_orderkey", "score")


@query(
    "w02_blend",
    ctes(INCIDENTS, """c AS (SELECT cell, count(DISTINCT entity_id) AS raw_count,
      round_even(count(*) FILTER (kind = 'error') / count(*), 3) AS critical_rate FROM incidents GROUP BY cell)""",
         f"b AS (SELECT cell, {sql_pct('raw_count')} AS abundance, {sql_pct('critical_rate', False)} AS quality FROM c)")
    + f"SELECT cell, abundance, quality, {sql_clamp('(abundance + quality) / 2.0::DOUBLE')} AS score FROM b",
)
def w02(spark, sf):
    c = cut_lineage(tables.measures_by(incidents(spark, sf), "cell", "entity_id", F.col("kind") == "error"))
    a = tables.percentile_score(c, "raw_count", True, "abundance")
    b = tables.percentile_score(a, "critical_rate", False, "quality")
    return b.select("cell", "abundance", "quality", tables.blend(F.col("abundance"), F.col("quality")).alias("score"))


@query("w03_rank_descending", ctes(INCIDENTS, COUNTS) + "SELECT cell, row_number() OVER (ORDER BY raw_count DESC, cell) AS rank FROM counts")
def w03(spark, sf):
    c = cell_counts(spark, sf)
    return ordering.global_row_number(c, "raw_count", "cell").select("cell", "rank")


@query(
    "w04_midrank",
    ctes(INCIDENTS, COUNTS) + """SELECT cell, round(((rank() OVER (ORDER BY raw_count) - 1) + 0.5::DOUBLE * count(*) OVER (PARTITION BY raw_count))
      / count(*) OVER (), 4) AS midrank FROM counts""",
)
def w04(spark, sf):
    c = ordering.with_positions(cell_counts(spark, sf), "raw_count")
    return c.select("cell", score.midrank_from_positions().alias("midrank"))


@query(
    "w06_keep_first",
    "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1",
)
def w06(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return tables.drop_duplicates(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query(
    "w07_first_per_entity",
    """SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS rank FROM
    (SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1) WHERE rank <= 10""",
)
def w07(spark, sf):
    """One representative row per entity, the first ten entities per target."""
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber")
    first = li.groupBy("l_suppkey", "l_partkey").agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("f"))
    flat = first.select("l_suppkey", "l_partkey", "f.l_orderkey", "f.l_linenumber")
    return tables.cap_per_target(flat, "l_suppkey", 10, [F.col("l_partkey")])


@query(
    "w10_not_increasing",
    "SELECT count(*) FILTER (v <= p) AS violations, count(*) AS rows FROM (SELECT event_id AS v, lag(event_id) OVER (ORDER BY ts, event_id) AS p FROM events)",
)
def w10(spark, sf):
    from placescore.plans import quality

    return quality.increasing_violations(table(spark, sf, "events"), "event_id", "ts")


def _norm(method: str, higher: bool) -> str:
    raw = "(v - lo) / (hi - lo) * 100" if method == "minmax" else "least(100.0, greatest(0.0, 50 + 10 * (v - m) / sd))"
    o = raw if higher else f"100 - {raw}"
    return (
        ctes(INCIDENTS, "c AS (SELECT cell, count(*)::DOUBLE AS v FROM incidents GROUP BY cell)",
             "s AS (SELECT min(v) AS lo, max(v) AS hi, avg(v) AS m, stddev_pop(v) AS sd FROM c)")
        + f"SELECT cell, round({o}, 6) AS score FROM c, s"
    )


@query("w16_minmax", _norm("minmax", True))
def w16(spark, sf):
    c = tables.count_by(incidents(spark, sf), "cell", "v")
    return tables.normalise(c, "v", "minmax").select("cell", F.round("score", 6).alias("score"))


@query("w16_zscore", _norm("zscore", False))
def w16z(spark, sf):
    c = tables.count_by(incidents(spark, sf), "cell", "v")
    return tables.normalise(c, "v", "zscore", False).select("cell", F.round("score", 6).alias("score"))


# ---- sorts, limits, sets -----------------------------------------------------------------------


@query("t02_shortest_first", "SELECT name FROM (SELECT DISTINCT p_name AS name FROM part) ORDER BY length(name), name LIMIT 10")
def t02(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()
    return names.orderBy(F.length("name"), "name").limit(10)


@query(
    "t03_cap_per_target",
    ctes(INCIDENTS) + "SELECT entity_id, event_id, rank FROM (SELECT entity_id, event_id, row_number() OVER (PARTITION BY entity_id ORDER BY event_ts DESC, event_id) AS rank FROM incidents) WHERE rank <= 25",
)
def t03(spark, sf):
    i = incidents(spark, sf).select("entity_id", "event_id", "event_ts")
    return tables.cap_per_target(i, "entity_id", 25, [F.desc("event_ts"), F.asc("event_id")]).drop("event_ts")


@query("t06_order_desc", ctes(INCIDENTS, COUNTS) + "SELECT cell, raw_count FROM counts ORDER BY raw_count DESC, cell")
def t06(spark, sf):
    return tables.count_by(incidents(spark, sf), "cell").orderBy(F.desc("raw_count"), "cell")


@query(
    "t08_every_nth",
    ctes(INCIDENTS, COUNTS) + "SELECT cell FROM (SELECT cell, row_number() OVER (ORDER BY cell) - 1 AS r, count(*) OVER () AS n FROM counts) WHERE r % greatest(1, n // 50) = 0",
)
def t08(spark, sf):
    """A deterministic sample of about fifty cells: every n-th in key order."""
    c = cell_counts(spark, sf).withColumn("key", F.col("cell").cast("double"))
    placed = ordering.with_positions(c, "key")
    step = F.greatest(F.lit(1), F.floor(F.col("total") / 50))
    return placed.where(F.col("below") % step == 0).select("cell")


@query(
    "u01_frame_union",
    ctes(INCIDENTS) + "SELECT DISTINCT cell FROM incidents WHERE kind IN ('error', 'click')",
)
def u01(spark, sf):
    i = incidents(spark, sf)
    parts = {k: i.where(F.col("kind") == k) for k in ("error", "click", "view")}
    return tables.frame_union(parts, {"error": 0.4, "click": 0.6, "view": 0.0})


@query(
    "u02_last_wins",
    """SELECT source AS id, max_by(doc_id, (CASE WHEN lang = 'en' THEN 0 ELSE 1000000000 END) + doc_id) AS version,
    max_by(lang, (CASE WHEN lang = 'en' THEN 0 ELSE 1000000000 END) + doc_id) AS lang FROM documents GROUP BY 1""",
)
def u02(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("id"), F.col("doc_id").alias("version"), "lang")
    return tables.concat_last_wins([d.where("lang = 'en'"), d.where("lang <> 'en'")], "id", ["version"])


@query(
    "u03_set_difference",
    "SELECT c_custkey AS customer FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL) AND c_custkey NOT IN (3, 7)",
)
def u03(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("customer"))
    b = table(spark, sf, "events").select(F.col("user_id").alias("customer"))
    return tables.set_difference(a, b, "customer", allowed=[3, 7])


@query(
    "u04_set_intersection",
    "SELECT c_custkey AS customer FROM customer INTERSECT SELECT user_id FROM events INTERSECT SELECT o_custkey FROM orders",
)
def u04(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("customer"))
    b = table(spark, sf, "events").select(F.col("user_id").alias("customer"))
    c = table(spark, sf, "orders").select(F.col("o_custkey").alias("customer"))
    return tables.set_intersection([a, b, c], "customer")


@query("u06_distinct", "SELECT DISTINCT lang, source FROM documents")
def u06(spark, sf):
    return table(spark, sf, "documents").select("lang", "source").distinct()
