"""Projections, predicates, normalisers, equi-joins and text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placescore.functions import cells, clean, score, text
from placescore.operators import tables
from placescore.plans import registry
from query_catalog.fixtures import (
    FACTS, INCIDENTS, PLACES, ctes, facts, incidents, places, query, sql_clamp, sql_lat, sql_lon, table, with_as_of,
)

# ---- a dirty copy of customer ------------------------------------------------------------------


def dirty(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    y, m, d = 2000 + k % 24, k % 12 + 1, k % 28 + 1
    iso = F.format_string("%04d-%02d-%02d", y, m, d)
    us = F.format_string("%02d/%02d/%04d", m, d, y)
    packed = F.format_string("%04d%02d%02d", y, m, d)
    stamp = F.format_string("%04d-%02d-%02dT10:20:30.123", y, m, d)
    cents = F.abs(F.floor(F.col("c_acctbal"))).cast("bigint")
    words = F.array(*[F.lit(w) for w in ("Y", "no", "TRUE", "0", "t", "maybe")])
    return table(spark, sf, "customer").select(
        k.alias("row_id"),
        F.when(k % 7 == 0, F.concat(F.lit("  "), "c_name")).when(k % 5 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("name"),
        F.when(k % 3 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("segment"),
        F.when(k % 5 == 0, us).when(k % 5 == 1, packed).when(k % 5 == 2, stamp).when(k % 5 == 3, "nat").otherwise(iso).alias("joined"),
        words[(k % 6).cast("int")].alias("active"),
        F.when(k % 11 == 0, None).otherwise(F.concat(F.floor(cents / 1000).cast("string"), F.lit(","), F.lpad((cents % 1000).cast("string"), 3, "0"))).alias("amount_text"),
        F.col("c_acctbal").alias("balance"),
        F.when(k % 50 == 0, 95.0).otherwise(40.7).alias("lat"),
        F.concat((k * 37 % 90000).cast("string"), F.when(k % 2 == 0, ".0").otherwise("-12")).alias("zip"),
        F.element_at(F.array(*[F.lit(b) for b in (" mn", "BK", "Bronx", "qn ", "SI", "staten island")]), (k % 6 + 1).cast("int")).alias("borough"),
    )


_K = "c_custkey"
_Y, _M, _D = f"(2000 + {_K} % 24)", f"({_K} % 12 + 1)", f"({_K} % 28 + 1)"
_CENTS = "CAST(abs(floor(c_acctbal)) AS BIGINT)"
DIRTY = f"""dirty AS (SELECT {_K} AS row_id,
  CASE WHEN {_K} % 7 = 0 THEN '  ' || c_name WHEN {_K} % 5 = 0 THEN upper(c_name) ELSE c_name END AS name,
  CASE WHEN {_K} % 3 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS segment,
  CASE {_K} % 5 WHEN 0 THEN printf('%02d/%02d/%04d', {_M}, {_D}, {_Y}) WHEN 1 THEN printf('%04d%02d%02d', {_Y}, {_M}, {_D})
    WHEN 2 THEN printf('%04d-%02d-%02dT10:20:30.123', {_Y}, {_M}, {_D}) WHEN 3 THEN 'nat' ELSE printf('%04d-%02d-%02d', {_Y}, {_M}, {_D}) END AS joined,
  (['Y', 'no', 'TRUE', '0', 't', 'maybe'])[{_K} % 6 + 1] AS active,
  CASE WHEN {_K} % 11 = 0 THEN NULL ELSE CAST({_CENTS} // 1000 AS VARCHAR) || ',' || lpad(CAST({_CENTS} % 1000 AS VARCHAR), 3, '0') END AS amount_text,
  c_acctbal AS balance, CASE WHEN {_K} % 50 = 0 THEN 95.0 ELSE 40.7 END AS lat,
  CAST({_K} * 37 % 90000 AS VARCHAR) || CASE WHEN {_K} % 2 = 0 THEN '.0' ELSE '-12' END AS zip,
  ([' mn', 'BK', 'Bronx', 'qn ', 'SI', 'staten island'])[{_K} % 6 + 1] AS borough FROM customer)"""


# ---- projections and predicates ----------------------------------------------------------------


@query("p01_select_rename", "SELECT c_custkey AS id, c_name AS label FROM customer")
def p01(spark, sf):
    return tables.project(table(spark, sf, "customer"), ["c_custkey", "c_name"], {"c_custkey": "id", "c_name": "label"})


@query("p02_alias_and_fill", "SELECT c_custkey AS place_id, c_name AS name, CAST(NULL AS DOUBLE) AS height FROM customer")
def p02(spark, sf):
    return tables.project_or_null(
        table(spark, sf, "customer"), {"place_id": "bigint", "name": "string", "height": "double"},
        {"place_id": ["c_custkey"], "name": ["c_label", "c_name"]},
    )


@query(
    "p03_named_filters",
    """SELECT count(*) FILTER (regexp_matches(upper(t), 'RAT|FAILED|ACTIVE')) AS rodent, count(*) FILTER (NOT contains(upper(t), 'CLOSE')) AS open_v,
      count(*) FILTER (NOT contains(upper(t), 'DISCHARG')) AS aep, count(*) FILTER (upper(t) = 'LIVE') AS live, count(*) FILTER (upper(t) IN ('RODENT', 'SANITATION CONDITION', 'UNSANITARY CONDITION')) AS s311,
      count(*) FILTER (upper(t) = 'ALIVE') AS alive, count(*) FILTER (upper(t) = 'OPERATIONAL') AS oper, count(*) FILTER (upper(t) = 'CURRENT') AS cur
    FROM (SELECT coalesce((['Rat Activity', 'closed', 'Live', 'rodent', NULL, 'alive', 'Operational', 'current', 'DISCHARGED', 'failed'])[o_orderkey % 10 + 1], '') AS t FROM orders)""",
)
def p03(spark, sf):
    words = F.array(*[F.lit(w) for w in ("Rat Activity", "closed", "Live", "rodent", None, "alive", "Operational", "current", "DISCHARGED", "failed")])
    t = table(spark, sf, "orders").select(words[(F.col("o_orderkey") % 10).cast("int")].alias("t"))
    names = {"rodent": "rodent_positive", "open_v": "open_violations", "aep": "active_aep", "live": "live_linknyc", "s311": "safety_311", "alive": "alive_tree", "oper": "operational_toilet", "cur": "current_bike_route"}
    return t.agg(*[F.count_if(clean.named_filter(mode, F.col("t"))).alias(n) for n, mode in names.items()])


@query("p04_clip_box", f"SELECT c_custkey FROM (SELECT c_custkey, {sql_lat('c_custkey')} AS lat, {sql_lon('c_custkey')} AS lon FROM customer) WHERE lat BETWEEN 40.71 AND 40.73 AND lon BETWEEN -73.99 AND -73.96")
def p04(spark, sf):
    p = places(spark, sf).withColumns({"lat": F.col("lat").cast("string"), "lon": F.col("lon").cast("string")})
    return tables.clip_box(p, "lat", "lon", (40.71, 40.73, -73.99, -73.96)).select(F.col("place_id").alias("c_custkey"))


@query("p05_between_cast", ctes(DIRTY) + "SELECT row_id FROM dirty WHERE TRY_CAST(replace(amount_text, ',', '') AS DOUBLE) BETWEEN 1000 AND 5000")
def p05(spark, sf):
    d = dirty(spark, sf)
    return d.where(clean.between_cast(F.regexp_replace("amount_text", ",", ""), 1000, 5000)).select("row_id")


@query("p06_where_in", ctes(INCIDENTS) + "SELECT event_id FROM incidents WHERE cell IN (SELECT cell FROM incidents WHERE kind = 'error' AND value > 100)")
def p06(spark, sf):
    i = incidents(spark, sf)
    return tables.where_in(i, "cell", i.where("kind = 'error' AND value > 100")).select("event_id")


@query("p13_recency", ctes(FACTS) + "SELECT fact_id FROM facts WHERE date_diff('day', day, (SELECT max(day) FROM facts)) BETWEEN 0 AND 90")
def p13(spark, sf):
    f = with_as_of(facts(spark, sf), "day")
    return f.where(clean.within_days(F.col("day"), 90, F.col("as_of"))).select("fact_id")


@query("p15_anchored_window", ctes(FACTS) + "SELECT fact_id FROM facts WHERE day BETWEEN DATE '2000-12-31' - INTERVAL 2 YEAR AND DATE '2000-12-31' AND day <= (SELECT max(day) FROM facts WHERE day <= DATE '2000-12-31') AND day >= (SELECT max(day) FROM facts WHERE day <= DATE '2000-12-31') - INTERVAL 24 MONTH")
def p15(spark, sf):
    return tables.anchored_window(facts(spark, sf), "day", 2, F.lit("2000-12-31").cast("date")).select("fact_id")


@query("p16_valid_coord", ctes(DIRTY) + "SELECT count(*) FILTER (lat BETWEEN -90 AND 90) AS valid, count(*) AS n FROM dirty")
def p16(spark, sf):
    return dirty(spark, sf).agg(F.count_if(cells.valid_coord(F.col("lat"), F.lit(-74.0))).alias("valid"), F.count(F.lit(1)).alias("n"))


@query("p17_has_tokens", "SELECT p_partkey FROM part WHERE regexp_matches(upper(p_name), '(^|[^A-Z0-9])RED([^A-Z0-9]|$)') AND regexp_matches(upper(p_name), '(^|[^A-Z0-9])WIDGET([^A-Z0-9]|$)')")
def p17(spark, sf):
    return table(spark, sf, "part").where(clean.has_tokens(F.col("p_name"), ["RED", "WIDGET"])).select("p_partkey")


@query("p18_first_valid", "SELECT p_partkey, coalesce(CASE WHEN p_retailprice - 900 > 0 AND p_retailprice - 900 <= 50 THEN p_retailprice - 900 END, CASE WHEN p_size > 0 AND p_size <= 20 THEN p_size * 3.5 END, 8.0) AS height, coalesce(p_retailprice - 900 > 0 AND p_retailprice - 900 <= 50, false) OR coalesce(p_size > 0 AND p_size <= 20, false) AS known FROM part")
def p18(spark, sf):
    h, known = clean.first_valid([(F.col("p_retailprice") - 900, 50, 1.0), (F.col("p_size"), 20, 3.5)], 8.0)
    return table(spark, sf, "part").select("p_partkey", h.alias("height"), known.alias("known"))


@query("p19_domain_rules", "SELECT 'size_1_50' AS rule, count(*) FILTER (NOT p_size BETWEEN 1 AND 50) AS violations FROM part UNION ALL SELECT 'price_under_1000', count(*) FILTER (NOT p_retailprice < 1000) FROM part")
def p19(spark, sf):
    from placescore.plans import quality

    return quality.assert_domain(table(spark, sf, "part"), {"size_1_50": F.col("p_size").between(1, 50), "price_under_1000": F.col("p_retailprice") < 1000})


@query("p14_valid_event_date", ctes(FACTS) + "SELECT fact_id, CASE WHEN day BETWEEN DATE '2000-01-01' AND (SELECT max(day) FROM facts) THEN year(day) || 'Q' || quarter(day) END AS quarter FROM facts")
def p14(spark, sf):
    f = with_as_of(facts(spark, sf), "day")
    return f.select("fact_id", clean.quarter_label(F.col("day"), F.col("as_of")).alias("quarter"))


# ---- joins -------------------------------------------------------------------------------------


@query("j01_left_fill", "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey")
def j01(spark, sf):
    n = table(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return tables.left_fill(table(spark, sf, "customer").select("c_custkey"), n, "c_custkey")


@query("j02_outer_all", ctes(INCIDENTS) + "SELECT cell, max(n) FILTER (kind = 'error') AS error, max(n) FILTER (kind = 'click') AS click, max(n) FILTER (kind = 'view') AS view FROM (SELECT cell, kind, count(*) AS n FROM incidents WHERE kind IN ('error', 'click', 'view') GROUP BY 1, 2) GROUP BY cell")
def j02(spark, sf):
    i = incidents(spark, sf)
    parts = {k: tables.count_by(i.where(F.col("kind") == k), "cell", "n") for k in ("error", "click", "view")}
    return tables.outer_all(parts, "cell", "n")


@query("j03_inner_join", "SELECT s_nationkey, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def j03(spark, sf):
    per = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("t"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return per.join(s, "l_suppkey").groupBy("s_nationkey").agg(F.round(F.sum("t"), 2).alias("total"))


@query("j04_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def j04(spark, sf):
    o = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return tables.keep_in(table(spark, sf, "customer").select("c_custkey"), o, "c_custkey")


@query("j05_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def j05(spark, sf):
    o = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return tables.drop_in(table(spark, sf, "customer").select("c_custkey"), o, "c_custkey")


@query("j18_enrich", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j18(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf, "customer")
    return c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", "n_name", "r_name")


@query(
    "j19_compare",
    ctes(FACTS, "s AS (SELECT place, signal AS category, round(avg(amount), 4) AS score FROM facts GROUP BY 1, 2)",
         "p AS (SELECT DISTINCT place AS a_id, (place + 1) % 40 AS b_id FROM facts)")
    + "SELECT a_id, b_id, a.category, round(b.score - a.score, 2) AS delta FROM p JOIN s a ON a.place = a_id JOIN s b ON b.place = b_id AND a.category = b.category",
)
def j19(spark, sf):
    f = facts(spark, sf)
    s = f.groupBy(F.col("place").alias("target_id"), F.col("signal").alias("category")).agg(F.round(F.avg("amount"), 4).alias("score"))
    pairs = f.select(F.col("place").alias("a_id")).distinct().withColumn("b_id", (F.col("a_id") + 1) % 40)
    return tables.compare(s, pairs).select("a_id", "b_id", "category", "delta")


@query(
    "j20_freshness",
    """WITH c AS (SELECT 'src' || (user_id % 30) AS id, max(ts) AS updated_at FROM events GROUP BY 1),
      l AS (SELECT source AS id, TIMESTAMP '2024-01-20 00:00:00' + (max(doc_id) % 20) * INTERVAL 1 DAY AS local_at FROM documents GROUP BY 1)
    SELECT l.id, CASE WHEN updated_at IS NULL THEN 'missing_upstream' WHEN updated_at > local_at THEN 'stale' ELSE 'fresh' END AS status,
      CASE WHEN updated_at IS NOT NULL THEN round(greatest(0, floor(epoch(updated_at)) - epoch(local_at)) / 86400.0::DOUBLE, 1) END AS stale_days FROM l LEFT JOIN c ON l.id = c.id""",
)
def j20(spark, sf):
    c = table(spark, sf, "events").groupBy(F.concat(F.lit("src"), (F.col("user_id") % 30).cast("string")).alias("id")).agg(F.max("ts").alias("updated_at"))
    l = table(spark, sf, "documents").groupBy(F.col("source").alias("id")).agg(F.max("doc_id").alias("d"))
    base = F.lit("2024-01-20 00:00:00").cast("timestamp")
    l = l.select("id", F.timestamp_seconds(F.unix_timestamp(base) + (F.col("d") % 20) * 86400).alias("local_at"))
    return tables.freshness(c, l)


@query(
    "j22_cross_check",
    """WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer), b AS (SELECT DISTINCT o_custkey AS k FROM orders)
    SELECT (SELECT count(*) FROM a JOIN b USING (k)) AS shared_keys, (SELECT count(*) FROM a ANTI JOIN b USING (k)) AS orphans_a,
      (SELECT count(*) FROM b ANTI JOIN a USING (k)) AS orphans_b, 'k' AS shared_columns, true AS same_key_type""",
)
def j22(spark, sf):
    from placescore.plans import quality

    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    b = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_totalprice")
    return quality.cross_check(a, b, "k")


# ---- normalisers -------------------------------------------------------------------------------


@query(
    "f01_f02_normalise_zip_borough",
    ctes(DIRTY) + r"""SELECT row_id, lpad(nullif(left(regexp_replace(zip, '\D', '', 'g'), 5), ''), 5, '0') AS zip,
      lpad(nullif(left(regexp_replace(split_part(zip, '.', 1), '\D', '', 'g'), 5), ''), 5, '0') AS zip_whole,
      CASE upper(trim(borough)) WHEN 'MN' THEN 'MANHATTAN' WHEN 'BK' THEN 'BROOKLYN' WHEN 'BX' THEN 'BRONX' WHEN 'QN' THEN 'QUEENS' WHEN 'SI' THEN 'STATEN ISLAND' ELSE upper(trim(borough)) END AS borough FROM dirty""",
)
def f01(spark, sf):
    return dirty(spark, sf).select(
        "row_id", clean.normalize_zip(F.col("zip")).alias("zip"), clean.normalize_zip(F.col("zip"), True).alias("zip_whole"),
        clean.normalize_borough(F.col("borough")).alias("borough"),
    )


@query(
    "f03_parse_date",
    ctes(DIRTY) + """SELECT row_id, strftime(coalesce(try_strptime(joined, '%m/%d/%Y'), CASE WHEN length(joined) = 8 THEN try_strptime(joined, '%Y%m%d') END,
      try_strptime(left(joined, 19), '%Y-%m-%dT%H:%M:%S'), try_strptime(joined, '%Y-%m-%d')), '%Y-%m-%d') AS day FROM dirty""",
)
def f03(spark, sf):
    return dirty(spark, sf).select("row_id", F.date_format(clean.parse_date(F.col("joined")), "yyyy-MM-dd").alias("day"))


@query(
    "f04_parse_when",
    "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS epoch_text, CAST(floor(epoch(ts)) AS BIGINT) AS iso_text FROM events",
)
def f04(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.unix_timestamp("ts").cast("string").alias("a"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("b"))
    return e.select("event_id", F.unix_timestamp(clean.parse_when(F.col("a"))).alias("epoch_text"), F.unix_timestamp(clean.parse_when(F.col("b"))).alias("iso_text"))


@query(
    "f05_quarters",
    ctes(FACTS, "q AS (SELECT fact_id, day, year(day) || CASE WHEN fact_id % 2 = 0 THEN 'Q' ELSE '-Q' END || quarter(day) AS raw FROM facts)")
    + """SELECT fact_id, CASE WHEN year(day) >= 2000 AND day < DATE '2001-07-01' THEN year(day) || '-Q' || quarter(day) END AS canonical, year(day) * 4 + quarter(day) - 1 AS quarter_index FROM q""",
)
def f05(spark, sf):
    f = facts(spark, sf)
    sep = F.when(F.col("fact_id") % 2 == 0, "Q").otherwise("-Q")
    raw = F.concat(F.year("day").cast("string"), sep, F.quarter("day").cast("string"))
    return f.select("fact_id", clean.canonical_quarter(raw, F.lit("2001-06-30").cast("date")).alias("canonical"), clean.quarter_index(raw).alias("quarter_index"))


@query(
    "f06_numbers_p11_casts_p12_case",
    ctes(DIRTY) + """SELECT row_id, TRY_CAST(replace(amount_text, ',', '') AS DOUBLE) AS amount,
      CASE lower(active) WHEN 'y' THEN true WHEN 'true' THEN true WHEN 't' THEN true WHEN 'no' THEN false WHEN '0' THEN false END AS active,
      upper(left(segment, 1)) || lower(substr(segment, 2)) AS segment, trim(name) AS name FROM dirty""",
)
def f06(spark, sf):
    from placescore.plans import quality

    plan = [
        {"op": "cast_type", "column": "active", "target_type": "boolean"},
        {"op": "transform_case", "column": "segment", "mode": "title"},
        {"op": "strip_whitespace", "column": "name"},
    ]
    out, _, _ = quality.apply_plan(dirty(spark, sf), plan)
    return out.select("row_id", clean.numeric_text(F.col("amount_text")).alias("amount"), "active", "segment", "name")


@query(
    "f12_f13_wkt",
    ctes(PLACES) + """SELECT place_id, 3 AS n_vertices, round(lon, 6) AS first_lon, round(lon + 0.001::DOUBLE, 6) AS centre_lon, round(lat + 0.001::DOUBLE, 6) AS centre_lat FROM places""",
)
def f12(spark, sf):
    p = places(spark, sf)
    n = lambda c: F.format_string("%.9f", c)
    line = F.concat(F.lit("LINESTRING ("), n(F.col("lon")), F.lit(" "), n(F.col("lat")), F.lit(", 5 7, "), n(F.col("lon") + 0.001), F.lit(" "), n(F.col("lat")), F.lit(", "), n(F.col("lon")), F.lit(" "), n(F.col("lat") + 0.001), F.lit(")"))
    corner = lambda dx, dy: F.concat(n(F.col("lon") + dx), F.lit(" "), n(F.col("lat") + dy))
    poly = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", corner(0.0, 0.0), corner(0.002, 0.0), corner(0.002, 0.002), corner(0.0, 0.002), corner(0.0, 0.0)), F.lit("))"))
    # a step each, so a text is made and read once however often its parts are named
    written = p.select("place_id", line.alias("line"), poly.alias("poly"))
    read = written.select("place_id", cells.wkt_vertices(F.col("line")).alias("v"), cells.polygon_centroid(F.col("poly")).alias("c"))
    return read.select(
        "place_id", F.size("v").alias("n_vertices"), F.round(F.col("v")[0]["lon"], 6).alias("first_lon"),
        F.round("c.lon", 6).alias("centre_lon"), F.round("c.lat", 6).alias("centre_lat"),
    )


@query(
    "f14_transform_coords",
    ctes(PLACES) + "SELECT place_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM places",
)
def f14(spark, sf):
    """Forward Mercator by formula, back through the library."""
    p = places(spark, sf)
    x = F.radians("lon") * 6378137.0
    y = F.log(F.tan(F.lit(0.7853981633974483) + F.radians("lat") / 2)) * 6378137.0
    back = cells.transform_coords(x, y, "EPSG:3857")
    return p.select("place_id", F.round(back["lon"], 6).alias("lon"), F.round(back["lat"], 6).alias("lat"))


@query(
    "f15_f19_f28_scores_and_bands",
    f"""WITH s AS (SELECT o_orderkey, o_totalprice / 5000.0::DOUBLE AS v FROM orders), t AS (SELECT o_orderkey, {sql_clamp('v')} AS score FROM s)
    SELECT o_orderkey, score, CASE WHEN score >= 65 THEN 'low' WHEN score >= 40 THEN 'moderate' ELSE 'high' END AS risk,
      CASE WHEN score >= 76 THEN 'excellent' WHEN score >= 56 THEN 'good' WHEN score >= 41 THEN 'average' WHEN score >= 21 THEN 'below average' ELSE 'poor' END AS band,
      CASE WHEN score >= 80 THEN 'Excellent' WHEN score >= 60 THEN 'Good' WHEN score >= 40 THEN 'Fair' ELSE 'Needs Attention' END AS poster,
      CASE WHEN score > 75 * 1.5 THEN 'WELL ABOVE P75' WHEN score > 75 THEN 'Above P75' WHEN score > 50 THEN 'Above median, approaching P75' WHEN score = 50 THEN 'At city median'
        WHEN score >= 25 THEN 'Below median, above P25' WHEN score >= 12.5 THEN 'Below P25' ELSE 'WELL BELOW P25' END AS note FROM t""",
)
def f15(spark, sf):
    s = table(spark, sf, "orders").select("o_orderkey", score.clamp_score(F.col("o_totalprice") / 5000.0).alias("score"))
    q = [F.lit(25.0), F.lit(50.0), F.lit(75.0)]
    return s.select(
        "o_orderkey", "score", score.risk_level(F.col("score")).alias("risk"), score.score_band(F.col("score")).alias("band"),
        score.score_band(F.col("score"), "poster").alias("poster"), score.baseline_note(F.col("score"), *q).alias("note"),
    )


@query(
    "f20_risk_flag",
    """WITH b AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_custkey % 3 END AS a, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_custkey % 7 END AS c,
      CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_custkey % 13 END AS b FROM customer)
    SELECT id, CASE WHEN a IS NULL AND b IS NULL AND c IS NULL THEN 'unknown' WHEN a >= 1 AND c >= 1 THEN 'serious' WHEN a >= 1 OR c >= 5 THEN 'elevated' WHEN c >= 1 OR b >= 10 THEN 'watch' ELSE 'none' END AS level,
      CASE WHEN a IS NULL THEN 1 WHEN a >= 1 AND c >= 1 THEN 2 WHEN a >= 1 OR c >= 5 THEN (a >= 1)::INT + (c >= 5)::INT WHEN c >= 1 OR b >= 10 THEN (c >= 1)::INT + (b >= 10)::INT ELSE 1 END AS n_reasons,
      CASE WHEN a IS NULL THEN 'nothing known' WHEN a >= 1 AND c >= 1 THEN 'aep:' || a || ',class_c:' || c WHEN a >= 1 OR c >= 5 THEN concat_ws(',', CASE WHEN a >= 1 THEN 'aep:' || a END, CASE WHEN c >= 5 THEN 'class_c:' || c END)
        WHEN c >= 1 OR b >= 10 THEN concat_ws(',', CASE WHEN c >= 1 THEN 'class_c:' || c END, CASE WHEN b >= 10 THEN 'class_b:' || b END) ELSE 'all below' END AS reasons, a AS n_aep, c AS n_class_c, b AS n_class_b FROM b""",
)
def f20(spark, sf):
    k = F.col("c_custkey")
    known = lambda c: F.when(k % 9 != 0, c)
    flag = score.risk_flag(known(k % 3), known(k % 7), known(k % 13))
    shown = F.array_join(F.transform(flag["reasons"], lambda r: F.concat_ws(":", r["input"], r["count"].cast("string"))), ",")
    counts = [flag["counts"][c].alias(f"n_{c}") for c in ("aep", "class_c", "class_b")]
    return table(spark, sf, "customer").select(k.alias("id"), flag["level"].alias("level"), F.size(flag["reasons"]).alias("n_reasons"), shown.alias("reasons"), *counts)


@query(
    "f16_f17_f18_trend_labels",
    ctes(FACTS, "m AS (SELECT max(day) AS m FROM facts)", "w AS (SELECT place, signal, count(*) FILTER (date_diff('day', day, m) > 0 AND date_diff('day', day, m) <= 30) AS a, count(*) FILTER (date_diff('day', day, m) > 30 AND date_diff('day', day, m) <= 60) AS b, "
         "count(*) FILTER (date_diff('day', day, m) > 0 AND date_diff('day', day, m) <= 90) AS c, count(*) FILTER (date_diff('day', day, m) > 365 AND date_diff('day', day, m) <= 455) AS d, count(*) AS v FROM facts, m GROUP BY 1, 2)",
         "p AS (SELECT *, CASE WHEN b <> 0 THEN (a - b) / b * 100 END AS r, CASE WHEN d <> 0 THEN (c - d) / d * 100 END AS s, (v - 75.0::DOUBLE) / 75.0::DOUBLE * 100 AS g FROM w)")
    + """SELECT place, signal, round(r, 1) AS recent, CASE WHEN r IS NULL THEN 'no_baseline' WHEN r > 10 THEN 'rising' WHEN r < -10 THEN 'falling' ELSE 'stable' END AS recent_label,
      round(s, 1) AS seasonal, CASE WHEN s IS NULL THEN 'no_baseline' WHEN s > 15 THEN 'rising' WHEN s < -15 THEN 'falling' ELSE 'stable' END AS seasonal_label, round(g, 1) AS gap,
      CASE WHEN v <= 70 THEN 'below_average' WHEN v <= 75 THEN 'average' WHEN v <= 80 THEN 'above_average' ELSE 'high' END AS gap_label,
      CASE WHEN coalesce(round(r, 1) > 10, false) OR coalesce(round(s, 1) > 15, false) THEN 'worsening' WHEN round(g, 1) > 30 THEN 'elevated' ELSE 'stable' END AS direction FROM p""",
)
def f16(spark, sf):
    f = with_as_of(facts(spark, sf), "day")
    w = tables.window_counts(f, ["place", "signal"], "day", F.col("as_of"))
    n = f.groupBy("place", "signal").agg(F.count(F.lit(1)).alias("v"))
    r = score.pct_change(F.col("last_30d"), F.col("prev_30d"), score.RECENT_BAND)
    s = score.pct_change(F.col("last_90d"), F.col("same_90d_last_year"), score.SEASONAL_BAND)
    g = score.baseline_gap(F.col("v"), F.lit(70.0), F.lit(75.0), F.lit(80.0))
    return w.join(n, ["place", "signal"]).select(
        "place", "signal", r["change_pct"].alias("recent"), r["label"].alias("recent_label"), s["change_pct"].alias("seasonal"), s["label"].alias("seasonal_label"),
        g["gap_pct"].alias("gap"), g["percentile_label"].alias("gap_label"),
        score.direction(r["change_pct"], s["change_pct"], g["gap_pct"], F.lit(0)).alias("direction"),
    )


@query(
    "f25_f27_f38_ordinals_tiers_tints",
    """SELECT p_partkey, (5 - (p_size % 5 + 1)) * 25.0 AS reversed,
      CASE WHEN a = b THEN names[a + 1] ELSE names[a + 1] || '–' || names[b + 1] END AS tier,
      greatest(0, least(100, 60 - least(p_size % 8, 5) * 10 - least(p_size % 3, 1) * 30)) AS tint_i,
      CASE WHEN p_size % 4 = 0 THEN greatest(20, g - 25) ELSE g END AS tint_g, CASE p_size % 3 WHEN 0 THEN 25 WHEN 1 THEN 45 ELSE 65 END AS tint_c
    FROM (SELECT p_partkey, p_size, ['Very low', 'Low', 'Middle', 'High', 'Very high'] AS names, least(4, CAST(floor(p_size * 1.2 / 20) AS INT)) AS a, least(4, CAST(floor((p_size * 1.2 + 15) / 20) AS INT)) AS b,
      CASE p_size % 3 WHEN 0 THEN 80 WHEN 1 THEN 60 ELSE 40 END AS g FROM part)""",
)
def f25(spark, sf):
    s = F.col("p_size")
    low = s * 1.2
    grade = F.when(s % 3 == 0, "a").when(s % 3 == 1, " B").otherwise("z")
    klass = F.when(s % 3 == 0, "C").when(s % 3 == 1, "b").otherwise("A")
    return table(spark, sf, "part").select(
        "p_partkey", score.reverse_ordinal(s % 5 + 1).alias("reversed"), score.public_tier(low, low + 15.0).alias("tier"),
        score.tint_injuries(s % 8, s % 3).alias("tint_i"), score.tint_grade(grade, F.when(s % 4 == 0, "Critical")).alias("tint_g"), score.tint_class(klass).alias("tint_c"),
    )


@query(
    "f26_curve_lookup",
    """SELECT p_partkey, round(CASE WHEN x <= 1 THEN 10 WHEN x <= 2 THEN 10 + (x - 1) * 20 WHEN x <= 5 THEN 30 + (x - 2) / 3 * 30 WHEN x <= 10 THEN 60 + (x - 5) / 5 * 30 ELSE least(100, greatest(90, 90 + 2.0 * (x - 10))) END, 6) AS y
    FROM (SELECT p_partkey, p_size / 3.0::DOUBLE AS x FROM part)""",
)
def f26(spark, sf):
    knots = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in [(1, 10), (2, 30), (5, 60), (10, 90)]])
    return table(spark, sf, "part").select("p_partkey", F.round(score.curve_lookup(knots, F.lit(2.0), F.col("p_size") / 3.0), 6).alias("y"))


@query(
    "f29_parse_query",
    r"""WITH q AS (SELECT p_partkey, upper(p_name) AS n, p_partkey % 4 AS k FROM part)
    SELECT p_partkey, array_to_string(string_split(n, ' '), ' ') || CASE k WHEN 0 THEN '' WHEN 1 THEN ' 5 AVENUE' WHEN 2 THEN '' ELSE ' 22 ST' END AS tokens,
      CASE k WHEN 0 THEN 'MANHATTAN' WHEN 1 THEN 'MANHATTAN' WHEN 2 THEN 'BRONX' ELSE NULL END AS borough FROM q""",
)
def f29(spark, sf):
    k = F.col("p_partkey") % 4
    q = F.concat("p_name", F.when(k == 0, " Manhattan, NY").when(k == 1, " 5th Avenue, New York, NY 10036").when(k == 2, ", the Bronx, USA").otherwise(" 22nd St"))
    parsed = text.parse_query(q)
    return table(spark, sf, "part").select("p_partkey", F.array_join(parsed["tokens"], " ").alias("tokens"), parsed["borough"].alias("borough"))


@query(
    "f32_text_numbers_sentences",
    r"""SELECT doc_id, len(list_distinct(regexp_extract_all(text, '\d+\.\d+|\d{2,}'))) AS n_numbers,
      len(list_filter(string_split_regex(regexp_replace(regexp_replace(text, '\d+\.\d+', '0', 'g'), '\b(e\.g|i\.e|vs|approx|St|Ave)\.', '\1', 'g'), '[.!?。！？]+'), lambda p: trim(p) <> '')) AS n_sentences
    FROM documents""",
)
def f32(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(text.numbers(F.col("text"))).alias("n_numbers"), text.sentence_count(F.col("text")).alias("n_sentences"))


@query(
    "f36_mask_payload",
    "SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1",
)
def f36(spark, sf):
    """Array payload of a conversation reported by its size."""
    from placescore.plans import evals

    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list("turn").alias("turns"))
    return evals.mask_payload(c, ["turns"])


@query(
    "f37_ids_and_sentences",
    "SELECT doc_id, 'pluto_' || doc_id AS id, left(trim(CASE WHEN contains(trim(text), '. ') THEN string_split(trim(text), '. ')[1] WHEN contains(trim(text), '! ') THEN string_split(trim(text), '! ')[1] WHEN contains(trim(text), '? ') THEN string_split(trim(text), '? ')[1] WHEN contains(trim(text), chr(10)) THEN string_split(trim(text), chr(10))[1] ELSE trim(text) END), 200) AS first FROM documents",
)
def f37(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.canonical_id(F.col("doc_id")).alias("id"), text.first_sentence(F.col("text")).alias("first"))


@query(
    "a35_registry_contributions",
    ctes(INCIDENTS) + """SELECT metric, count(*) AS incidents, round(any_value(share), 6) AS contribution FROM (SELECT CASE kind WHEN 'error' THEN 'collision' WHEN 'click' THEN '311_sanitation' WHEN 'view' THEN 'subway' WHEN 'purchase' THEN 'trees' ELSE 'linknyc' END AS metric,
      CASE kind WHEN 'error' THEN 0.4 * 0.3125 WHEN 'click' THEN 0.4 * 0.125 WHEN 'view' THEN 0.3 * 5 / 14 WHEN 'purchase' THEN 0.3 * 0.15 ELSE 0.3 * 0.10 END AS share FROM incidents) GROUP BY 1""",
)
def a35(spark, sf):
    from query_catalog.fixtures import KIND_METRIC

    m = registry.metrics_table(spark)
    i = incidents(spark, sf).select(F.element_at(clean.literal_map(KIND_METRIC), F.col("kind")).alias("metric"))
    return i.groupBy("metric").agg(F.count(F.lit(1)).alias("incidents")).join(m, "metric").select("metric", "incidents", F.round("contribution", 6).alias("contribution"))
