"""Data quality, publication, search, grading, clusters and reachability."""

from __future__ import annotations

from pyspark.sql import functions as F

from placescore.functions import cells, clean
from placescore.operators import cluster, graph, spatial, tables
from placescore.plans import composite, evals, quality, search
from placescore.session import cut_lineage, scratch_path
from placescore.sources import publish, readers
from query_catalog.fixtures import (
    FACTS, INCIDENTS, PLACES, TARGETS, cell_counts, ctes, facts, incidents, places, query, sql_cell, sql_d2, sql_hav, sql_ix, sql_iy, sql_pack, sql_pct, sql_x, sql_y,
    table, targets, with_as_of,
)
from query_catalog.shaping import DIRTY, dirty

# ---- profile and detectors ---------------------------------------------------------------------

_COLS = ["row_id", "name", "segment", "joined", "active", "amount_text", "balance", "lat", "zip", "borough"]
_TEXT = ["name", "segment", "joined", "active", "amount_text", "zip", "borough"]


def _union(cols: list[str], select: str) -> str:
    return " UNION ALL ".join(select.replace("{c}", c) for c in cols)


@query(
    "a36_profile_columns",
    _union(
        ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"],
        """SELECT '{c}' AS "column", count(*) AS row_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS n_unique, round((count(*) - count({c})) / count(*), 4) AS null_rate, CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value FROM orders""",
    ),
)
def a36(spark, sf):
    o = table(spark, sf, "orders").drop("o_orderdate")
    return quality.profile_columns(o).select("column", "row_count", "null_count", "n_unique", "null_rate", "min_value", "max_value")


@query(
    "d35_structural_issues",
    ctes(DIRTY) + """SELECT 'all null' AS "column", 'high_null_rate' AS type, 'high' AS severity FROM (SELECT count(*) FROM dirty) UNION ALL SELECT 'all null', 'empty_column', 'high' UNION ALL SELECT 'all null', 'problematic_column_name', 'low'
      UNION ALL SELECT 'one', 'constant_column', 'low' UNION ALL SELECT 'segment,segment_copy', 'suspected_duplicate_columns', 'medium'""",
)
def d35(spark, sf):
    d = dirty(spark, sf).select("row_id", "segment", "balance").withColumns(
        {"segment_copy": F.col("segment"), "one": F.lit("x"), "all null": F.lit(None).cast("string")}
    )
    return quality.structural_issues(quality.profile_columns(d))


_SHAPES = {
    "iso_date": r"^\d{4}-\d{2}-\d{2}$", "iso_datetime": r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2})?$", "us_slash": r"^\d{1,2}/\d{1,2}/\d{2,4}$", "us_dash": r"^\d{1,2}-\d{1,2}-\d{2,4}$",
    "eu_slash": r"^\d{1,2}/\d{1,2}/\d{4}$", "month_word": r"^\d{1,2}[-\s][A-Za-z]{3,}[-\s]\d{2,4}$",
}


@query(
    "d36_scan_quality",
    ctes(DIRTY, "tx AS (" + _union(_TEXT, """SELECT '{c}' AS "column", row_id, {c} AS v FROM dirty WHERE {c} IS NOT NULL""") + ")",
         """ws AS (SELECT 'whitespace_drift' AS type, "column", count(*) AS n, 'low' AS severity FROM tx WHERE v <> trim(v) GROUP BY 2)""",
         """ca AS (SELECT 'casing_inconsistency' AS type, "column", count(DISTINCT v) - count(DISTINCT lower(v)) AS n, 'medium' AS severity FROM tx GROUP BY 2 HAVING count(DISTINCT v) > count(DISTINCT lower(v)))""",
         """bo AS (SELECT 'mixed_boolean_encoding' AS type, "column", count(DISTINCT lower(trim(v))) FILTER (lower(trim(v)) IN ('y','yes','true','t','1','on','n','no','false','f','0','off')) AS n, 'high' AS severity FROM tx GROUP BY 2
           HAVING count(DISTINCT trim(v)) <= 10 AND count(DISTINCT lower(trim(v))) FILTER (lower(trim(v)) IN ('y','yes','true','t','1','on','n','no','false','f','0','off')) >= 3)""",
         """sh AS (SELECT "column", count(*) AS k, """ + ", ".join(f"count(*) FILTER (regexp_matches(trim(v), '{p}')) AS {n}" for n, p in _SHAPES.items()) + """ FROM tx GROUP BY 1)""",
         """md AS (SELECT 'mixed_date_formats' AS type, "column", """ + " + ".join(f"({n} > 0)::INT" for n in _SHAPES) + """ AS n, 'high' AS severity, """ + " + ".join(_SHAPES) + """ AS total, k FROM sh)""",
         """nu AS (SELECT "column", count(TRY_CAST(replace(trim(v), ',', '') AS DOUBLE)) AS n, count(*) AS k FROM tx GROUP BY 1)""",
         """ng AS (SELECT 'negative_value_unexpected' AS type, 'balance' AS "column", count(*) AS n, 'high' AS severity FROM dirty WHERE balance < 0)""",
         """la AS (SELECT 'geographic_out_of_bounds' AS type, 'lat' AS "column", count(*) AS n, 'high' AS severity FROM dirty WHERE lat NOT BETWEEN -90 AND 90)""",
         """ze AS (SELECT 'suspicious_zero' AS type, 'balance' AS "column", count(*) FILTER (balance = 0) AS n, 'medium' AS severity FROM dirty HAVING count(*) FILTER (balance = 0) > 0 AND count(*) FILTER (balance = 0) < 0.5 * count(balance))""",
         """du AS (SELECT 'exact_row_duplicates' AS type, '' AS "column", CAST(sum(n) AS BIGINT) AS n, 'high' AS severity FROM (SELECT count(*) AS n FROM dirty GROUP BY name, segment, joined, active, amount_text, balance, lat, zip, borough HAVING count(*) > 1) HAVING count(*) > 0)""")
    + """SELECT * FROM ws UNION ALL SELECT * FROM ca UNION ALL SELECT * FROM bo UNION ALL SELECT type, "column", n, severity FROM md WHERE n >= 2 AND total > 0.25 * k
      UNION ALL SELECT CASE WHEN n / k >= 0.95 THEN 'numeric_stored_as_string' ELSE 'mixed_numeric_string' END, "column", n, CASE WHEN n / k >= 0.95 THEN 'medium' ELSE 'high' END FROM nu WHERE n / k >= 0.7
      UNION ALL SELECT * FROM ng UNION ALL SELECT * FROM la UNION ALL SELECT * FROM ze UNION ALL SELECT * FROM du""",
)
def d36(spark, sf):
    return quality.scan_quality(dirty(spark, sf), row_id="row_id").drop("example_rows")


@query(
    "d36_duplicate_rows_and_identifiers",
    """SELECT 'exact_row_duplicates' AS type, '' AS "column", sum(n) AS n FROM (SELECT count(*) AS n FROM events GROUP BY user_id, event_type HAVING count(*) > 1)
    UNION ALL SELECT 'duplicate_identifier', 'user_id', sum(n) FROM (SELECT count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 1)""",
)
def d36_dups(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type")
    dup = quality.scan_quality(e).where("type = 'exact_row_duplicates'")
    return dup.unionByName(quality.duplicate_identifiers(e, ["user_id"])).select("type", "column", "n")


@query(
    "d37_cleaning_run_log_p21",
    ctes(DIRTY, "a AS (SELECT * FROM dirty WHERE amount_text IS NOT NULL)", "b AS (SELECT * FROM a WHERE balance > 0)", "c AS (SELECT count(DISTINCT (borough, lower(segment))) AS n FROM b)")
    + """SELECT 1 AS step, 'drop_nulls' AS op, 'ok' AS status, (SELECT count(*) FROM dirty) AS rows_before, (SELECT count(*) FROM a) AS rows_after
      UNION ALL SELECT 2, 'explode_universe', 'skipped', (SELECT count(*) FROM a), (SELECT count(*) FROM a) UNION ALL SELECT 3, 'filter_rows', 'ok', (SELECT count(*) FROM a), (SELECT count(*) FROM b)
      UNION ALL SELECT 4, 'transform_case', 'ok', (SELECT count(*) FROM b), (SELECT count(*) FROM b) UNION ALL SELECT 5, 'cast_type', 'skipped', (SELECT count(*) FROM b), (SELECT count(*) FROM b)
      UNION ALL SELECT 6, 'drop_duplicates', 'ok', (SELECT count(*) FROM b), (SELECT n FROM c)""",
)
def d37(spark, sf):
    plan = [
        {"op": "drop_nulls", "column": "amount_text"},
        {"op": "explode_universe"},
        {"op": "filter_rows", "column": "balance", "condition": "gt", "value": 0},
        {"op": "transform_case", "column": "segment", "mode": "lower"},
        {"op": "cast_type", "column": "nowhere", "target_type": "DOUBLE"},
        {"op": "drop_duplicates", "subset": ["borough", "segment"], "order": ["row_id"]},
    ]
    _, log = quality.run_plan(dirty(spark, sf), plan)
    return log.drop("detail", "faults")


_FAULTY = [
    {"op": "filter_rows", "column": "balance", "condition": "gt", "value": "abc"},
    {"op": "filter_rows", "column": "segment", "condition": "in", "values": [1, "BUILDING", True, "AUTOMOBILE", "building"]},
    {"op": "cast_type", "column": "amount_text", "target_type": "DOUBLE"},
    {"op": "filter_rows", "column": "active", "condition": "lte", "value": 1},
    {"op": "filter_rows", "column": "balance", "condition": "in", "values": ["x", 3]},
]


@query(
    "d37_faulty_steps_p21",
    ctes(
        DIRTY,
        "s AS (SELECT * FROM dirty WHERE segment IN ('BUILDING', 'AUTOMOBILE', 'building'))",
        "n AS (SELECT *, CASE WHEN NOT regexp_matches(active, '[A-Za-z]\\s*$') THEN TRY_CAST(active AS DOUBLE) END AS a FROM s)",
        "c AS (SELECT (SELECT count(*) FROM dirty) AS d, (SELECT count(*) FROM s) AS s, (SELECT count(*) FROM s WHERE trim(amount_text) <> '' AND TRY_CAST(amount_text AS DOUBLE) IS NULL) AS bad, (SELECT count(*) FROM n WHERE a <= 1) AS n, (SELECT count(*) FROM n WHERE trim(active) <> '' AND a IS NULL) AS odd, (SELECT count(*) FROM n WHERE a <= 1 AND balance = 3) AS z)",
    )
    + """SELECT 1 AS step, 'filter_rows' AS op, 'skipped' AS status, d AS rows_before, d AS rows_after, 0 AS faults FROM c UNION ALL SELECT 2, 'filter_rows', 'ok', d, s, 0 FROM c
      UNION ALL SELECT 3, 'cast_type', 'ok', s, s, bad FROM c UNION ALL SELECT 4, 'filter_rows', 'ok', s, n, odd FROM c UNION ALL SELECT 5, 'filter_rows', 'ok', n, z, 0 FROM c""",
)
def d37_faulty(spark, sf):
    """Literals of another type, mixed lists and casts that give nothing: logged and counted, never an abort."""
    _, log = quality.run_plan(dirty(spark, sf), _FAULTY)
    return log.drop("detail")


@query(
    "d37_cleaned_rows_p08_p10",
    ctes(DIRTY) + """SELECT row_id, trim(name) AS label, CASE segment WHEN 'BUILDING' THEN 'B' WHEN 'building' THEN 'B' ELSE segment END AS segment, TRY_CAST(replace(amount_text, ',', '') AS DOUBLE) IS NOT NULL AS has_amount
      FROM dirty WHERE balance BETWEEN 0 AND 5000 AND active NOT IN ('maybe') AND borough IN ('BK', 'SI', ' mn')""",
)
def d37_rows(spark, sf):
    plan = [
        {"op": "strip_whitespace", "column": "name"},
        {"op": "rename_column", "old_name": "name", "new_name": "label"},
        {"op": "replace_values", "column": "segment", "mapping": {"BUILDING": "B", "building": "B"}},
        {"op": "filter_rows", "column": "balance", "condition": "between", "value": 0, "value2": 5000},
        {"op": "filter_rows", "column": "active", "condition": "not_in", "values": ["maybe"]},
        {"op": "filter_rows", "column": "borough", "condition": "in", "values": ["BK", "SI", " mn"]},
        {"op": "drop_column", "column": "zip"},
    ]
    out, _, _ = quality.apply_plan(dirty(spark, sf), plan)
    return out.select("row_id", "label", "segment", F.col("amount_text").isNotNull().alias("has_amount"))


@query(
    "d38_before_after_diff",
    ctes(DIRTY, "af AS (SELECT row_id, lower(segment) AS segment, TRY_CAST(active AS INT) AS active, 'x' AS borough FROM dirty)")
    + """SELECT 'row_id' AS "column", 'common' AS status, 0.0 AS null_rate_delta, (SELECT count(DISTINCT row_id) FROM dirty) AS n_unique_after, '' AS problems
      UNION ALL SELECT 'segment', 'common', 0.0, (SELECT count(DISTINCT segment) FROM af), ''
      UNION ALL SELECT 'active', 'common', (SELECT round(avg((active IS NULL)::INT), 4) FROM af), 1, 'new_nulls_introduced,significant_null_increase,collapsed_to_constant'
      UNION ALL SELECT 'borough', 'common', 0.0, 1, 'collapsed_to_constant' UNION ALL SELECT 'balance', 'removed', NULL, NULL, ''""",
)
def d38(spark, sf):
    before = dirty(spark, sf).select("row_id", "segment", "active", "borough", "balance")
    after = before.select("row_id", F.lower("segment").alias("segment"), F.col("active").try_cast("int").alias("active"), F.lit("x").alias("borough"))
    return quality.diff(before, after).select("column", "status", "null_rate_delta", "n_unique_after", "problems")


@query(
    "d39_raw_snapshot_audit",
    """SELECT source AS path, count(*) AS rows, CASE WHEN source IN ('src1', 'src2') THEN 'unexpected' WHEN source = 'src3' THEN 'auxiliary' WHEN source = 'src4' THEN 'incompatible' ELSE 'ok' END AS status FROM documents GROUP BY source
    UNION ALL SELECT 'src99', NULL, 'missing'""",
)
def d39(spark, sf):
    have = table(spark, sf, "documents").groupBy(F.col("source").alias("path")).agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.array(F.lit("doc_id"), F.lit("text")))
    want = have.where(~F.col("path").isin("src1", "src2", "src3")).select("path", F.when(F.col("path") == "src4", F.array(F.lit("doc_id"), F.lit("gone"))).otherwise(F.array(F.lit("doc_id"))).alias("columns"))
    want = want.unionByName(spark.createDataFrame([("src99", ["doc_id"])], "path string, columns array<string>"))
    return quality.audit_raw(want, have, allowed=["src3"]).drop("errors")


def _snapshot(spark, sf):
    """Every source is a file; its number decides what is expected of it and how its header reads."""
    k = F.regexp_extract("path", r"(\d+)$", 1).cast("int") % 7
    have = table(spark, sf, "documents").groupBy(F.col("source").alias("path")).agg(F.count(F.lit(1)).alias("rows"))
    header = F.when(k == 2, F.array(*map(F.lit, ("doc_id", "text", "text")))).when(k == 3, F.array(F.lit("doc_id"))).otherwise(F.array(F.lit("doc_id"), F.lit("text")))
    have = have.withColumns({"columns": header, "parsed": k != 4})
    want = have.where(k != 5).select("path", F.array(F.lit("doc_id"), F.lit("text")).alias("columns"), F.when(k == 6, F.col("rows") + 1).otherwise(F.col("rows")).alias("expected_rows"))
    return want, have


_SNAPSHOT = r"""f AS (SELECT source AS path, count(*) AS rows, CAST(regexp_extract(source, '(\d+)$', 1) AS INT) % 7 AS k FROM documents GROUP BY 1),
  j AS (SELECT path, rows, CASE k WHEN 5 THEN CASE WHEN path = 'src5' THEN 'auxiliary' ELSE 'unexpected' END WHEN 4 THEN 'invalid' WHEN 2 THEN 'incompatible' WHEN 3 THEN 'incompatible' WHEN 6 THEN 'incompatible' ELSE 'ok' END AS status,
    CASE k WHEN 4 THEN 'not parsed' WHEN 2 THEN 'twice text' WHEN 3 THEN 'without text' WHEN 6 THEN 'rows ' || rows || ' of ' || (rows + 1) ELSE '' END AS errors FROM f)"""


@query("d39_snapshot_audit", ctes(_SNAPSHOT) + "SELECT * FROM j")
def d39_snapshot(spark, sf):
    """Every status of a raw snapshot with what is wrong."""
    return quality.audit_raw(*_snapshot(spark, sf), allowed=["src5"])


@query(
    "d39_snapshot_status",
    ctes(_SNAPSHOT) + """SELECT count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'auxiliary') AS auxiliary, 0 AS missing, count(*) FILTER (status = 'unexpected') AS unexpected, count(*) FILTER (status = 'invalid') AS invalid,
      count(*) FILTER (status = 'incompatible') AS incompatible, CASE WHEN count(*) FILTER (status NOT IN ('ok', 'auxiliary')) = 0 THEN 'ok' ELSE 'invalid' END AS status FROM j""",
)
def d39_status(spark, sf):
    return quality.audit_status(quality.audit_raw(*_snapshot(spark, sf), allowed=["src5"]))


@query(
    "d40_ready_audit_a28",
    ctes(FACTS, "m AS (SELECT max(day) AS m FROM facts)", "q AS (SELECT place, CASE WHEN fact_id % 997 = 0 THEN 'Q1-1999' ELSE year(day) || 'Q' || quarter(day) END AS quarter, amount / 5000 AS score FROM facts)")
    + """SELECT 'quarterly' AS "table", count(*) AS rows, count(*) FILTER (NOT score BETWEEN 0 AND 100) AS bad_scores, 0 AS bad_coordinates, 0 AS empty_cells, count(*) FILTER (NOT regexp_matches(quarter, '^\\d{4}Q[1-4]$')) AS malformed_quarters,
      count(*) FILTER (regexp_matches(quarter, '^\\d{4}Q[1-4]$') AND quarter < '2000Q1') AS early_quarters, 0 AS future_quarters, false AS valid FROM q
      UNION ALL SELECT 'points', count(*), 0, 0, 0, 0, 0, 0, true FROM events""".replace("\\\\", "\\"),
)
def d40(spark, sf):
    f = facts(spark, sf)
    q = f.select("place", F.when(F.col("fact_id") % 997 == 0, "Q1-1999").otherwise(clean.quarter_label(F.col("day"))).alias("quarter"), (F.col("amount") / 5000).alias("score"))
    return quality.audit_ready({"quarterly": q, "points": incidents(spark, sf)}, F.lit("2030-01-01").cast("date"), cells.CITY_BOX)


@query(
    "d40_ready_set",
    ctes(INCIDENTS, "q AS (SELECT count(*) AS n, count(*) FILTER (NOT o_totalprice / 5000 BETWEEN 0 AND 100) AS bad FROM orders)")
    + """SELECT 'quarterly' AS "table", n AS rows, CASE WHEN bad = 0 THEN 'ok' ELSE 'incompatible' END AS status FROM q UNION ALL SELECT 'points', count(*), 'ok' FROM incidents UNION ALL SELECT 'extra', count(*), 'unexpected' FROM incidents
      UNION ALL SELECT 'notes', count(*), 'auxiliary' FROM documents UNION ALL SELECT 'points.partial', count(*), 'invalid' FROM incidents UNION ALL SELECT 'baselines', NULL, 'missing'""",
)
def d40_set(spark, sf):
    """Published tables against the expected set: missing, unexpected, unfinished and failing ones."""
    i = incidents(spark, sf)
    have = {"quarterly": facts(spark, sf).select((F.col("amount") / 5000).alias("score")), "points": i, "extra": i, "notes": table(spark, sf, "documents").select("doc_id"), "points.partial": i}
    audited = quality.audit_ready(have, F.lit("2030-01-01").cast("date"), cells.CITY_BOX)
    return quality.audit_ready_set(audited, ["quarterly", "points", "baselines"], ["notes"])


@query(
    "a37_extra_checks",
    """SELECT round(count(*) FILTER (o_totalprice IS NOT NULL AND o_custkey IS NOT NULL) / count(*), 4) AS completeness, count(*) FILTER (o_totalprice > 10 * (SELECT quantile_cont(o_totalprice, 0.99) FROM orders)) AS outliers,
    (SELECT max(g) FROM (SELECT date_diff('day', lag(d) OVER (ORDER BY d), d) AS g FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders))) AS largest_gap_days, count(DISTINCT CAST(o_orderdate AS DATE)) AS days FROM orders""",
)
def a37(spark, sf):
    return quality.extra_checks(table(spark, sf, "orders"), "o_totalprice", "o_orderdate", ["o_totalprice", "o_custkey"])


@query(
    "d41_catalog_sync",
    "SELECT source AS id, max(n_chars) AS updated_at, max_by(doc_id, (n_chars, doc_id)) AS version, 1 AS page, true AS complete FROM documents GROUP BY 1",
)
def d41(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("id"), F.lit(1).alias("page"), F.struct("n_chars", "doc_id").alias("updated_at"), F.col("doc_id").alias("version"))
    out = quality.catalog_sync(d, 20)
    return out.withColumn("updated_at", F.col("updated_at.n_chars"))


# ---- filters, search, grading ------------------------------------------------------------------


@query(
    "p07_filter_document",
    """SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice BETWEEN 100000 AND 400000) AS total, 'nowhere' AS unapplied
    FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice BETWEEN 100000 AND 400000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50""",
)
def p07(spark, sf):
    doc = {"o_orderstatus": "F", "o_orderpriority": ["1-URGENT", "2-HIGH"], "o_totalprice": {"min": 100000, "max": 400000}, "nowhere": 3, "o_custkey": []}
    out = search.query_rows(table(spark, sf, "orders"), doc, [F.desc("o_totalprice"), F.col("o_orderkey")], 50)
    return out.select("o_orderkey", "o_totalprice", "total", "unapplied")


def _named(spark, sf):
    """Search queries: every distinct part name, some with a qualifier; sources: customers' names, then parts."""
    p = table(spark, sf, "part")
    q = p.groupBy("p_name").agg(F.min("p_partkey").alias("query_id")).select("query_id", F.concat("p_name", F.lit(", NY 10036")).alias("query"))
    first = places(spark, sf).select("place_id", "name")
    second = p.select(F.col("p_partkey").alias("place_id"), F.concat("p_name", F.lit(" "), "p_type").alias("name"))
    return q, [first, second]


@query(
    "d32_search",
    """WITH q AS (SELECT p_name, min(p_partkey) AS query_id FROM part GROUP BY 1), n AS (SELECT p_name || ' ' || p_type AS name, string_split(upper(p_name || ' ' || p_type), ' ') AS words, min(p_partkey) AS place_id FROM part GROUP BY 1, 2)
    SELECT query_id, 1 AS source_rank, place_id, name, rank FROM (SELECT query_id, place_id, name, row_number() OVER (PARTITION BY query_id ORDER BY length(name), name) AS rank FROM q JOIN n ON list_has_all(words, string_split(upper(q.p_name), ' '))) WHERE rank <= 5""",
)
def d32(spark, sf):
    q, sources = _named(spark, sf)
    return search.search(q, sources, 5)


_CASES = """cases AS (SELECT conv_id AS case_id, CASE conv_id % 3 WHEN 0 THEN 'lookup' WHEN 1 THEN 'compare' ELSE 'refuse' END AS intent, conv_id % 3 AS k FROM conversations GROUP BY 1),
  rs AS (SELECT conv_id AS case_id, list(role ORDER BY turn) AS tools, count(*) AS evidence, max(CASE WHEN role = 'assistant' THEN text END) AS answer, sum(length(text))::DOUBLE AS latency FROM conversations GROUP BY 1 HAVING count(*) FILTER (role = 'assistant') > 0)"""


def graded(spark, sf):
    c = table(spark, sf, "conversations")
    k = F.col("conv_id") % 3
    none = F.lit(None).cast("array<string>")
    arr = lambda *w: F.array(*[F.lit(x) for x in w])
    cases = c.select("conv_id").distinct().select(
        F.col("conv_id").alias("case_id"),
        F.when(k == 0, "lookup").when(k == 1, "compare").otherwise("refuse").alias("intent"),
        F.when(k == 0, arr("user", "assistant")).alias("all_tools"),
        F.when(k == 1, arr("user", "assistant", "user")).otherwise(none).alias("ordered_tools"),
        F.when(k == 2, arr("system")).otherwise(none).alias("forbidden_tools"),
        (k == 0).alias("evidence_required"),
        F.when(k == 1, arr("the", "DE ")).otherwise(none).alias("answer_terms_any"),
    )
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    # a conversation without an assistant turn has no response
    responses = c.groupBy(F.col("conv_id").alias("case_id")).agg(
        F.max(F.when(F.col("role") == "assistant", F.col("text"))).alias("answer"),
        F.transform(turns, lambda t: t["role"]).alias("tools_called"),
        F.count(F.lit(1)).cast("int").alias("evidence"),
        F.sum(F.length("text")).cast("double").alias("latency_ms"),
    )
    return evals.grade(cases, responses.where(F.col("answer").isNotNull()))


_GRADE = ctes(_CASES, """g AS (SELECT case_id, intent, latency, trim(coalesce(answer, '')) <> '' AND CASE k WHEN 0 THEN coalesce(list_has_all(tools, ['user', 'assistant']), false) AND coalesce(evidence, 0) > 0
  WHEN 1 THEN coalesce(regexp_matches(array_to_string(tools, ',') , 'user.*assistant.*user'), false) AND (contains(lower(coalesce(answer, '')), 'the') OR contains(lower(coalesce(answer, '')), 'de '))
  ELSE NOT coalesce(list_contains(tools, 'system'), false) END AS passed FROM cases LEFT JOIN rs USING (case_id))""")


@query("d42_graded_cases_f33_j23", _GRADE + "SELECT case_id, intent, passed FROM g")
def d42(spark, sf):
    return graded(spark, sf).select("case_id", "intent", "passed")


@query(
    "a38_eval_summary",
    _GRADE + """SELECT intent, count(*) FILTER (passed) AS passed, count(*) AS total, round(count(*) FILTER (passed) / count(*), 4) AS pass_rate, round(quantile_cont(latency, 0.5), 2) AS p50_ms, round(quantile_cont(latency, 0.95), 2) AS p95_ms FROM g GROUP BY 1""",
)
def a38(spark, sf):
    return evals.summary(graded(spark, sf))


_NEAR = "abs(v - {o}) <= greatest(0.005, 0.0005 * greatest(abs(v), abs({o})))"


@query(
    "f34_number_grounding",
    rf"""WITH n AS (SELECT DISTINCT source, lang, unnest(regexp_extract_all(text, '\d+\.\d+|\d{{2,}}')) AS token FROM documents),
      p AS (SELECT DISTINCT g.source, g.lang, n.token FROM (SELECT DISTINCT source, lang FROM n) g JOIN n ON n.source = g.source AND n.lang IS DISTINCT FROM g.lang),
      x AS (SELECT source, lang, list_distinct(list(token::DOUBLE)) AS p, list(token) AS pool FROM p GROUP BY 1, 2),
      c AS (SELECT n.source, n.lang, n.token, n.token::DOUBLE AS v, coalesce(p, []) AS p, coalesce(pool, []) AS pool FROM n LEFT JOIN x ON x.source = n.source AND x.lang IS NOT DISTINCT FROM n.lang)
    SELECT source, lang, token, CASE WHEN list_contains(pool, token) THEN 'literal' WHEN len(list_filter(p, lambda x: abs(v - x) <= 0.5)) > 0 THEN 'rounded'
      WHEN len(list_filter(p, lambda a: len(list_filter(p, lambda b: {_NEAR.format(o="(a - b)")} OR {_NEAR.format(o="(a + b)")} OR (b <> 0 AND {_NEAR.format(o="(a / b * 100)")}))) > 0)) > 0 THEN 'derived' ELSE 'unsupported' END AS label FROM c""",
)
def f34(spark, sf):
    """Numbers of a source's documents in one language against all numbers of its documents in the other languages."""
    from placescore.functions import text

    # distinct numbers first: copies of a text add nothing, whatever their share of the rows
    n = table(spark, sf, "documents").select("source", F.coalesce("lang", F.lit("")).alias("lang"), F.explode(text.numbers(F.col("text"))).alias("token")).distinct()
    groups = n.select("source", "lang").distinct()
    pool = n.withColumnRenamed("lang", "_other").join(groups, "source").where(F.col("_other") != F.col("lang")).select("source", "lang", "token")
    return evals.ground_numbers(n, pool, ["source", "lang"]).withColumn("lang", F.nullif("lang", F.lit("")))


@query(
    "f35_unsupported_places",
    r"""WITH p AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Near Upper West Side and the Bronx' WHEN 1 THEN 'In Westchester, not west' WHEN 2 THEN 'East Village or West Village' ELSE 'nothing' END AS a, CASE c_custkey % 3 WHEN 0 THEN 'bronx east village' ELSE '' END AS s FROM customer)
    SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN CASE WHEN s = '' THEN 'Bronx,Upper West Side' ELSE 'Upper West Side' END WHEN 1 THEN 'West' WHEN 2 THEN CASE WHEN s = '' THEN 'East Village,West Village' ELSE 'West Village' END ELSE '' END AS unsupported FROM p""",
)
def f35(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(
        "c_custkey", F.when(k % 4 == 0, "Near Upper West Side and the Bronx").when(k % 4 == 1, "In Westchester, not west").when(k % 4 == 2, "East Village or West Village").otherwise("nothing").alias("a"),
        F.when(k % 3 == 0, "bronx east village").otherwise("").alias("s"),
    )
    vocab = ["Bronx", "Upper West Side", "West", "East Village", "West Village"]
    return evals.unsupported_places(rows, "c_custkey", "a", "s", vocab).withColumn("unsupported", F.array_join("unsupported", ","))


@query(
    "a38_pass_power",
    "SELECT o_custkey AS case_id, count(*) AS attempts, bool_and(o_orderstatus <> 'P') AS all_passed, array_to_string(list_sort(list_distinct(list(CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END) FILTER (o_orderstatus = 'P'))), ',') AS failures FROM orders GROUP BY 1",
)
def a38p(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("case_id"), (F.col("o_orderstatus") != "P").alias("passed"),
        F.when(F.col("o_orderstatus") == "P", F.array("o_orderpriority")).otherwise(F.array().cast("array<string>")).alias("failures"),
    )
    return evals.pass_power(o).withColumn("failures", F.when(F.col("failures") != "", F.col("failures")))


# ---- context, clusters, reachability -----------------------------------------------------------

_CX, _CY = f"(({sql_ix('f.cell')} + 0.5::DOUBLE) * 300::DOUBLE)", f"(({sql_iy('f.cell')} + 0.5::DOUBLE) * 300::DOUBLE)"


@query(
    "d33_overview_context",
    ctes(INCIDENTS, TARGETS, "c AS (SELECT cell, count(*) AS n FROM incidents WHERE kind = 'view' GROUP BY cell)", f"s AS (SELECT cell, {sql_pct('n')} AS score FROM c)",
         "r AS (SELECT cell, score, round((rank() OVER (ORDER BY score) - 1 + 0.5::DOUBLE * count(*) OVER (PARTITION BY score)) / count(*) OVER (), 4) AS percentile FROM s)")
    + f"""SELECT target_id, cell, score, CASE WHEN score >= 65 THEN 'low' WHEN score >= 40 THEN 'moderate' ELSE 'high' END AS risk_level, percentile FROM (
      SELECT target_id, f.cell, score, percentile, row_number() OVER (PARTITION BY target_id ORDER BY sqrt(({sql_x('t.lon')} - {_CX}) ** 2 + ({sql_y('t.lat')} - {_CY}) ** 2), f.cell) AS rn FROM targets t, r f) WHERE rn = 1""",
)
def d33(spark, sf):
    c = cell_counts(spark, sf, "n", "kind = 'view'")
    return composite.overview_context(targets(spark, sf), cut_lineage(tables.percentile_score(c, "n")))


_EPS = 20.0
_SIDE = "(20.0::DOUBLE / sqrt(2.0::DOUBLE))"
_KM = "12742000::DOUBLE"
#: Density clusters from first principles: neighbours by distance, cores by count, clusters by recursion.
_HOT = f"""pt AS (SELECT lat, lon, {sql_x('lon')} AS x, {sql_y('lat')} AS y, count(*) AS w FROM incidents GROUP BY 1, 2),
  gr AS (SELECT *, floor(x / {_SIDE}) AS gx, floor(y / {_SIDE}) AS gy, {sql_pack(f"floor(x / {_SIDE})", f"floor(y / {_SIDE})")} AS g FROM pt),
  nb AS (SELECT a.lat, a.lon, a.g, b.lat AS blat, b.lon AS blon, b.g AS bg, b.w FROM gr a JOIN gr b ON b.gx BETWEEN a.gx - 2 AND a.gx + 2 AND b.gy BETWEEN a.gy - 2 AND a.gy + 2 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= {_EPS} + 1e-9),
  co AS (SELECT lat, lon, g FROM nb GROUP BY 1, 2, 3 HAVING sum(w) >= 6),
  ed AS (SELECT DISTINCT nb.g AS u, nb.bg AS v FROM nb JOIN co c ON c.lat = nb.lat AND c.lon = nb.lon JOIN co d ON d.lat = blat AND d.lon = blon),
  cl AS (SELECT u, u AS label FROM ed UNION SELECT cl.u, ed.v FROM cl JOIN ed ON ed.u = cl.label),
  lb AS (SELECT u AS g, min(label) AS cluster FROM cl GROUP BY 1),
  me AS (SELECT lat, lon, cluster FROM co JOIN lb USING (g) UNION ALL SELECT nb.lat, nb.lon, min(cluster) FROM nb JOIN co d ON d.lat = blat AND d.lon = blon JOIN lb ON lb.g = d.g LEFT JOIN co c ON c.lat = nb.lat AND c.lon = nb.lon WHERE c.g IS NULL GROUP BY 1, 2),
  ht AS (SELECT i.*, cluster FROM incidents i JOIN me USING (lat, lon)),
  ce AS (SELECT cluster, avg(lat) AS c_lat, avg(lon) AS c_lon, count(*) AS n FROM ht GROUP BY 1),
  kd AS (SELECT cluster, kind, count(*) AS k FROM ht GROUP BY 1, 2),
  dm AS (SELECT cluster, arg_min(kind, (-k, kind)) AS dominant, count(*) AS n_kinds FROM kd GROUP BY 1)"""


@query(
    "d22_hotspots",
    ctes(INCIDENTS, _HOT).replace("WITH ", "WITH RECURSIVE ", 1)
    + f"SELECT cluster, n, round(c_lat, 6) AS lat, round(c_lon, 6) AS lon, round(max({sql_hav('ht.lat', 'ht.lon', 'c_lat', 'c_lon')}), 2) AS radius_m, dominant, CAST(n_kinds AS INT) AS n_kinds FROM ce JOIN ht USING (cluster) JOIN dm USING (cluster) GROUP BY ALL",
)
def d22(spark, sf):
    """Clusters of all incidents; checked against brute force in the tests."""
    h = cluster.hotspots(incidents(spark, sf).select("event_id", "lat", "lon", "kind"), eps=20.0, min_samples=6)
    s = cluster.cluster_summary(h)
    return s.select("cluster", "n", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("radius_m", 2).alias("radius_m"), "dominant", F.size("kinds").alias("n_kinds"))


def walk_graph(spark, sf):
    """Nodes: parcels; edges: every parcel to the next and to an affine successor."""
    n = places(spark, sf).select(F.col("place_id").alias("node_id"), "lat", "lon")
    size = F.broadcast(n.agg(F.count(F.lit(1)).alias("_n")))
    k = F.col("node_id")
    e = n.select("node_id").join(size, F.lit(True)).select(
        k.alias("u"), F.explode(F.array((k * 7 + 1) % F.col("_n"), (k + 1) % F.col("_n"))).alias("v"), (20.0 + k % 80).alias("length_m")
    )
    return graph.clean_graph(n, e.where("u <> v"))


@query(
    "p20_clean_graph",
    """WITH n AS (SELECT count(*) AS n FROM customer), e AS (SELECT c_custkey AS u, (c_custkey * 7 + 1) % n AS v, 20.0 + c_custkey % 80 AS l FROM customer, n UNION ALL SELECT c_custkey, (c_custkey + 1) % n, 20.0 + c_custkey % 80 FROM customer, n)
    SELECT least(u, v) AS u, greatest(u, v) AS v, min(l) AS length_m FROM e WHERE u <> v GROUP BY 1, 2""",
)
def p20(spark, sf):
    return walk_graph(spark, sf)[1]


_BUDGET = "(3.0::DOUBLE * 60.0::DOUBLE * 1.33::DOUBLE)"
_NEAR = f"(abs(n.lat - t.lat) * 111320::DOUBLE <= {_BUDGET} * 1.45::DOUBLE AND abs(n.lon - t.lon) * 111320::DOUBLE * 0.7580107::DOUBLE <= {_BUDGET} * 1.45::DOUBLE)"


@query(
    "d28_reachable_nodes",
    ctes(
        PLACES,
        TARGETS,
        "ex AS (SELECT c_custkey AS u, (c_custkey * 7 + 1) % n AS v, 20.0::DOUBLE + c_custkey % 80 AS l FROM customer, (SELECT count(*) AS n FROM customer) UNION ALL SELECT c_custkey, (c_custkey + 1) % n, 20.0::DOUBLE + c_custkey % 80 FROM customer, (SELECT count(*) AS n FROM customer))",
        "eg AS (SELECT least(u, v) AS u, greatest(u, v) AS v, min(l) AS l FROM ex WHERE u <> v AND u IN (SELECT place_id FROM places) AND v IN (SELECT place_id FROM places) GROUP BY 1, 2)",
        "bo AS (SELECT u, v, l FROM eg UNION ALL SELECT v, u, l FROM eg)",
        f"sn AS (SELECT target_id, place_id AS node FROM targets t JOIN places n ON abs(n.lat - t.lat) * 111320::DOUBLE <= {_BUDGET} * 1.45::DOUBLE AND abs(n.lon - t.lon) * 111320::DOUBLE * 0.7580107::DOUBLE <= {_BUDGET} * 1.45::DOUBLE QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY {sql_d2('n.lat', 'n.lon', 't.lat', 't.lon')}, place_id) = 1)",
        f"wk AS (SELECT target_id, node, 0.0::DOUBLE AS dist FROM sn UNION SELECT wk.target_id, bo.v, wk.dist + bo.l FROM wk JOIN bo ON bo.u = wk.node JOIN targets t ON t.target_id = wk.target_id JOIN places n ON n.place_id = bo.v WHERE wk.dist + bo.l <= {_BUDGET} AND {_NEAR})",
        "ds AS (SELECT target_id, node, min(dist) AS dist FROM wk GROUP BY 1, 2)",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
    + "SELECT target_id, node, round(dist, 4) AS dist FROM ds WHERE target_id IN (SELECT target_id FROM ds GROUP BY 1 HAVING count(*) >= 4)",
)
def d28_nodes(spark, sf):
    """Every node a target reaches within three minutes, with its walking distance."""
    nodes, edges = walk_graph(spark, sf)
    return graph.reachable(targets(spark, sf), nodes, edges, minutes=3.0).withColumn("dist", F.round("dist", 4))


@query("d28_reachability")
def d28(spark, sf):
    """Nodes and hull area within three minutes of every target; checked against a shortest-path search in the tests."""
    nodes, edges = walk_graph(spark, sf)
    r = graph.reachable(targets(spark, sf), nodes, edges, minutes=3.0)
    return graph.reach_summary(r).join(graph.hull_area(r, nodes), "target_id").withColumn("area_km2", F.round("area_km2", 6))


# ---- sources and sinks -------------------------------------------------------------------------


def _written(spark, sf, kind: str):
    """The incident table written below the shared folder, to be read back by the source under test."""
    path = scratch_path(spark, f"incidents-{kind}")
    rows = incidents(spark, sf).select("event_id", "kind", "value", "lat", "lon", "cell")
    if kind == "parquet":
        publish.publish(publish.cluster_layout(rows, ["cell"]), path)
    elif kind == "csv":
        publish.write_csv(rows.withColumn("kind", F.when(F.col("kind") == "view", "N/A").otherwise(F.col("kind"))), path)
    elif kind == "json":
        publish.write_json(rows, path)
    else:
        publish.write_geojsonl(rows, path, "lon", "lat", ["event_id", "kind"])
    return path


@query("s01_csv_scan", "SELECT event_id, round(value, 2) AS value FROM events WHERE value BETWEEN 10 AND 20")
def s01(spark, sf):
    df = readers.read_csv(spark, _written(spark, sf, "csv"), ["event_id", "value"])
    t = readers.typed(df, {"event_id": "bigint", "value": "double"})
    return t.where(clean.between_cast(F.col("value"), 10, 20)).withColumn("value", F.round("value", 2))


@query("s02_csv_na_tokens", "SELECT nullif(event_type, 'view') AS kind, count(*) AS n FROM events GROUP BY 1")
def s02(spark, sf):
    return readers.read_csv_na(spark, _written(spark, sf, "csv")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("s03_strict_count", "SELECT count(*) AS rows FROM events")
def s03(spark, sf):
    n = readers.count_strict(spark, _written(spark, sf, "csv"))
    return spark.range(1).select(F.lit(n).cast("bigint").alias("rows"))


@query("s04_parquet_projection", "SELECT c_custkey, c_name FROM customer")
def s04(spark, sf):
    return readers.read_table(spark, f"{sf}/customer.parquet", ["c_custkey", "c_name"])


@query("s08_source_ladder", "SELECT 'processed' AS rung, count(*) AS rows FROM supplier")
def s08(spark, sf):
    kind, df = readers.resolve_source(spark, [("ready", f"{sf}/none.parquet"), ("processed", f"{sf}/supplier.parquet"), ("raw", f"{sf}/none.csv")])
    return df.agg(F.lit(kind).alias("rung"), F.count(F.lit(1)).alias("rows"))


@query("s10_publish_round_trip", ctes(INCIDENTS) + "SELECT cell, count(*) AS n, round(sum(value), 4) AS total FROM incidents GROUP BY 1")
def s10(spark, sf):
    t = readers.read_table(spark, _written(spark, sf, "parquet"))
    return t.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("s11_compaction_keeps_rows", ctes(INCIDENTS) + "SELECT count(*) AS rows, count(DISTINCT cell) AS cells FROM incidents")
def s11(spark, sf):
    path = _written(spark, sf, "parquet")
    publish.compact(spark, path, ["cell", "event_id"], 4)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("cell").alias("cells"))


@query("s12_rebuild_with_gate", ctes(FACTS) + "SELECT place, year(day) || 'Q' || quarter(day) AS quarter, count(*) AS count FROM facts GROUP BY 1, 2")
def s12(spark, sf):
    path = scratch_path(spark, "quarterly")
    q = tables.quarterly(facts(spark, sf), "place", "day")
    gate = lambda w: w.agg(F.count_if(~F.col("quarter").rlike(r"^\d{4}Q[1-4]$")).alias("malformed"), F.count_if(F.col("count") <= 0).alias("empty"))
    publish.rebuild(q, path, gate)
    return spark.read.parquet(path)


@query("s13_json_records", "SELECT event_type AS kind, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def s13(spark, sf):
    j = spark.read.schema("kind string, value double").json(_written(spark, sf, "json"))
    return j.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("s13_geojson_lines", ctes(INCIDENTS) + "SELECT event_id, round(lon, 6) AS lon, kind FROM incidents")
def s13g(spark, sf):
    lines = spark.read.text(_written(spark, sf, "geojsonl"))
    f = F.from_json("value", "type string, geometry struct<coordinates:array<double>>, properties struct<event_id:bigint,kind:string>")
    return lines.select(f.alias("f")).select("f.properties.event_id", F.round(F.col("f.geometry.coordinates")[0], 6).alias("lon"), "f.properties.kind")


@query("s14_s15_manifest_gate", "SELECT true AS valid_read, true AS stale_refused, count(*) AS rows FROM events")
def s15(spark, sf):
    path = _written(spark, sf, "parquet")
    manifest = publish.make_manifest(spark, path, "3.10.0")
    good = publish.read_published(spark, path, manifest, "3.10.0")
    stale = publish.read_published(spark, path, manifest.withColumn("row_count", F.col("row_count") + 1), "3.10.0")
    n = good.agg(F.count(F.lit(1)).alias("rows"))
    return n.select(F.lit(True).alias("valid_read"), F.lit(stale is None).alias("stale_refused"), "rows")


@query("s16_s17_input_stamps", "SELECT 'supplier' AS name, 'changed' AS change")
def s16(spark, sf):
    now = publish.stamp_inputs(spark, {t: f"{sf}/{t}.parquet" for t in ("customer", "supplier", "orders")})
    stored = now.withColumn("sha256", F.when(F.col("name") == "supplier", "0").otherwise(F.col("sha256")))
    return publish.stamp_difference(stored, now)


@query("s09_dataset_coverage", "SELECT lang AS dataset, lang <> 'fr' AS available FROM documents GROUP BY 1")
def s09(spark, sf):
    langs = table(spark, sf, "documents").select(F.col("lang").alias("dataset")).distinct()
    have = langs.where("dataset <> 'fr'")
    return langs.join(have.withColumn("available", F.lit(True)), "dataset", "left").withColumn("available", F.coalesce("available", F.lit(False)))


@query(
    "s05_delimited_estimates",
    "SELECT CAST(36000 + c_custkey AS VARCHAR) AS fips, c_acctbal AS estimate, CAST(c_nationkey AS DOUBLE) AS moe FROM customer WHERE CAST(36000 + c_custkey AS VARCHAR) LIKE '361%' OR CAST(36000 + c_custkey AS VARCHAR) LIKE '3605%'",
)
def s05(spark, sf):
    path = scratch_path(spark, "estimates")
    c = table(spark, sf, "customer").select(
        F.concat(F.lit("1400000US"), (36000 + F.col("c_custkey")).cast("string")).alias("GEO_ID"), F.col("c_acctbal").alias("E"), F.col("c_nationkey").alias("M")
    )
    c.write.option("header", True).option("sep", "|").csv(path)
    return readers.read_acs(spark, path, ["361", "3605"], "E", "M")


@query("s06_feature_collection", ctes(PLACES) + "SELECT zip AS zone_name, round(min(lon), 6) AS x0, round(max(lat), 6) AS y1, 5 AS vertices FROM places GROUP BY 1")
def s06(spark, sf):
    """Bounding boxes of the 25 postal codes as one feature collection, read back as shapes."""
    path = scratch_path(spark, "features")
    box = places(spark, sf).groupBy("zip").agg(F.min("lon").alias("a"), F.max("lon").alias("c"), F.min("lat").alias("b"), F.max("lat").alias("d"))
    v = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(v("a", "b"), v("c", "b"), v("c", "d"), v("a", "d"), v("a", "b"))
    feature = F.struct(
        F.lit("Feature").alias("type"), F.struct(F.col("zip").alias("ZIPCODE")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
    )
    doc = box.agg(F.collect_list(feature).alias("features")).select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value"))
    doc.write.text(path)
    f = readers.read_features(spark, path, {"zone_name": ["zip", "ZIPCODE"]})
    outline = F.col("shape")[0][0]
    return f.select(
        "zone_name", F.round(F.array_min(F.transform(outline, lambda p: p["x"])), 6).alias("x0"), F.round(F.array_max(F.transform(outline, lambda p: p["y"])), 6).alias("y1"), F.size(outline).alias("vertices")
    )


@query("s07_json_lines_responses", "SELECT conv_id || '-' || turn AS case_id, role AS answer_role, length(text) AS n FROM conversations")
def s07(spark, sf):
    path = scratch_path(spark, "responses")
    c = table(spark, sf, "conversations")
    case = F.concat_ws("-", "conv_id", "turn").alias("case_id")
    bare = F.to_json(F.struct(case, "role", "text"))
    wrapped = F.to_json(F.struct(case, F.struct("role", "text").alias("response")))
    c.select(F.when(F.col("turn") % 2 == 0, bare).otherwise(wrapped).alias("value")).write.text(path)
    r = readers.read_responses(spark, path)
    return r.select("case_id", F.get_json_object("response", "$.role").alias("answer_role"), F.length(F.get_json_object("response", "$.text")).alias("n"))


@query("t09_cluster_layout", ctes(INCIDENTS) + "SELECT cell, min(event_ts) AS first_ts, count(*) AS n FROM incidents GROUP BY cell")
def t09(spark, sf):
    """Range-partitioned by cell and sorted by cell and time: the aggregate needs no further shuffle of rows."""
    i = incidents(spark, sf).select("cell", "event_ts")
    return publish.cluster_layout(i, ["cell", "event_ts"]).groupBy("cell").agg(F.min("event_ts").alias("first_ts"), F.count(F.lit(1)).alias("n"))
