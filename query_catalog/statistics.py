"""Correlation, curves, what-if and sensitivity over the metric frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from placescore.operators import tables
from placescore.plans import registry, scenarios, stats
from placescore.session import cut_lineage
from query_catalog.fixtures import INCIDENTS, KIND_METRIC, ORACLES, PLACES, TARGETS, ctes, incidents, places, query, sql_d2, sql_pct, table, targets
from query_catalog.jobs import _wsum, metric_scores
from query_catalog.places import _DISK, _OFF
from query_catalog.points import near_zip

METRICS = sorted(KIND_METRIC.values())
_KIND = {m: k for k, m in KIND_METRIC.items()}


def frame(spark, sf):
    """Zero-filled counts per cell and metric, one column per metric (sanitation stays missing when absent)."""
    i = incidents(spark, sf)
    wide = i.groupBy("cell").agg(*[F.count_if(F.col("kind") == _KIND[m]).alias(m) for m in METRICS])
    return wide.withColumn("311_sanitation", F.when(F.col("311_sanitation") > 0, F.col("311_sanitation")))


FRAME = "fr AS (SELECT cell, " + ", ".join(
    (f"nullif(count(*) FILTER (kind = '{_KIND[m]}'), 0)" if m == "311_sanitation" else f"count(*) FILTER (kind = '{_KIND[m]}')") + f' AS "{m}"' for m in METRICS
) + " FROM incidents GROUP BY cell)"
_LONG = "lg AS (" + " UNION ALL ".join(f"SELECT cell, '{m}' AS m, \"{m}\" AS v FROM fr" for m in METRICS) + ")"
_RHO = """pp AS (SELECT a.m AS metric_a, b.m AS metric_b, a.cell, a.v AS va, b.v AS vb FROM lg a JOIN lg b ON a.cell = b.cell AND a.m < b.m WHERE a.v IS NOT NULL AND b.v IS NOT NULL),
  rk AS (SELECT metric_a, metric_b, rank() OVER (PARTITION BY metric_a, metric_b ORDER BY va) + (count(*) OVER (PARTITION BY metric_a, metric_b, va) - 1) / 2.0 AS ra,
    rank() OVER (PARTITION BY metric_a, metric_b ORDER BY vb) + (count(*) OVER (PARTITION BY metric_a, metric_b, vb) - 1) / 2.0 AS rb FROM pp),
  rho AS (SELECT metric_a, metric_b, corr(ra, rb) AS rho, count(*) AS n FROM rk GROUP BY 1, 2)"""


@query("a32_spearman_j15_pairs", ctes(INCIDENTS, FRAME, _LONG, _RHO) + "SELECT metric_a, metric_b, round(rho, 6) AS rho, n FROM rho")
def a32(spark, sf):
    return stats.spearman(frame(spark, sf), METRICS).withColumn("rho", F.round("rho", 6))


@query(
    "d23_correlation_report",
    ctes(INCIDENTS, FRAME, _LONG, _RHO) + """SELECT metric_a, metric_b, round(rho, 3) AS rho, n, CASE WHEN abs(rho) >= 0.9 THEN 'collinear' WHEN abs(rho) >= 0.7 THEN 'high' END AS level,
      metric_a = '311_sanitation' AND metric_b = 'collision' AS declared FROM rho""",
)
def d23(spark, sf):
    return stats.correlation_report(frame(spark, sf), METRICS, [("collision", "311_sanitation")])


_CURVE_ROWS = f"""ct AS (SELECT kind AS asset, cell, count(*)::DOUBLE AS count FROM incidents GROUP BY 1, 2), cs AS (SELECT asset, cell, count, {sql_pct('count', True, 'asset')}::DOUBLE AS score FROM ct)"""
_FIT = """mn AS (SELECT asset, count AS x, avg(score) AS y FROM cs GROUP BY 1, 2), rm AS (SELECT asset, x, max(y) OVER (PARTITION BY asset ORDER BY x) AS y, row_number() OVER (PARTITION BY asset ORDER BY x) - 1 AS pos, count(*) OVER (PARTITION BY asset) AS total FROM mn),
  kept AS (SELECT * FROM rm WHERE total <= 60 OR pos = total - 1 OR (ceil(pos * 60.0::DOUBLE / total) < 60 AND floor(ceil(pos * 60.0::DOUBLE / total) * total / 60.0::DOUBLE) = pos)),
  ft AS (SELECT asset, round(regr_slope(score, count), 6) AS slope, count(*) AS n FROM cs GROUP BY 1)"""


def curve_rows(spark, sf):
    c = incidents(spark, sf).groupBy(F.col("kind").alias("asset"), "cell").agg(F.count(F.lit(1)).cast("double").alias("count"))
    return tables.percentile_score(c, "count", True, by=["asset"])


@query(
    "d26_fit_curves_w08_w09",
    ctes(INCIDENTS, _CURVE_ROWS, _FIT) + "SELECT asset, any_value(slope) AS slope, any_value(n) AS n, count(*) AS points, round(sum(round(y, 3)), 3) AS y_sum, round(max(x), 1) AS x_max FROM kept JOIN ft USING (asset) GROUP BY 1",
)
def d26(spark, sf):
    f = stats.fit_curves(curve_rows(spark, sf))
    return f.select(
        "asset", "slope", "n", F.size("curve").alias("points"),
        F.round(F.aggregate("curve", F.lit(0.0), lambda a, p: a + p["y"]), 3).alias("y_sum"), F.element_at("curve", -1)["x"].alias("x_max"),
    )


@query(
    "d27_what_if_projection",
    ctes(INCIDENTS, TARGETS, _OFF, _DISK, _CURVE_ROWS, _FIT, "own AS (SELECT target_id, cell AS own_cell FROM disk WHERE dx = 0 AND dy = 0)",
         "kn AS (SELECT x, round(y, 3) AS y, lead(x) OVER (ORDER BY x) AS x1, lead(round(y, 3)) OVER (ORDER BY x) AS y1 FROM kept WHERE asset = 'view')",
         "lo AS (SELECT t.target_id, any_value(o.own_cell) AS own_cell, avg(c.score) AS mean, coalesce(sum(c.score) FILTER (c.cell <> o.own_cell), 0) AS others, count(c.score) FILTER (c.cell <> o.own_cell) AS n, max(c.score) FILTER (c.cell = o.own_cell) AS s, coalesce(max(c.count) FILTER (c.cell = o.own_cell), 0) AS x "
         "FROM targets t JOIN own o USING (target_id) LEFT JOIN disk d USING (target_id) LEFT JOIN cs c ON c.cell = d.cell AND c.asset = 'view' GROUP BY 1)",
         "en AS (SELECT (SELECT y FROM kn ORDER BY x LIMIT 1) AS fy, (SELECT x FROM kn ORDER BY x LIMIT 1) AS fx, (SELECT y FROM kn ORDER BY x DESC LIMIT 1) AS ly, (SELECT x FROM kn ORDER BY x DESC LIMIT 1) AS lx, (SELECT slope FROM ft WHERE asset = 'view') AS sl)",
         "ev AS (SELECT lo.*, q.k, CASE WHEN x + q.k <= fx THEN fy WHEN x + q.k > lx THEN least(100, greatest(ly, ly + sl * (x + q.k - lx))) ELSE (SELECT kn.y + (lo.x + q.k - kn.x) / (kn.x1 - kn.x) * (kn.y1 - kn.y) FROM kn WHERE kn.x < lo.x + q.k AND kn.x1 >= lo.x + q.k) END AS c FROM lo, en, (VALUES (0), (3)) q(k))",
         "ab AS (SELECT target_id, any_value(mean) AS mean, any_value(others) AS others, any_value(n) AS n, any_value(s) AS s, any_value(x) AS x, max(c) FILTER (k = 0) AS c0, max(c) FILTER (k = 3) AS c1 FROM ev GROUP BY 1)")
    + """SELECT target_id, x AS count_before, CAST(round_even(mean, 0) AS INT) AS baseline, CAST(round_even((others + CASE WHEN s IS NULL THEN c1 ELSE least(100, greatest(0, s + c1 - c0)) END) / (n + 1), 0) AS INT) AS projected, false AS weak_fit FROM ab""",
)
def d27(spark, sf):
    rows = curve_rows(spark, sf)
    fits = stats.fit_curves(rows)
    scored = rows.where("asset = 'view'").select("cell", F.col("count").alias("raw_count"), "score")
    p = stats.project(targets(spark, sf), scored, fits, "view", 3, 500.0)
    return p.drop("delta")


_SUBS = {"safety": {"collision": 0.3125, "311_sanitation": 0.125}, "transit": {"subway": 1.0}, "amenities": {"trees": 0.15, "linknyc": 0.1, "parks": 0.25}}
_TOP = {"safety": 0.4, "transit": 0.3, "amenities": 0.3}
_ADDED = [("click", "safety", "311_sanitation", "cell"), ("view", "transit", "subway", "cell"), ("purchase", "amenities", "trees", "cell"), ("signup", "amenities", "linknyc", "cell"), ("parks", "amenities", "parks", "zip")]
_SOURCE = {"collision": "error"} | {metric: asset for asset, _, metric, _ in _ADDED}


def _col(metric: str) -> str:
    return "m_" + metric.replace("311_", "")


def _composite(of) -> str:
    cats = {c: _wsum([(of(m), w) for m, w in subs.items()]) for c, subs in _SUBS.items()}
    return ", ".join(f"{sql} AS {c}" for c, sql in cats.items())


_ALL = list(dict.fromkeys(_SOURCE.values()))
_KS = 3
_WHAT_IF = [
    f"z AS (SELECT target_id, zip FROM targets t JOIN places p ON true QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY {sql_d2('p.lat', 'p.lon', 't.lat', 't.lon')}, place_id) = 1)",
    "own AS (SELECT target_id, cell AS own_cell FROM disk WHERE dx = 0 AND dy = 0)",
    f"zs AS (SELECT *, {sql_pct('count')}::DOUBLE AS score FROM (SELECT 'parks' AS asset, zip, count(*)::DOUBLE AS count FROM places GROUP BY 2))",
    "bo AS (SELECT asset, count, score FROM cs UNION ALL SELECT asset, count, score FROM zs)",
    "mn2 AS (SELECT asset, count AS x, avg(score) AS y FROM bo GROUP BY 1, 2)",
    "rm2 AS (SELECT asset, x, max(y) OVER (PARTITION BY asset ORDER BY x) AS y, row_number() OVER (PARTITION BY asset ORDER BY x) - 1 AS pos, count(*) OVER (PARTITION BY asset) AS total FROM mn2)",
    "kn AS (SELECT asset, x, round(y, 3) AS y, lead(x) OVER (PARTITION BY asset ORDER BY x) AS x1, lead(round(y, 3)) OVER (PARTITION BY asset ORDER BY x) AS y1 FROM rm2 WHERE total <= 60 OR pos = total - 1 OR (ceil(pos * 60.0::DOUBLE / total) < 60 AND floor(ceil(pos * 60.0::DOUBLE / total) * total / 60.0::DOUBLE) = pos))",
    "fq AS (SELECT *, rank() OVER (PARTITION BY asset ORDER BY count) + (count(*) OVER (PARTITION BY asset, count) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY asset ORDER BY score) + (count(*) OVER (PARTITION BY asset, score) - 1) / 2.0 AS rb FROM bo)",
    "en AS (SELECT k.asset, min(k.x) AS fx, arg_min(k.y, k.x) AS fy, max(k.x) AS lx, arg_max(k.y, k.x) AS ly, any_value(f.sl) AS sl, any_value(f.rho) AS rho FROM kn k JOIN (SELECT asset, round(regr_slope(score, count), 6) AS sl, round(corr(ra, rb), 4) AS rho, count(*) AS c FROM fq GROUP BY 1) f USING (asset) WHERE f.c >= 10 GROUP BY 1)",
    "u AS (SELECT d.target_id, c.asset, c.cell = o.own_cell AS mine, c.count, c.score FROM disk d JOIN own o USING (target_id) JOIN cs c ON c.cell = d.cell UNION ALL SELECT target_id, asset, true, count, score FROM z JOIN zs USING (zip))",
    "al AS (SELECT unnest([" + ", ".join(f"'{a}'" for a in _ALL) + "]) AS asset)",
    "lo AS (SELECT t.target_id, al.asset, avg(score) AS mean, coalesce(sum(score) FILTER (NOT mine), 0) AS others, count(score) FILTER (NOT mine) AS n, max(score) FILTER (mine) AS s, coalesce(max(count) FILTER (mine), 0) AS x FROM targets t JOIN al ON true LEFT JOIN u ON u.target_id = t.target_id AND u.asset = al.asset GROUP BY 1, 2)",
    f"ev AS (SELECT lo.*, en.rho, q.k, CASE WHEN x + q.k <= fx THEN fy WHEN x + q.k > lx THEN least(100, greatest(ly, ly + sl * (x + q.k - lx))) ELSE (SELECT kn.y + (lo.x + q.k - kn.x) / (kn.x1 - kn.x) * (kn.y1 - kn.y) FROM kn WHERE kn.asset = lo.asset AND kn.x < lo.x + q.k AND kn.x1 >= lo.x + q.k) END AS c FROM lo JOIN en USING (asset) JOIN (VALUES (0), ({_KS})) q(k) ON true)",
    f"ab AS (SELECT target_id, asset, any_value(mean) AS mean, any_value(others) AS others, any_value(n) AS n, any_value(s) AS s, any_value(x) AS x, any_value(rho) AS rho, max(c) FILTER (k = 0) AS c0, max(c) FILTER (k = {_KS}) AS c1 FROM ev GROUP BY 1, 2)",
    "pj AS (SELECT *, CASE WHEN s IS NULL THEN c1 ELSE least(100, greatest(0, s + c1 - c0)) END AS unit, CAST(round_even(mean, 0) AS INT) AS sub_before, CAST(round_even((others + CASE WHEN s IS NULL THEN c1 ELSE least(100, greatest(0, s + c1 - c0)) END) / (n + 1), 0) AS INT) AS sub_after FROM ab)",
    "pw AS (SELECT target_id, " + ", ".join(f"max(CAST(round_even(mean, 0) AS INT)) FILTER (asset = '{a}') AS {_col(m)}" for m, a in _SOURCE.items()) + " FROM lo GROUP BY 1)",
    "b0 AS (SELECT target_id, " + _composite(_col) + " FROM pw)",
    "pa AS (SELECT pj.target_id, pj.asset, " + ", ".join(f"CASE WHEN pj.asset = '{a}' THEN sub_after ELSE {_col(m)} END AS {_col(m)}" for m, a in _SOURCE.items()) + " FROM pj JOIN pw USING (target_id))",
    "a0 AS (SELECT target_id, asset, " + _composite(_col) + " FROM pa)",
    "b1 AS (SELECT *, " + _wsum([(c, w) for c, w in _TOP.items()]) + " AS overall FROM b0)",
    "a1 AS (SELECT *, " + _wsum([(c, w) for c, w in _TOP.items()]) + " AS overall FROM a0)",
]
_CATS = [*_SUBS, "overall"]


@query(
    "d27_what_if_all_scores",
    ctes(INCIDENTS, TARGETS, PLACES, _OFF, _DISK, _CURVE_ROWS, *_WHAT_IF)
    + f"SELECT target_id, pj.asset, 'ok' AS status, x AS count_before, x + {_KS} AS count_after, s AS unit_before, round(unit, 2) AS unit_after, sub_before, sub_after, coalesce(rho, 1) < 0.7 AS weak_fit, "
    + ", ".join(f"b1.{c} AS {c}_before, a1.{c} AS {c}_after, round(a1.{c} - b1.{c}, 2) AS {c}_delta" for c in _CATS)
    + " FROM pj JOIN b1 USING (target_id) JOIN a1 USING (target_id, asset) WHERE pj.asset <> 'error'",
)
def d27_all(spark, sf):
    """Five assets added at every target, four by cell and one by postal code: every score before, after and its change."""
    c = curve_rows(spark, sf).select("asset", "cell", "count", F.col("score").cast("double").alias("score"))
    p = places(spark, sf).groupBy("zip").agg(F.count(F.lit(1)).cast("double").alias("count"))
    zips = tables.percentile_score(p, "count", True).select(F.lit("parks").alias("asset"), "zip", "count", F.col("score").cast("double").alias("score"))
    c, zips = cut_lineage(c), cut_lineage(zips)
    fits = stats.fit_curves(c.select("asset", "count", "score").unionByName(zips.select("asset", "count", "score")))
    t = targets(spark, sf).join(near_zip(spark, sf), "target_id", "left")
    return scenarios.what_if(t, c, zips, fits, [scenarios.Asset(*a) for a in _ADDED], _SOURCE, _SUBS, _TOP, _KS, 500.0)


# ---- sensitivity -------------------------------------------------------------------------------

DRAWS, SEED = 60, 20260811
#: Draws of the reference.
FULL_DRAWS = 1000
_STRUCTURE = {
    "safety": (0.4, {"collision": 0.3125, "311_sanitation": 0.125}),
    "transit": (0.3, {"subway": 1.0}),
    "amenities": (0.3, {"trees": 0.15, "linknyc": 0.1}),
}


def norm_frame(spark, sf):
    """cell with {norm}_{metric} columns for the three normalisations."""
    f = frame(spark, sf)
    long = f.select("cell", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])).alias("_m")).select("cell", "_m.*")
    return stats.normalised_frame(long, {m: registry.METRICS_BY_ID[m].higher_is_better for m in METRICS})


def _u(draw: str, stream: int) -> str:
    x = f"(({draw}::BIGINT * 1000003 + {stream * 7919 + SEED + 1}) % 2147483647)"
    for _ in range(2):
        x = f"(({x} * 48271) % 2147483647)"
    return f"({x} / 2147483647::DOUBLE)"


def _norm_cte(m: str) -> str:
    better = registry.METRICS_BY_ID[m].higher_is_better
    o = "{}" if better else "100 - {}"
    mm = o.format("(v - lo) / (hi - lo) * 100")
    z = o.format("least(100.0::DOUBLE, greatest(0.0, 50 + 10 * (v - me) / sd))")
    return (
        f'"n_{m}" AS (SELECT cell, {sql_pct("v", better)}::DOUBLE AS "p_{m}", {mm} AS "m_{m}", {z} AS "z_{m}" FROM (SELECT cell, "{m}"::DOUBLE AS v FROM fr WHERE "{m}" IS NOT NULL), '
        f'(SELECT min("{m}")::DOUBLE AS lo, max("{m}")::DOUBLE AS hi, avg("{m}") AS me, stddev_pop("{m}") AS sd FROM fr))'
    )


def _draw_sql() -> str:
    joins = "fr " + " ".join(f'LEFT JOIN "n_{m}" USING (cell)' for m in METRICS)
    cols = ", ".join(f'"{p}_{m}"' for m in METRICS for p in "pmz")
    means = ", ".join(f'avg("{p}_{m}") AS "a{p}_{m}"' for m in METRICS for p in "pmz")
    pick = lambda pre, m: f'CASE norm WHEN 0 THEN "{pre}p_{m}" WHEN 1 THEN "{pre}m_{m}" ELSE "{pre}z_{m}" END'
    vals = ", ".join(f'CASE WHEN imputed THEN coalesce({pick("", m)}, {pick("a", m)}) ELSE {pick("", m)} END AS "v_{m}"' for m in METRICS)
    effs = []
    for _, members in _STRUCTURE.values():
        for m, w in members.items():
            e = f"{w}::DOUBLE * (0.75::DOUBLE + 0.5::DOUBLE * {_u('draw', 10 + METRICS.index(m))})"
            effs.append((f"CASE WHEN w311 THEN {e} ELSE 0 END" if m == "311_sanitation" else e) + f' AS "e_{m}"')
    cats = []
    for c, (_, members) in _STRUCTURE.items():
        num = " + ".join(f'coalesce("v_{m}" * "e_{m}", 0)' for m in members)
        den = " + ".join(f'CASE WHEN "v_{m}" IS NULL THEN 0 ELSE "e_{m}" END' for m in members)
        cats.append(f"CASE WHEN ({den}) > 0 THEN least(100, greatest(0, round_even(({num}) / ({den}), 0))) END AS c_{c}")
    top = " + ".join(f"coalesce(c_{c} * {w}::DOUBLE, 0)" for c, (w, _) in _STRUCTURE.items())
    low = " + ".join(f"CASE WHEN c_{c} IS NULL THEN 0 ELSE {w}::DOUBLE END" for c, (w, _) in _STRUCTURE.items())
    return ctes(
        INCIDENTS, FRAME, *[_norm_cte(m) for m in METRICS], f"nf AS (SELECT cell, {cols} FROM {joins})", f"mean AS (SELECT {means} FROM nf)",
        f"d AS (SELECT i AS draw, CAST(floor({_u('i', 1)} * 3) AS INT) AS norm, {_u('i', 2)} < 0.5 AS imputed, {_u('i', 1000)} < 0.5 AS w311 FROM range({DRAWS}) r(i))",
        f"dv AS (SELECT cell, draw, norm, imputed, w311, {vals}, {', '.join(effs)} FROM nf, mean, d)",
        f"dc AS (SELECT cell, draw, norm, imputed, w311, {', '.join(cats)} FROM dv)",
        f"ds AS (SELECT cell, draw, norm, imputed, w311, CASE WHEN ({low}) > 0 THEN CAST(round_even(({top}) / ({low}), 0) AS INT) END AS score FROM dc)",
    )


def draws(spark, sf, n):
    return stats.draw_scores(norm_frame(spark, sf), METRICS, _STRUCTURE, n, SEED, toggles=["311_sanitation"])


@query(
    "d24_sensitivity_a33_j17",
    _draw_sql()[:-1] + """, rk AS (SELECT *, CASE WHEN score IS NOT NULL THEN row_number() OVER (PARTITION BY draw ORDER BY score DESC NULLS LAST, cell) END AS rank FROM ds)
    SELECT cell, quantile_cont(score::DOUBLE, 0.5) AS median, round(quantile_cont(score::DOUBLE, 0.025), 4) AS low, round(quantile_cont(score::DOUBLE, 0.975), 4) AS high,
      round(quantile_cont(score::DOUBLE, 0.025) FILTER (norm = 0), 4) AS production_low, round(quantile_cont(score::DOUBLE, 0.975) FILTER (norm = 0), 4) AS production_high,
      quantile_cont(rank::DOUBLE, 0.5) AS rank_median, round(quantile_cont(rank::DOUBLE, 0.05), 4) AS rank_low, round(quantile_cont(rank::DOUBLE, 0.95), 4) AS rank_high FROM rk GROUP BY cell""",
)
def d24(spark, sf, n=DRAWS):
    s = stats.draw_summary(draws(spark, sf, n))
    return s.withColumns({c: F.round(c, 4) for c in ("low", "high", "production_low", "production_high", "rank_low", "rank_high")})


@query(
    "a34_branch_effects",
    _draw_sql()[:-1] + """, pc AS (SELECT cell, abs(avg(score) FILTER (w311) - avg(score) FILTER (NOT w311)) AS toggle, abs(avg(score) FILTER (imputed) - avg(score) FILTER (NOT imputed)) AS impute FROM ds GROUP BY cell),
    lg AS (SELECT 'toggle' AS branch, toggle AS delta FROM pc UNION ALL SELECT 'impute', impute FROM pc)
    SELECT branch, round(avg(delta), 2) AS mean_abs_delta, round(quantile_cont(delta, 0.95), 2) AS p95_abs_delta FROM lg WHERE delta IS NOT NULL GROUP BY 1""",
)
def a34(spark, sf, n=DRAWS):
    return stats.branch_effects(draws(spark, sf, n), {"toggle": F.col("with_311_sanitation"), "impute": F.col("imputed")})


@query(
    "d25_uncertainty_lookup",
    _draw_sql()[:-1] + """, it AS (SELECT cell, quantile_cont(score::DOUBLE, 0.5) AS median, quantile_cont(score::DOUBLE, 0.025) FILTER (norm = 0) AS lo, quantile_cont(score::DOUBLE, 0.975) FILTER (norm = 0) AS hi FROM ds GROUP BY cell),
    n AS (SELECT ['Very low', 'Low', 'Middle', 'High', 'Very high'] AS names)
    SELECT cell, median, round((rank() OVER (ORDER BY median) - 1 + 0.5::DOUBLE * count(*) OVER (PARTITION BY median)) / count(*) OVER (), 4) AS percentile,
      CASE WHEN least(4, floor(lo / 20)) = least(4, floor(hi / 20)) THEN names[CAST(least(4, floor(lo / 20)) AS INT) + 1] ELSE names[CAST(least(4, floor(lo / 20)) AS INT) + 1] || '–' || names[CAST(least(4, floor(hi / 20)) AS INT) + 1] END AS tier FROM it, n""",
)
def d25(spark, sf, n=DRAWS):
    from placescore.plans import composite

    return composite.uncertainty(cut_lineage(stats.draw_summary(draws(spark, sf, n))))


def _with_all_draws(name: str, short: str, fn) -> None:
    """Register a sensitivity query a second time with the draws of the reference; its SQL differs in the range only."""
    sql = ORACLES[name].replace(f"range({DRAWS}) r(i)", f"range({FULL_DRAWS}) r(i)")
    query(f"{short}_{FULL_DRAWS}_draws", sql)(lambda spark, sf: fn(spark, sf, FULL_DRAWS))


_with_all_draws("d24_sensitivity_a33_j17", "d24_sensitivity", d24)
_with_all_draws("a34_branch_effects", "a34_branch_effects", a34)
_with_all_draws("d25_uncertainty_lookup", "d25_uncertainty_lookup", d25)
