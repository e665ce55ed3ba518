"""Statistical audits: rank correlation, count-to-score curves, sensitivity draws, what-if projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placescore.operators import ordering
from placescore.session import cut_lineage


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation, NULL when a side is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def mean_curve(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean y per distinct x."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return rows.groupBy(*by, x).agg(F.avg(F.col(y).cast("double")).alias(y))


def running_max(df: DataFrame, x: str, y: str, by: Sequence[str] = (), out: str = "running") -> DataFrame:
    """Largest y at or before each x, as a prefix maximum over order-preserving buckets of x."""
    keys = list(by)
    rows = ordering.with_bucket(df, x, "_b")
    tops = rows.groupBy(*keys, "_b").agg(F.max(y).alias("_top"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*keys, "_b", F.max("_top").over(before).alias("_carry"))
    inside = Window.partitionBy(*keys, "_b").orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    joined = ordering.join_null_safe(rows, carried, [*keys, "_b"])
    return joined.withColumn(out, F.greatest(F.max(y).over(inside), F.col("_carry"))).select(*df.columns, out)


def slope(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares slope, NULL when x is constant."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    vx, vy = F.col(x).cast("double"), F.col(y).cast("double")
    fit = F.try_divide(F.covar_pop(vy, vx), F.var_pop(vx))
    return known.groupBy(*by).agg(
        F.when(F.max(x) > F.min(x), F.round(fit, 6)).alias("slope"), F.count(F.lit(1)).alias("n")
    )


def _ranked_corr(rows: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Pearson correlation of tie-averaged ranks per group; NULL below three rows or when a side is constant."""
    rows = cut_lineage(rows.select(*keys, a, b))
    ranked = rows.join(ordering.value_positions(rows, a, keys, "_a_"), [*keys, a]).join(
        ordering.value_positions(rows, b, keys, "_b_"), [*keys, b]
    )
    ra, rb = ordering.average_rank("_a_"), ordering.average_rank("_b_")
    varies = (F.max(ra) > F.min(ra)) & (F.max(rb) > F.min(rb)) & (F.count(F.lit(1)) >= 3)
    return ranked.groupBy(*keys).agg(
        F.when(varies, correlation(ra, rb)).alias("rho"), F.count(F.lit(1)).cast("bigint").alias("n")
    )


def metric_pairs(wide: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Rows of (metric_a, metric_b, va, vb) for every registered pair known on both sides.

    The pairs come from the metric registry (at most a few hundred whatever the data), one pass per row.
    """
    pairs = [
        F.struct(
            F.lit(a).alias("metric_a"),
            F.lit(b).alias("metric_b"),
            F.col(a).cast("double").alias("va"),
            F.col(b).cast("double").alias("vb"),
        )
        for a, b in combinations(metrics, 2)
    ]
    return (
        wide.select(F.explode(F.array(*pairs)).alias("_p"))
        .select("_p.*")
        .where(F.col("va").isNotNull() & F.col("vb").isNotNull())
    )


def spearman(wide: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Pairwise-complete Spearman matrix (upper triangle) of the columns of a wide table."""
    return _ranked_corr(metric_pairs(wide, metrics), ["metric_a", "metric_b"], "va", "vb")


def spearman_xy(df: DataFrame, x: str, y: str) -> DataFrame:
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.lit(1).alias("_g"), x, y)
    return _ranked_corr(known, ["_g"], x, y).drop("_g")


def spearman_series(rows: DataFrame, keys: Sequence[str], signal: str, period: str, value: str) -> DataFrame:
    """Spearman per group and signal pair over common periods.

    A (group, period) holds at most one row per registered signal, so the pairs stay few; ranks are
    windows over the quarters of one series.
    """
    known = rows.where(F.col(value).isNotNull())
    a = known.select(*keys, period, F.col(signal).alias("signal_a"), F.col(value).alias("_va"))
    b = known.select(*keys, period, F.col(signal).alias("signal_b"), F.col(value).alias("_vb"))
    both = a.join(b, [*keys, period]).where(F.col("signal_a") < F.col("signal_b"))
    group = [*keys, "signal_a", "signal_b"]

    def rank(c: str) -> Column:
        ties = F.count(F.lit(1)).over(Window.partitionBy(*group, c))
        return F.rank().over(Window.partitionBy(*group).orderBy(c)) + (ties - 1) / 2.0

    ranked = both.withColumns({"_ra": rank("_va"), "_rb": rank("_vb")})
    varies = (F.max("_ra") > F.min("_ra")) & (F.max("_rb") > F.min("_rb"))
    return ranked.groupBy(*group).agg(
        F.when(varies, correlation(F.col("_ra"), F.col("_rb"))).alias("rho"), F.count(F.lit(1)).alias("n")
    )


def with_p_value(df: DataFrame, rho: str = "rho", n: str = "n", out: str = "p_value") -> DataFrame:
    """Two-sided Student-t tail of a rank correlation, from the finite series for whole degrees of freedom."""
    nu = (F.col(n) - 2).cast("int")
    r = F.abs(F.col(rho))
    theta = F.atan(r / F.sqrt(F.greatest(1 - r * r, F.lit(1e-300))))
    sin, cos2 = F.sin(theta), F.cos(theta) * F.cos(theta)

    def series(last: Column, first: Column, ratio) -> Column:
        zero = F.struct(F.lit(0.0).alias("sum"), first.alias("term"))

        def step(acc: Column, k: Column) -> Column:
            return F.struct(
                (acc["sum"] + acc["term"]).alias("sum"), (acc["term"] * ratio(k + 1) * cos2).alias("term")
            )

        steps = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, zero, step)["sum"]

    even = sin * series(((nu - 2) / 2).cast("int"), F.lit(1.0), lambda k: (2.0 * k - 1) / (2.0 * k))
    odd_sum = series(F.when(nu >= 3, ((nu - 3) / 2).cast("int")).otherwise(F.lit(-1)), F.cos(theta), lambda k: 2.0 * k / (2.0 * k + 1))
    odd = F.lit(2.0 / 3.141592653589793) * (theta + sin * odd_sum)
    inside = F.when(nu % 2 == 0, even).otherwise(odd)
    return df.withColumn(out, F.when(nu >= 1, F.greatest(F.lit(0.0), 1 - inside)))


# Flag levels of the correlation audit.
HIGH, COLLINEAR = 0.7, 0.9


def correlation_report(wide: DataFrame, metrics: Sequence[str], declared: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Every metric pair with rho, n, flag level and whether the registry declares the overlap."""
    rho = spearman(wide, metrics)
    size = F.abs("rho")
    known = F.lit(False)
    for a, b in declared:
        known = known | F.col("metric_a").isin(a, b) & F.col("metric_b").isin(a, b)
    return rho.select(
        "metric_a",
        "metric_b",
        F.round("rho", 3).alias("rho"),
        "n",
        F.when(size >= COLLINEAR, "collinear").when(size >= HIGH, "high").alias("level"),
        known.alias("declared"),
    )


MAX_CURVE_POINTS = 60


def thin(curve: DataFrame, x: str, by: Sequence[str] = (), n: int = MAX_CURVE_POINTS) -> DataFrame:
    """At most n evenly spaced points of a curve (one row per x), the last one always kept."""
    placed = ordering.with_positions(curve, x, by, prefix="_t_")
    at, total = F.col("_t_below"), F.col("_t_total")
    slot = F.ceil(at * F.lit(float(n)) / total)
    chosen = (slot < n) & (F.floor(slot * total / F.lit(float(n))) == at)
    return placed.where((total <= n) | chosen | (at == total - 1)).select(*curve.columns)


def fit_curves(rows: DataFrame, minimum: int = 10) -> DataFrame:
    """Count-to-score curve per asset: monotone mean curve, slope, rank correlation, availability.

    ``rows`` is (asset, count, score). A curve has at most 61 points, so it travels as an array.
    """
    known = rows.where(F.col("count").isNotNull() & F.col("score").isNotNull()).withColumns(
        {"count": F.col("count").cast("double"), "score": F.col("score").cast("double")}
    )
    known = cut_lineage(known.select("asset", "count", "score"))
    curve = running_max(mean_curve(known, "count", "score", ["asset"]), "count", "score", ["asset"])
    kept = thin(cut_lineage(curve), "count", ["asset"]).select(
        "asset", F.struct(F.col("count").alias("x"), F.round("running", 3).alias("y")).alias("_p")
    )
    curves = kept.groupBy("asset").agg(F.array_sort(F.collect_list("_p")).alias("curve"))
    fit = slope(known, "count", "score", ["asset"])
    rho = _ranked_corr(known, ["asset"], "count", "score").select("asset", F.round("rho", 4).alias("rho"))
    return (
        fit.join(rho, "asset")
        .join(curves, "asset")
        .withColumn("available", F.col("n") >= minimum)
        .withColumn("curve", F.when(F.col("available"), F.col("curve")))
    )


def project(
    targets: DataFrame, scored: DataFrame, fits: DataFrame, asset: str, k: int, radius_m: float
) -> DataFrame:
    """Local mean score before and after adding k assets to each target's own cell.

    Only the curve's marginal effect is applied to the cell's real score; a cell without a score takes
    the curve level. Without an available curve every target stays, with its baseline and no projection. ``scored`` is (cell, raw_count, score), ``fits`` the output of :func:`fit_curves`.
    """
    from placescore.functions import cells
    from placescore.functions.score import curve_lookup
    from placescore.operators import spatial

    own = targets.withColumn("own_cell", cells.cell(F.col("lat"), F.col("lon")))
    disk = spatial.cells_within(own, radius_m).join(scored, "cell")
    mine = F.col("cell") == F.col("own_cell")
    local = (
        disk.join(own.select("target_id", "own_cell"), "target_id")
        .groupBy("target_id")
        .agg(
            F.avg("score").alias("_mean"),
            F.sum(F.when(~mine, F.col("score"))).alias("_others"),
            F.count(F.when(~mine, F.col("score"))).alias("_n"),
            F.max(F.when(mine, F.col("score"))).alias("_score"),
            F.max(F.when(mine, F.col("raw_count"))).alias("_count"),
        )
    )
    fit = fits.where((F.col("asset") == asset) & F.col("available")).select("curve", "slope", "rho")
    joined = targets.select("target_id").join(local, "target_id", "left").join(F.broadcast(fit), F.lit(True), "left")
    before = F.coalesce(F.col("_count"), F.lit(0)).cast("double")
    now = curve_lookup(F.col("curve"), F.col("slope"), before)
    after = curve_lookup(F.col("curve"), F.col("slope"), before + float(k))
    unit = F.when(F.col("_score").isNull(), after).otherwise(
        F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("_score") + after - now))
    )
    projected = (F.coalesce(F.col("_others"), F.lit(0)) + unit) / (F.coalesce(F.col("_n"), F.lit(0)) + 1)
    base = F.bround(F.col("_mean"), 0).cast("int")
    return joined.select(
        "target_id",
        F.coalesce(F.col("_count"), F.lit(0)).alias("count_before"),
        base.alias("baseline"),
        F.bround(projected, 0).cast("int").alias("projected"),
        F.round((F.bround(projected, 0) - F.bround(F.col("_mean"), 0)), 2).alias("delta"),
        (F.coalesce(F.col("rho"), F.lit(1.0)) < 0.7).alias("weak_fit"),
    )


# ---- sensitivity -------------------------------------------------------------------------------

NORMALISATIONS = ("percentile", "minmax", "zscore")
WEIGHT_NOISE = 0.25
_PRIME = 2147483647


def uniform(draw: Column, stream: int, seed: int) -> Column:
    """Reproducible uniform in [0, 1) of a draw and a stream number, by two multiplicative steps."""
    x = (draw.cast("bigint") * 1000003 + F.lit(stream * 7919 + seed + 1)) % _PRIME
    for _ in range(2):
        x = (x * 48271) % _PRIME
    return x / F.lit(float(_PRIME))


def draw_scores(
    frame: DataFrame,
    metrics: Sequence[str],
    structure: Mapping[str, tuple[float, Mapping[str, float]]],
    draws: int,
    seed: int,
    toggles: Sequence[str] = (),
) -> DataFrame:
    """Composite per (cell, draw) under perturbed weights, normalisation, toggles and missing-data rule.

    ``frame`` has cell and ``{norm}_{metric}`` columns, ``structure`` is category -> (weight, metric
    weights). Every row expands to its draws in place; draw parameters are arithmetic on the draw
    number, so nothing is joined or shuffled here.
    """
    means = frame.agg(
        *[F.avg(f"{n}_{m}").alias(f"_mean_{n}_{m}") for n in NORMALISATIONS for m in metrics]
    )
    rows = frame.join(F.broadcast(means), F.lit(True)).withColumn(
        "draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))
    )
    d = F.col("draw")
    norm = F.floor(uniform(d, 1, seed) * len(NORMALISATIONS)).cast("int")
    impute = uniform(d, 2, seed) < 0.5
    rows = rows.withColumns({"norm": norm, "imputed": impute}).withColumns(
        {f"with_{m}": uniform(d, 1000 + i, seed) < 0.5 for i, m in enumerate(toggles)}
    )

    def pick(prefix: str, m: str) -> Column:
        a, b, c = (F.col(f"{prefix}{n}_{m}") for n in NORMALISATIONS)
        return F.when(F.col("norm") == 0, a).when(F.col("norm") == 1, b).otherwise(c)

    # staged columns: each stage is used several times by the next, so the optimizer keeps them apart
    order = list(metrics)
    used = [(c, m, w) for c, (weight, members) in structure.items() if weight > 0 for m, w in members.items()]
    values, weights = {}, {}
    for _, m, w in used:
        value = pick("", m)
        values[f"_v_{m}"] = F.when(F.col("imputed"), F.coalesce(value, pick("_mean_", m))).otherwise(value)
        noise = F.lit(1 - WEIGHT_NOISE) + F.lit(2 * WEIGHT_NOISE) * uniform(d, 10 + order.index(m), seed)
        effective = F.lit(float(w)) * noise
        weights[f"_e_{m}"] = F.when(F.col(f"with_{m}"), effective).otherwise(F.lit(0.0)) if m in toggles else effective
    rows = rows.select(
        "cell", "draw", "norm", "imputed", *[f"with_{m}" for m in toggles],
        *[c.alias(n) for n, c in values.items()], *[c.alias(n) for n, c in weights.items()],
    )
    zero = F.lit(0.0)
    for c in structure:
        members = [m for cat, m, _ in used if cat == c]
        num = sum((F.coalesce(F.col(f"_v_{m}") * F.col(f"_e_{m}"), zero) for m in members), zero)
        den = sum((F.when(F.col(f"_v_{m}").isNotNull(), F.col(f"_e_{m}")).otherwise(zero) for m in members), zero)
        rows = rows.withColumns({f"_num_{c}": num, f"_den_{c}": den})
    live = [c for c, (weight, _) in structure.items() if weight > 0]
    rows = rows.withColumns({f"_c_{c}": _bounded(F.col(f"_num_{c}"), F.col(f"_den_{c}")) for c in live})
    top = sum((F.coalesce(F.col(f"_c_{c}") * structure[c][0], zero) for c in live), zero)
    bottom = sum((F.when(F.col(f"_c_{c}").isNotNull(), float(structure[c][0])).otherwise(zero) for c in live), zero)
    rows = rows.withColumns({"_top": top, "_bottom": bottom})
    return rows.select(
        "cell", "draw", "norm", "imputed", *[f"with_{m}" for m in toggles],
        _bounded(F.col("_top"), F.col("_bottom")).cast("int").alias("score"),
    )


def _bounded(top: Column, bottom: Column) -> Column:
    """Half-even rounded quotient within 0..100, NULL without weight."""
    return F.when(bottom > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.bround(top / bottom, 0))))


def normalised_frame(long: DataFrame, metrics: Mapping[str, bool]) -> DataFrame:
    """(cell, metric, value) to one row per cell with {norm}_{metric} columns, all metrics in one pass.

    ``metrics`` maps a metric to whether higher is better.
    """
    from placescore.functions.clean import literal_map

    known = cut_lineage(long.where(F.col("value").isNotNull()).withColumn("value", F.col("value").cast("double")))
    better = F.element_at(literal_map(dict(metrics)), F.col("metric"))
    placed = ordering.with_positions(known, "value", ["metric"], prefix="_p_")
    share = (F.col("_p_below") + (F.col("_p_n") + 1) / 2.0) / F.col("_p_total") * 100
    # one row per metric
    stats = known.groupBy("metric").agg(
        F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_sd")
    )
    v, flat = F.col("value"), F.col("_hi") == F.col("_lo")
    minmax = F.when(flat, 50.0).otherwise((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 100)
    zscore = F.when(flat, 50.0).otherwise(
        F.least(F.lit(100.0), F.greatest(F.lit(0.0), 50 + 10 * (v - F.col("_mean")) / F.col("_sd")))
    )
    scored = placed.join(F.broadcast(stats), "metric").withColumns({"_pct": share, "_mm": minmax, "_z": zscore, "_up": better})
    scored = scored.select(
        "cell",
        "metric",
        F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.bround(F.when(F.col("_up"), F.col("_pct")).otherwise(100.0 - F.col("_pct")), 0))).alias("percentile"),
        F.when(F.col("_up"), F.col("_mm")).otherwise(100 - F.col("_mm")).alias("minmax"),
        F.when(F.col("_up"), F.col("_z")).otherwise(100 - F.col("_z")).alias("zscore"),
    )
    return scored.groupBy("cell").agg(
        *[
            F.max(F.when(F.col("metric") == m, F.col(n))).alias(f"{n}_{m}")
            for n in NORMALISATIONS
            for m in metrics
        ]
    )


def draw_summary(draws: DataFrame) -> DataFrame:
    """Median, 95 % interval, production-normalisation interval and rank interval per cell.

    A group holds one row per draw, a parameter, so exact percentiles stay small. Ranks within a draw
    come from distributed numbering, not from a window over all cells. The draws are read twice by that
    numbering, so they are written once to the shared folder first.
    """
    draws = cut_lineage(draws)
    ranked = ordering.global_row_number(draws, "score", "cell", out="rank", by=["draw"])
    production = F.col("norm") == 0
    return ranked.groupBy("cell").agg(
        F.percentile("score", F.lit(0.5)).alias("median"),
        F.percentile("score", F.lit(0.025)).alias("low"),
        F.percentile("score", F.lit(0.975)).alias("high"),
        F.percentile(F.when(production, F.col("score")), F.lit(0.025)).alias("production_low"),
        F.percentile(F.when(production, F.col("score")), F.lit(0.975)).alias("production_high"),
        F.percentile("rank", F.lit(0.5)).alias("rank_median"),
        F.percentile("rank", F.lit(0.05)).alias("rank_low"),
        F.percentile("rank", F.lit(0.95)).alias("rank_high"),
    )


def branch_effects(draws: DataFrame, branches: Mapping[str, Column]) -> DataFrame:
    """Mean and 95th percentile over cells of |mean score with the branch - without it|."""
    per_cell = draws.groupBy("cell").agg(
        *[
            F.abs(F.avg(F.when(test, F.col("score"))) - F.avg(F.when(~test, F.col("score")))).alias(name)
            for name, test in branches.items()
        ]
    )
    long = per_cell.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("branch"), F.col(n).alias("delta")) for n in branches])).alias("_s")
    ).select("_s.*").where(F.col("delta").isNotNull())
    long = cut_lineage(long)
    p95 = ordering.exact_quantiles(long, "delta", [0.95], by=["branch"])
    mean = long.groupBy("branch").agg(F.round(F.avg("delta"), 2).alias("mean_abs_delta"))
    return mean.join(p95, "branch").select("branch", "mean_abs_delta", F.round(F.col("quantiles")[0], 2).alias("p95_abs_delta"))
