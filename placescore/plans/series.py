"""Quarterly series, windows, persistence, anomaly, trends, co-movement and evidence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placescore.functions import clean
from placescore.functions import score as S
from placescore.operators import spatial


def local_quarterly(targets: DataFrame, quarterly: DataFrame, radius_m: float, as_of: DataFrame) -> DataFrame:
    """Quarterly sums over the cells within the radius, with the share of those cells that have data.

    ``quarterly`` is (cell, quarter, count), ``as_of`` one row; the quarter holding it is incomplete.
    """
    disk = spatial.cells_within(targets, radius_m)
    size = disk.groupBy("target_id").agg(F.count(F.lit(1)).alias("coverage_cells"))
    sums = disk.join(quarterly, "cell").groupBy("target_id", "quarter").agg(
        F.sum("count").alias("value"), F.count_distinct("cell").alias("coverage_n")
    )
    now = clean.quarter_label(F.col("as_of"))
    return (
        sums.join(size, "target_id")
        .join(F.broadcast(as_of.select(now.alias("_now"))), F.lit(True))
        .select(
            "target_id",
            "quarter",
            "value",
            "coverage_n",
            "coverage_cells",
            F.round(F.col("coverage_n") / F.col("coverage_cells"), 4).alias("coverage"),
            (F.col("quarter") != F.col("_now")).alias("period_complete"),
        )
    )


# Persistence threshold per signal (None: no quarterly series).
THRESHOLDS: dict[str, int | None] = {
    "collision": 25,
    "rodent": 8,
    "311_sanitation": 12,
    "ems_response": None,
    "fire_response": None,
    "housing_violations": 10,
}


def persistence(series: DataFrame, keys: Sequence[str], threshold: Column) -> DataFrame:
    """Consecutive complete quarters above the threshold, counting back from the latest one.

    ``series`` has quarter, value, period_complete. A run goes on while quarter index minus its reverse
    position is constant and every value exceeds the threshold: the first row that breaks either rule
    ends it, so the run length is the smallest breaking position minus one. Series are quarters long.
    """
    rows = series.where("period_complete").withColumn("_qi", clean.quarter_index(F.col("quarter")))
    w = Window.partitionBy(*keys).orderBy(F.desc("_qi"))
    spot = F.row_number().over(w)
    gap = F.first("_qi").over(w) - F.col("_qi") + 1 != spot
    broken = gap | F.coalesce(F.col("value") <= threshold, F.lit(True)) | threshold.isNull()
    marked = rows.withColumn("_spot", spot).withColumn("_broken", broken)
    return marked.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(F.col("_broken"), F.col("_spot"))) - 1, F.max("_spot")).cast("int").alias("consecutive_above")
    )


def anomaly(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Latest complete observed quarter against all earlier ones, population deviation, |z| > 1.5."""
    rows = series.where(F.col("period_complete") & F.col("value").isNotNull()).withColumn(
        "_qi", clean.quarter_index(F.col("quarter"))
    )
    last = Window.partitionBy(*keys).orderBy(F.desc("_qi"))
    v = F.col("value").cast("double")
    old = F.when(F.col("_r") > 1, v)
    stats = (
        rows.withColumn("_r", F.row_number().over(last))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_observations"),
            F.avg(old).alias("_mean"),
            F.stddev_pop(old).alias("_sd"),
            F.max(F.when(F.col("_r") == 1, v)).alias("_latest"),
            F.max(F.when(F.col("_r") == 1, F.col("quarter"))).alias("latest_period"),
        )
    )
    z = (F.col("_latest") - F.col("_mean")) / F.col("_sd")
    short = F.col("n_observations") < 4
    flat = F.col("_sd") == 0
    return stats.select(
        *keys,
        "n_observations",
        F.when(short, F.lit(False))
        .when(flat, F.col("_latest") != F.col("_mean"))
        .otherwise(F.abs(z) > 1.5)
        .alias("is_anomaly"),
        F.when(~short & ~flat, F.round(z, 2)).alias("z_score"),
        F.when(short, "insufficient_history")
        .when(flat, F.when(F.col("_latest") != F.col("_mean"), "zero_variance_baseline").otherwise("no_variance"))
        .when(z > 1.5, "above_historical_mean")
        .when(z < -1.5, "below_historical_mean")
        .otherwise("within_normal_range")
        .alias("context"),
        F.when(~short, F.col("latest_period")).alias("latest_period"),
    )


def last_periods(df: DataFrame, n: int) -> DataFrame:
    """Rows of the newest n distinct quarters (found from the distinct quarters, not by a global window)."""
    newest = df.select("quarter").distinct().orderBy(F.desc(clean.quarter_index(F.col("quarter")))).limit(n)
    return df.join(F.broadcast(newest), "quarter", "left_semi")


def trends(windows: DataFrame, runs: DataFrame, current: DataFrame, baselines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Recent and seasonal change, baseline gap, persistence and direction per (target, signal).

    ``windows`` carries the four window counts, ``runs`` consecutive_above, ``current`` value and
    ``baselines`` (signal, p25, p50, p75).
    """
    joined = (
        current.join(windows, list(keys), "left").join(runs, list(keys), "left").join(baselines, "signal", "left")
    )
    recent = S.pct_change(F.col("last_30d"), F.col("prev_30d"), S.RECENT_BAND)
    seasonal = S.pct_change(F.col("last_90d"), F.col("same_90d_last_year"), S.SEASONAL_BAND)
    gap = S.baseline_gap(F.col("value"), F.col("p25"), F.col("p50"), F.col("p75"))
    run = F.coalesce(F.col("consecutive_above"), F.lit(0))
    return joined.select(
        *keys,
        "value",
        "p75",
        recent["change_pct"].alias("recent"),
        recent["label"].alias("recent_label"),
        seasonal["change_pct"].alias("seasonal"),
        seasonal["label"].alias("seasonal_label"),
        gap["gap_pct"].alias("gap"),
        gap["percentile_label"].alias("gap_label"),
        run.alias("persistence"),
        S.direction(recent["change_pct"], seasonal["change_pct"], gap["gap_pct"], run).alias("direction"),
    )


MIN_OBSERVATIONS = 4
RHO_THRESHOLD = 0.6
FAMILY_ALPHA = 0.01


def patterns(series: DataFrame, directions: DataFrame, target: str = "target_id") -> DataFrame:
    """Signal pairs of one target that move together and are both worsening or elevated.

    ``series`` is (target, signal, quarter, value), at most a few signals and quarters per target.
    Spearman over common quarters, Bonferroni over the pairs of the target.
    """
    from placescore.plans import stats

    usable = series.where(F.col("value").isNotNull()).groupBy(target, "signal").agg(F.count(F.lit(1)).alias("_n"))
    usable = usable.where(F.col("_n") >= MIN_OBSERVATIONS)
    n_signals = usable.groupBy(target).agg(F.count(F.lit(1)).alias("_k"))
    rows = series.join(usable.select(target, "signal"), [target, "signal"])
    rho = stats.spearman_series(rows, [target], "signal", "quarter", "value")
    pairs = F.col("_k") * (F.col("_k") - 1) / 2
    tested = rho.join(n_signals, target).where(
        (F.col("n") >= MIN_OBSERVATIONS) & (F.abs("rho") > RHO_THRESHOLD)
    )
    with_p = stats.with_p_value(tested).where(F.col("p_value") < F.lit(FAMILY_ALPHA) / pairs)
    stressed = directions.where(F.col("direction").isin("worsening", "elevated")).select(target, "signal", "direction")
    a = stressed.select(target, F.col("signal").alias("signal_a"), F.col("direction").alias("direction_a"))
    b = stressed.select(target, F.col("signal").alias("signal_b"), F.col("direction").alias("direction_b"))
    found = with_p.join(a, [target, "signal_a"]).join(b, [target, "signal_b"])
    size = F.abs("rho")
    kind = F.when(F.col("direction_a") == F.col("direction_b"), "co-stressed").otherwise("diverging stress")
    return found.select(
        target,
        F.concat(F.lit("pattern_"), "signal_a", F.lit("_"), "signal_b").alias("pattern_id"),
        "signal_a",
        "signal_b",
        F.round("rho", 4).alias("rho"),
        "p_value",
        "n",
        F.when(size >= 0.85, "high").when(size >= 0.7, "medium").otherwise("low").alias("severity"),
        F.concat(
            "signal_a", F.lit(" and "), "signal_b", F.lit(" are "), kind, F.lit(" (rho="), F.format_string("%+.2f", F.col("rho")), F.lit(")")
        ).alias("title"),
    )


def with_history(trend_rows: DataFrame, series: DataFrame, keys: Sequence[str], quarters: int = 4) -> DataFrame:
    """Trend rows with their newest quarters (oldest first) and the anomaly of the latest complete one."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("_qi"))
    numbered = series.where(F.col("value").isNotNull()).withColumn("_qi", clean.quarter_index(F.col("quarter")))
    kept = numbered.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= quarters)
    chain = kept.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_qi", "quarter", "value"))).alias("quarters"))
    odd = anomaly(series, keys).select(*keys, "is_anomaly", "z_score", "context")
    return trend_rows.join(chain, list(keys), "left").join(odd, list(keys), "left")


def trend_sentence(t: DataFrame) -> Column:
    """What a trend row says, its parts divided by semicolons; parts without figures are left out.

    Windows, season, gap and run come from the row; quarters and anomaly are told where :func:`with_history` added them.
    """

    def sign(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.format_string("%+.1f %%", F.col(c) + 0.0))  # no sign on a zero

    def told(test: Column, *pieces: Column | str) -> Column:
        return F.when(test, F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in pieces]))

    def versus(now: str, then: str, change: str, days: str, before: str) -> Column:
        both = F.col(now).isNotNull() & F.col(then).isNotNull()
        moved = F.coalesce(F.concat(F.lit(" ("), sign(change), F.lit(")")), F.lit(""))
        return told(both, days, F.col(now), before, F.col(then), moved)

    parts = [
        versus("last_30d", "prev_30d", "recent", "30 d: ", " after "),
        versus("last_90d", "same_90d_last_year", "seasonal", "90 d: ", ", a year before "),
        told(F.col("gap").isNotNull(), "to baseline ", sign("gap"), F.coalesce(F.concat(F.lit(", "), "gap_label"), F.lit(""))),
        told(F.col("persistence") > 0, "high for ", F.col("persistence"), " quarters"),
    ]
    if "quarters" in t.columns:
        chain = F.transform("quarters", lambda q: F.concat_ws("=", q["quarter"], q["value"].cast("string")))
        parts.insert(2, told(F.size("quarters") > 0, F.array_join(chain, " ")))
    if "is_anomaly" in t.columns:
        z = F.when(F.col("z_score").isNotNull(), F.format_string(" by z %+.2f", F.col("z_score") + 0.0)).otherwise("")
        parts.append(told(F.col("is_anomaly"), "unusual", z, " [", F.col("context"), "]"))
    return F.concat_ws(" ", F.concat("signal", F.lit(":")), F.coalesce(F.nullif(F.concat_ws("; ", *parts), F.lit("")), F.lit("no figures")))


def evidence(query_rows: DataFrame, trend_rows: DataFrame, pattern_rows: DataFrame | None = None, target: str = "target_id") -> DataFrame:
    """One evidence table; on a repeated (target, evidence_id) the last source wins."""
    from placescore.operators.tables import concat_last_wins

    parts = [query_rows, trend_rows.select(target, F.concat(F.lit("trend_"), "signal").alias("evidence_id"), "summary")]
    if pattern_rows is not None:
        parts.append(pattern_rows.select(target, F.col("pattern_id").alias("evidence_id"), F.col("title").alias("summary")))
    keyed = [p.select(F.struct(target, "evidence_id").alias("_key"), "summary") for p in parts]
    merged = concat_last_wins(keyed, "_key", ["summary"])
    return merged.select(f"_key.{target}", "_key.evidence_id", "summary")


def verify(actions: DataFrame, evidence_rows: DataFrame, target: str = "target_id") -> DataFrame:
    """Actions whose evidence ids all exist for their target."""
    wanted = actions.select(target, "signal", F.explode("evidence_ids").alias("evidence_id"))
    lost = wanted.join(evidence_rows.select(target, "evidence_id"), [target, "evidence_id"], "left_anti")
    return actions.join(lost.select(target, "signal").distinct(), [target, "signal"], "left_anti")


def why_now(trend_rows: DataFrame, keep: int = 5, target: str = "target_id") -> DataFrame:
    """Up to ``keep`` stressed signals per target, in signal order."""
    stressed = trend_rows.where(F.col("direction").isin("worsening", "elevated"))
    w = Window.partitionBy(target).orderBy("signal")
    return (
        stressed.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= keep)
        .select(target, F.concat("signal", F.lit(" is "), "direction").alias("reason"), "rank")
    )
