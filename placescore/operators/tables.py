"""Projections, equi-joins, set operations and grouped measures on plain tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placescore.functions import clean
from placescore.functions.score import clamp_score
from placescore.operators import ordering


# ---- projections and filters -------------------------------------------------------------------


def project(df: DataFrame, columns: Sequence[str], rename: Mapping[str, str] | None = None) -> DataFrame:
    """Select and rename in one projection; a new name must not collide."""
    names = [(rename or {}).get(c, c) for c in columns]
    if len(set(names)) != len(names):
        raise ValueError("rename target already exists")
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(columns, names, strict=True)])


def project_or_null(
    df: DataFrame, columns: Mapping[str, str], aliases: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Requested name, else the first alias present, else a typed NULL; ``columns`` maps name to type."""
    out = []
    for name, kind in columns.items():
        found = next((c for c in [name, *(aliases or {}).get(name, [])] if c in df.columns), None)
        source = F.lit(None) if found is None else F.col(f"`{found}`")
        out.append(source.cast(kind).alias(name))
    return df.select(*out)


def clip_box(df: DataFrame, lat: str, lon: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Numeric coordinates inside an inclusive box; the rest is dropped."""
    typed = df.withColumns({lat: F.col(lat).try_cast("double"), lon: F.col(lon).try_cast("double")})
    return typed.where(F.col(lat).between(box[0], box[1]) & F.col(lon).between(box[2], box[3]))


def where_in(df: DataFrame, column: str, values: Sequence | DataFrame) -> DataFrame:
    """Literal list or a table of values."""
    if isinstance(values, DataFrame):
        return df.join(values.select(column).distinct(), column, "left_semi")
    return df.where(F.col(column).isin(list(values)))


def anchored_window(df: DataFrame, date: str, years: int, as_of: Column) -> DataFrame:
    """Rows from ``years`` before the latest date not after as_of, up to that date."""
    day = F.to_date(F.col(date))
    last = df.where(day <= as_of).agg(F.max(day).alias("_last"))
    since = F.add_months(F.col("_last"), -12 * years)
    return df.join(F.broadcast(last), (day >= since) & (day <= F.col("_last")), "inner").drop("_last")


# ---- joins and sets ----------------------------------------------------------------------------


def left_fill(a: DataFrame, b: DataFrame, key: str | Sequence[str], value: object = 0) -> DataFrame:
    """Left join; what the right side lacks becomes ``value``."""
    keys = [key] if isinstance(key, str) else list(key)
    filled = [c for c in b.columns if c not in keys]
    joined = a.join(b, keys, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c in filled})


def outer_all(tables: Mapping[str, DataFrame], key: str, value: str) -> DataFrame:
    """Full outer join of many (key, value) tables with one shuffle: union, then one pivot."""
    parts = [t.select(key, F.lit(name).alias("_m"), F.col(value).alias("_v")) for name, t in tables.items()]
    union = reduce(DataFrame.unionByName, parts)
    return union.groupBy(key).agg(
        *[F.max(F.when(F.col("_m") == name, F.col("_v"))).alias(name) for name in tables]
    )


def keep_in(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key), key, "left_semi")


def drop_in(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key), key, "left_anti")


def concat_last_wins(parts: Sequence[DataFrame], key: str, order: Sequence[str] = ()) -> DataFrame:
    """Union all; the last part holding a key wins, inside a part the greatest ``order``.

    max_by merges map-side, so a key repeated in a third of the rows does not meet in one task.
    """
    stamped = [p.withColumn("_seq", F.lit(i)) for i, p in enumerate(parts)]
    rows = reduce(DataFrame.unionByName, stamped)
    rest = [c for c in rows.columns if c not in (key, "_seq")]
    picked = rows.groupBy(key).agg(
        F.max_by(F.struct(*rest), F.struct("_seq", *order)).alias("_row")
    )
    return picked.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def set_difference(a: DataFrame, b: DataFrame, key: str, allowed: Sequence = ()) -> DataFrame:
    """Keys of a that b lacks, apart from the allowed ones."""
    left = a.select(key).distinct().join(b.select(key), key, "left_anti")
    return left.where(~F.col(key).isin(list(allowed))) if allowed else left


def set_intersection(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Keys present in every table, one shuffle."""
    parts = [t.select(key, F.lit(i).alias("_t")) for i, t in enumerate(tables)]
    seen = reduce(DataFrame.unionByName, parts).groupBy(key).agg(
        *[F.max(F.col("_t") == i).alias(f"_in{i}") for i in range(len(tables))]
    )
    every = reduce(lambda x, y: x & y, [F.col(f"_in{i}") for i in range(len(tables))])
    return seen.where(every).select(key)


def frame_union(tables: Mapping[str, DataFrame], weights: Mapping[str, float], key: str = "cell") -> DataFrame:
    """Distinct keys of the positively weighted tables; context tables cannot widen the frame."""
    used = [t.select(key) for name, t in tables.items() if weights.get(name, 0.0) > 0]
    return reduce(DataFrame.unionByName, used).distinct()


def compare(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """b minus a per category for (a_id, b_id) pairs; a missing side drops the row."""
    a = scores.select(F.col("target_id").alias("a_id"), "category", F.col("score").alias("score_a"))
    b = scores.select(F.col("target_id").alias("b_id"), "category", F.col("score").alias("score_b"))
    return (
        pairs.join(a, "a_id")
        .join(b, ["b_id", "category"])
        .where(F.col("score_a").isNotNull() & F.col("score_b").isNotNull())
        .withColumn("delta", F.round((F.col("score_b") - F.col("score_a")).cast("double"), 2))
    )


def freshness(catalog: DataFrame, local: DataFrame) -> DataFrame:
    """Local snapshots (id, local_at) against catalogue rows (id, updated_at)."""
    lag = (F.unix_timestamp("updated_at") - F.unix_timestamp("local_at")) / 86400.0
    known = F.col("updated_at").isNotNull()
    return local.join(catalog.select("id", "updated_at"), "id", "left").select(
        "id",
        F.when(~known, "missing_upstream").when(lag > 0, "stale").otherwise("fresh").alias("status"),
        F.when(known, F.round(F.greatest(lag, F.lit(0.0)), 1)).alias("stale_days"),
    )


# ---- grouped measures --------------------------------------------------------------------------


def count_by(df: DataFrame, key: str, out: str = "raw_count") -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(out))


def measures_by(
    df: DataFrame, key: str, entity: str | None = None, condition: Column | None = None
) -> DataFrame:
    """Counts per key in one aggregation: rows, distinct entities, conditional rows and their rate.

    With an entity ``raw_count`` counts entities and ``inspection_count`` rows, otherwise ``raw_count``
    counts rows. The rate is over rows, never below one.
    """
    rows = F.count(F.lit(1))
    if entity:
        aggs = [F.count_distinct(entity).alias("raw_count"), rows.alias("inspection_count")]
    else:
        aggs = [rows.alias("raw_count")]
    if condition is not None:
        aggs.append(F.count_if(F.coalesce(condition, F.lit(False))).alias("critical_count"))
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs)
    if condition is not None:
        base = F.col("inspection_count" if entity else "raw_count")
        rate = F.col("critical_count") / F.greatest(base, F.lit(1))
        out = out.withColumn("critical_rate", F.bround(rate, 3))
    return out


def mean_by(df: DataFrame, key: str, value: str, positive_only: bool = False) -> DataFrame:
    ok = F.col(key).isNotNull() & F.col(value).isNotNull()
    if positive_only:
        ok = ok & (F.col(value) > 0)
    return df.where(ok).groupBy(key).agg(
        F.avg(F.col(value).cast("double")).alias("avg_value"), F.count(F.lit(1)).alias("incident_count")
    )


def sum_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """NULL values count as zero but the record still counts."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.sum(F.coalesce(F.col(value).cast("double"), F.lit(0.0))).alias("total_value"),
        F.count(F.lit(1)).alias("record_count"),
    )


def quarterly(df: DataFrame, key: str, date: str, as_of: Column | None = None) -> DataFrame:
    """Counts per (key, quarter); dates outside 2000-01-01 .. as_of fall away."""
    label = clean.quarter_label(F.col(date), as_of)
    rows = df.withColumn("quarter", label).where(F.col(key).isNotNull() & F.col("quarter").isNotNull())
    return rows.groupBy(key, "quarter").agg(F.count(F.lit(1)).alias("count"))


def top_values(df: DataFrame, key: str, value: str, n: int, blank: str | None = None) -> DataFrame:
    """n most frequent values per key, ties by value; blanks are dropped or renamed."""
    text = F.trim(F.col(value))
    named = F.when(text != "", text)
    rows = df.withColumn(value, F.coalesce(named, F.lit(blank)) if blank else named).where(
        F.col(value).isNotNull()
    )
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), F.asc(value))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def grade_summary(df: DataFrame, key: str, grade: str, name: str, keep: int = 4) -> DataFrame:
    """Counts of grades A/B/C, the graded total and the first names graded A (smallest first).

    The names are limited by a partial top-k: per (key, name) one row, then the keep smallest.
    """
    g = F.upper(F.trim(F.coalesce(F.col(grade), F.lit(""))))
    tallies = df.groupBy(key).agg(
        *[F.count_if(g == x).alias(f"grade_{x.lower()}") for x in "ABC"],
        F.count_if(g.isin("A", "B", "C")).alias("graded"),
    )
    best = (
        df.where(g == "A")
        .select(key, name)
        .distinct()
        .withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(name)))
        .where(F.col("_r") <= keep)
        .groupBy(key)
        .agg(F.array_join(F.array_sort(F.collect_list(name)), "|").alias("a_names"))
    )
    return tallies.join(best, key, "left")


def time_buckets(df: DataFrame, key: str, hhmm: Column) -> DataFrame:
    """Rows per part of the day from 'HH:MM' text; bad text is ignored."""
    hour = F.split(hhmm, ":")[0].try_cast("int")
    return df.groupBy(key).agg(
        F.count_if(hour.between(6, 11)).alias("morning"),
        F.count_if(hour.between(12, 17)).alias("afternoon"),
        F.count_if(hour.between(18, 23)).alias("evening"),
        F.count_if(hour.between(0, 5)).alias("night"),
    )


def age_summary(df: DataFrame, key: str, date: str, as_of: Column) -> DataFrame:
    age = F.datediff(as_of, F.col(date))
    return df.groupBy(key).agg(
        F.bround(F.avg(age), 0).cast("int").alias("mean_age"),
        F.max(age).alias("max_age"),
        F.count_if(age > 365).alias("over_1y"),
        F.count_if(age > 730).alias("over_2y"),
    )


WINDOWS = {"last_30d": (0, 30), "prev_30d": (30, 60), "last_90d": (0, 90), "same_90d_last_year": (365, 455)}


def window_counts(
    df: DataFrame, keys: Sequence[str], date: str, as_of: Column, total: str | None = None
) -> DataFrame:
    """Rows by age window (start, end] in days; age zero is in none. ``total`` adds the count of all rows."""
    age = F.datediff(as_of, F.col(date))
    every = [F.count(F.lit(1)).alias(total)] if total else []
    return df.groupBy(*keys).agg(
        *every, *[F.count_if((age > lo) & (age <= hi)).alias(name) for name, (lo, hi) in WINDOWS.items()]
    )


def histogram(df: DataFrame, column: str, mode: str = "floor") -> DataFrame:
    """Twenty five-point bins, empty ones included; mode 'round' centres bins on multiples of five."""
    fifth = F.col(column).cast("double") / 5
    at = F.floor(fifth) if mode == "floor" else F.bround(fifth, 0)
    bins = (
        df.where(F.col(column).isNotNull())
        .groupBy(F.least(F.lit(19), F.greatest(F.lit(0), at.cast("int"))).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    every = df.sparkSession.range(20).select(F.col("id").cast("int").alias("bin"))
    return every.join(bins, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def table_stats(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(c).alias("non_null"),
        F.count_distinct(c).alias("n_distinct"),
        F.min(c).alias("min_value"),
        F.max(c).alias("max_value"),
        F.round(F.avg(c), 1).alias("mean_value"),
    )


def baselines(tables: Mapping[str, DataFrame]) -> DataFrame:
    """p25 / p50 / p75 per table of its first present measure."""
    measures = ["raw_count", "avg_response_seconds", "total_value", "score"]
    parts = []
    for name, table in tables.items():
        measure = next((m for m in measures if m in table.columns), None)
        if measure is not None:
            parts.append(
                table.select(
                    F.lit(name).alias("table"), F.lit(measure).alias("metric"), F.col(measure).cast("double").alias("v")
                )
            )
    rows = reduce(DataFrame.unionByName, parts)
    q = ordering.exact_quantiles(rows, "v", [0.25, 0.5, 0.75], by=["table", "metric"])
    return q.select(
        "table", "metric", *[F.round(F.col("quantiles")[i], 2).alias(p) for i, p in enumerate(("p25", "p50", "p75"))]
    )


def score_domain(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rounded p02 / p50 / p98 per score column, widened when too narrow."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns
    ])).alias("_s")).select("_s.column", "_s.v")
    q = ordering.exact_quantiles(long, "v", [0.02, 0.5, 0.98], by=["column"])
    lo, mid, hi = (F.bround(F.col("quantiles")[i], 0) for i in range(3))
    narrow = (hi - lo) < 4
    low = F.when(narrow, F.greatest(F.lit(0.0), lo - 2)).otherwise(lo)
    high = F.when(narrow, F.least(F.lit(100.0), hi + 2)).otherwise(hi)
    middle = F.when((mid > low) & (mid < high), mid).otherwise((low + high) / 2)
    return q.select("column", low.alias("low"), middle.alias("mid"), high.alias("high"))


def weighted_present(long: DataFrame, key: Sequence[str], registry: DataFrame) -> DataFrame:
    """Weighted mean over the members present, with the evidence coverage beside it.

    ``long`` has (key…, metric, value), ``registry`` (metric, category, weight). Totals come from the
    registry, so a table that was never published still counts as missing.
    """
    totals = registry.where(F.col("weight") > 0).groupBy("category").agg(
        F.count(F.lit(1)).alias("total"), F.sum("weight").alias("weight_total")
    )
    present = long.where(F.col("value").isNotNull()).join(
        F.broadcast(registry.where(F.col("weight") > 0)), "metric"
    )
    sums = present.groupBy(*key, "category").agg(
        (F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("score"),
        F.count(F.lit(1)).alias("available"),
        F.sum("weight").alias("_w"),
    )
    return sums.join(F.broadcast(totals), "category").select(
        *key,
        "category",
        "score",
        "available",
        "total",
        F.round(F.col("available") / F.col("total"), 4).alias("fraction"),
        F.round(F.col("_w") / F.col("weight_total"), 4).alias("weight_ratio"),
    )


def percentile_score(
    df: DataFrame, value: str, higher_is_better: bool | Column = True, out: str = "score", by: Sequence[str] = ()
) -> DataFrame:
    """0..100 percentile score of a column; NULL counts as zero, ties share their average rank.

    The direction may be a column, so metrics of both kinds are ranked in one job.
    """
    from placescore.functions.score import percentile_from_positions

    rows = df.withColumn("_pv", F.coalesce(F.col(value).cast("double"), F.lit(0.0)))
    placed = ordering.with_positions(rows, "_pv", by, prefix="_p_")
    if isinstance(higher_is_better, Column):
        up, down = (percentile_from_positions(x, "_p_") for x in (True, False))
        scored = F.when(higher_is_better, up).otherwise(down)
    else:
        scored = percentile_from_positions(higher_is_better, "_p_")
    return placed.withColumn(out, scored).select(*df.columns, out)


def blend(a: Column, b: Column) -> Column:
    return clamp_score((a + b) / 2.0)


def normalise(
    df: DataFrame, value: str, method: str, higher_is_better: bool = True, by: Sequence[str] = (), out: str = "score"
) -> DataFrame:
    """min-max or z-score normalisation to 0..100; a constant column scores 50."""
    v = F.col(value).cast("double")
    stats = df.groupBy(*by).agg(
        F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.avg(v).alias("_mean"), F.stddev_pop(v).alias("_sd")
    )
    joined = df.join(stats, list(by)) if by else df.join(F.broadcast(stats), F.lit(True))
    if method == "minmax":
        raw = F.when(F.col("_hi") == F.col("_lo"), 50.0).otherwise(
            (v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 100
        )
    else:
        raw = F.when(F.col("_hi") == F.col("_lo"), 50.0).otherwise(
            F.least(F.lit(100.0), F.greatest(F.lit(0.0), 50 + 10 * (v - F.col("_mean")) / F.col("_sd")))
        )
    oriented = raw if higher_is_better else 100 - raw
    return joined.withColumn(out, F.when(v.isNotNull(), oriented)).select(*df.columns, out)


def shrink(df: DataFrame, k: str, n: str, out: str = "rate") -> DataFrame:
    """Empirical-Bayes rate per row: beta prior by weighted moments over all rows."""
    ok = df.where(F.col(n) > 0)
    rate = F.col(k) / F.col(n)
    mean = F.sum(F.col(k).cast("double")) / F.sum(F.col(n).cast("double"))
    first = ok.agg(
        mean.alias("_mean"),
        (F.sum(F.col(n) * rate * rate) / F.sum(F.col(n).cast("double"))).alias("_sq"),
    )
    prior = prior_columns(F.col("_mean"), F.col("_sq") - F.col("_mean") * F.col("_mean"))
    scalars = first.select(prior[0].alias("alpha"), prior[1].alias("beta"))
    return df.join(F.broadcast(scalars), F.lit(True)).withColumn(
        out, (F.col(k) + F.col("alpha")) / (F.col(n) + F.col("alpha") + F.col("beta"))
    )


def prior_columns(mean: Column, var: Column) -> tuple[Column, Column]:
    flat = (var <= 0) | (mean <= 0) | (mean >= 1)
    common = F.greatest(mean * (1 - mean) / var - 1, F.lit(1.0))
    alpha = F.when(flat, 1.0).otherwise(mean * common)
    beta = F.when(flat, F.greatest(1 / F.greatest(mean, F.lit(1e-6)) - 1, F.lit(1.0))).otherwise(
        (1 - mean) * common
    )
    return alpha, beta


def exposure_rate(
    events: DataFrame, exposure: DataFrame, key: str, killed: Column, injured: Column
) -> tuple[DataFrame, DataFrame]:
    """Severity-weighted sum (3 x killed + injured) over exposure floored at 0.05; and what had none."""
    weight = F.sum(3 * F.coalesce(killed, F.lit(0)) + F.coalesce(injured, F.lit(0)))
    sums = events.where(F.col(key).isNotNull()).groupBy(key).agg(
        weight.alias("severity"), F.count(F.lit(1)).alias("raw_count")
    )
    rated = sums.join(exposure.select(key, "exposure"), key).withColumn(
        "rate", F.col("severity") / F.greatest(F.col("exposure"), F.lit(0.05))
    )
    lost = sums.join(exposure, key, "left_anti").agg(
        F.count(F.lit(1)).alias("dropped_cells"), F.coalesce(F.sum("severity"), F.lit(0)).alias("dropped_severity")
    )
    return rated, lost


def drop_duplicates(df: DataFrame, subset: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row per subset under an explicit order, merged map-side."""
    rest = [c for c in df.columns if c not in subset]
    if not rest:
        return df.distinct()
    kept = df.groupBy(*subset).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return kept.select(*[F.col(c) if c in subset else F.col(f"_row.{c}").alias(c) for c in df.columns])


def cap_per_target(df: DataFrame, key: str, n: int, order: Sequence[Column]) -> DataFrame:
    """First n rows per target under a stated order (WindowGroupLimit prunes before the shuffle)."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def duplicated_sources(metrics: DataFrame) -> DataFrame:
    """Sources feeding more than one metric."""
    return metrics.groupBy("source").agg(F.count(F.lit(1)).alias("n_metrics")).where(F.col("n_metrics") > 1)
