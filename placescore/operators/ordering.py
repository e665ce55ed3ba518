"""Global ranks, row numbers and exact quantiles without a single-task window.

A plain ``rank() over (order by v)`` sends the whole table to one task. Here the values are first collapsed to one row per
distinct value (ties, however hot, become a count), then cut at split points taken from those very values, so that narrow
and wide ranges are cut alike. Only the bucket totals meet in one task; one for some VALUES_PER_BUCKET distinct
values. Values keep their own type; NaN is larger than any number, infinities are ordinary values. Group keys may be NULL.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placescore.session import cut_lineage

#: Distinct values one task takes without any cut, those that a bucket is meant to hold at most, and the split points of a level.
VALUES_UNCUT, VALUES_PER_BUCKET, SPLITS = 20_000, 100_000, 127


def with_bucket(counts: DataFrame, value: str, out: str) -> DataFrame:
    """Add an order-preserving bucket: how many split points are at or below the value.

    ``counts`` has a row per distinct value; it is written once and everything below reads that. Buckets follow the number of
    values. Beyond SPLITS + 1 of them there are two levels: coarse buckets, and split points inside each, looked up
    by an equi-join on the coarse bucket. Split points lie near the quantiles; any choice of them keeps the order.
    """
    written = cut_lineage(counts)
    values = written.count()
    if values <= VALUES_UNCUT:
        return written.withColumn(out, F.lit(0))
    buckets = max(SPLITS + 1, -(-values // VALUES_PER_BUCKET))
    coarse = buckets if buckets == SPLITS + 1 else max(SPLITS + 1, math.isqrt(buckets - 1) + 1)
    placed = _below(written.join(F.broadcast(written.agg(_split_points(value, coarse))), F.lit(True)), value, out)  # one row
    if coarse == buckets:
        return placed
    fine = -(-buckets // coarse)
    inner = placed.groupBy(F.col(out).alias("_coarse")).agg(_split_points(value, fine))
    again = _below(placed.withColumnRenamed(out, "_coarse").join(inner, "_coarse"), value, "_fine")
    return again.withColumn(out, F.col("_coarse") * fine + F.col("_fine")).drop("_coarse", "_fine")


def _split_points(value: str, buckets: int) -> Column:
    return F.percentile_approx(value, [(i + 1) / buckets for i in range(buckets - 1)], max(1_000, 8 * buckets)).alias("_splits")


def _below(df: DataFrame, value: str, out: str) -> DataFrame:
    return df.withColumn(out, F.size(F.filter("_splits", lambda s: s <= F.col(value)))).drop("_splits")


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where NULL equals NULL; the keys of ``left`` stay."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    test = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(other, test, how).drop(*[f"_right_{k}" for k in keys])


def _before(window) -> object:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def value_positions(df: DataFrame, value: str, by: Sequence[str] = (), prefix: str = "") -> DataFrame:
    """One row per (by, distinct value): ``n`` rows hold it, ``below`` rows are smaller, ``total`` in all.

    NULL values take no part. ``prefix`` goes before the three names.
    """
    keys = list(by)
    counts = with_bucket(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_rows")), value, "_bucket")
    totals = counts.groupBy(*keys, "_bucket").agg(F.sum("_rows").alias("_sum"))
    over = Window.partitionBy(*keys)
    offsets = totals.select(
        *keys,
        "_bucket",
        F.coalesce(F.sum("_sum").over(_before(over.orderBy("_bucket"))), F.lit(0)).alias("_offset"),
        F.sum("_sum").over(over).alias("_total"),
    )
    inside = _before(Window.partitionBy(*keys, "_bucket").orderBy(value))
    return join_null_safe(counts, offsets, [*keys, "_bucket"]).select(
        *keys,
        value,
        F.col("_rows").alias(f"{prefix}n"),
        (F.col("_offset") + F.coalesce(F.sum("_rows").over(inside), F.lit(0))).alias(f"{prefix}below"),
        F.col("_total").alias(f"{prefix}total"),
    )


def with_positions(df: DataFrame, value: str, by: Sequence[str] = (), prefix: str = "") -> DataFrame:
    """Attach n / below / total of the row's value; rows with a NULL value get NULLs.

    The joined side has one row per distinct value, so a hot value is skewed on the left only and
    the adaptive skew join can split it.
    """
    return join_null_safe(df, value_positions(df, value, by, prefix), [*by, value], "left")


def average_rank(prefix: str = "") -> Column:
    """1-based rank, ties averaged."""
    return F.col(f"{prefix}below") + (F.col(f"{prefix}n") + F.lit(1)) / F.lit(2.0)


def global_row_number(
    df: DataFrame,
    value: str,
    tie: str,
    out: str = "rank",
    descending: bool = True,
    by: Sequence[str] = (),
    tie_bucket: Column | None = None,
) -> DataFrame:
    """Dense 1..N numbering ordered by value then tie (NULL last) then row hash; NULL values stay unnumbered.

    A hot value is split again by an order-preserving bucket of the tie column.
    """
    keys = list(by)
    tied = tie_bucket if tie_bucket is not None else F.shiftright(F.col(tie), 20)
    rows = df.withColumn("_v", F.col(value)).withColumn("_t", tied)
    known = rows.where(F.col("_v").isNotNull())
    counts = with_bucket(known.groupBy(*keys, "_v", "_t").agg(F.count(F.lit(1)).alias("_n")), "_v", "_b")
    towards = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    over = Window.partitionBy(*keys).orderBy(towards("_b"))
    outer = (
        counts.groupBy(*keys, "_b")
        .agg(F.sum("_n").alias("_bn"))
        .select(*keys, "_b", F.coalesce(F.sum("_bn").over(_before(over)), F.lit(0)).alias("_o1"))
    )
    inside = _before(Window.partitionBy(*keys, "_b").orderBy(towards("_v"), F.col("_t").asc_nulls_last()))
    start = join_null_safe(counts, outer, [*keys, "_b"]).select(
        *keys,
        "_v",
        "_t",
        (F.col("_o1") + F.coalesce(F.sum("_n").over(inside), F.lit(0))).alias("_start"),
    )
    last = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    numbered = Window.partitionBy(*keys, "_v", "_t").orderBy(F.col(tie).asc_nulls_last(), last)
    ranked = join_null_safe(known, start, [*keys, "_v", "_t"]).withColumn(
        out, (F.col("_start") + F.row_number().over(numbered)).cast("bigint")
    )
    missing = rows.where(F.col("_v").isNull()).withColumn(out, F.lit(None).cast("bigint"))
    return ranked.select(*df.columns, out).unionByName(missing.select(*df.columns, out))


def exact_quantiles(
    df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = (), out: str = "quantiles"
) -> DataFrame:
    """Linear-interpolation quantiles per group as one array column.

    Only two order statistics per share leave the tasks, so no task ever holds a group.
    """
    keys = list(by)
    positions = value_positions(df, value, keys, "_q_")
    picks = []
    for i, share in enumerate(shares):
        at = F.lit(float(share)) * (F.col("_q_total") - 1)
        for name, index in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (F.col("_q_below") <= index) & (index < F.col("_q_below") + F.col("_q_n"))
            picks.append(F.max(F.when(here, F.col(value).cast("double"))).alias(f"_{name}{i}"))
    summary = positions.groupBy(*keys).agg(F.max("_q_total").alias("_total"), *picks)
    values = []
    for i, share in enumerate(shares):
        at = F.lit(float(share)) * (F.col("_total") - 1)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        values.append(lo + (hi - lo) * (at - F.floor(at)))
    return summary.select(*keys, F.array(*values).alias(out), F.col("_total").alias("n_values"))
