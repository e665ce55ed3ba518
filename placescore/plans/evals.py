"""Grading of recorded runs: tool order, required and forbidden sets, number and place grounding."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from placescore.functions import text
from placescore.session import cut_lineage

ROUND_TOLERANCE = 0.5
DERIVE_RELATIVE, DERIVE_ABSOLUTE = 0.0005, 0.005


def grade(cases: DataFrame, responses: DataFrame) -> DataFrame:
    """One graded row per case; a missing response is graded as an empty one.

    ``cases``: case_id, intent, all_tools, ordered_tools, forbidden_tools, evidence_required,
    answer_terms_any. ``responses``: case_id, answer, tools_called, evidence (count), latency_ms. A NULL
    or empty expectation is not checked, except that an empty ``all_tools`` forbids any tool.
    """
    empty = F.array().cast("array<string>")
    j = cases.join(responses, "case_id", "left").withColumns(
        {
            "answer": F.trim(F.coalesce("answer", F.lit(""))),
            "tools_called": F.coalesce("tools_called", empty),
            "evidence": F.coalesce("evidence", F.lit(0)),
        }
    )
    given = lambda c: F.coalesce(F.size(c), F.lit(-1)) > 0
    lowered = F.lower("answer")
    checks = {
        "answer_present": F.col("answer") != "",
        "required_tools": F.when(F.col("all_tools").isNotNull(), text.contains_all(F.col("tools_called"), F.col("all_tools"))),
        "no_tools": F.when(F.size("all_tools") == 0, F.size("tools_called") == 0),
        "ordered_tools": F.when(given("ordered_tools"), text.is_subsequence(F.col("ordered_tools"), F.col("tools_called"))),
        "forbidden_tools": F.when(given("forbidden_tools"), ~F.arrays_overlap("forbidden_tools", "tools_called")),
        "evidence_present": F.when(F.col("evidence_required"), F.col("evidence") > 0),
        "answer_terms_any": F.when(
            given("answer_terms_any"), F.exists("answer_terms_any", lambda t: F.contains(lowered, F.lower(t)))
        ),
    }
    failed = F.filter(
        F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in checks.items()]),
        lambda x: x.isNotNull(),
    )
    return j.withColumn("failures", failed).withColumn("passed", F.size("failures") == 0)


def summary(graded: DataFrame, by: Sequence[str] = ("intent",)) -> DataFrame:
    """Passed, total, pass rate and latency quantiles per group."""
    from placescore.operators import ordering

    base = graded.groupBy(*by).agg(
        F.count_if("passed").alias("passed"),
        F.count(F.lit(1)).alias("total"),
        F.round(F.count_if("passed") / F.count(F.lit(1)), 4).alias("pass_rate"),
    )
    if "latency_ms" not in graded.columns:
        return base
    q = ordering.exact_quantiles(graded, "latency_ms", [0.5, 0.95], by=by)
    return base.join(
        q.select(*by, F.round(F.col("quantiles")[0], 2).alias("p50_ms"), F.round(F.col("quantiles")[1], 2).alias("p95_ms")),
        list(by),
        "left",
    )


def pass_power(attempts: DataFrame, key: str = "case_id") -> DataFrame:
    """pass^k: every attempt of a case passed; failures are united."""
    return attempts.groupBy(key).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.bool_and("passed").alias("all_passed"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("failures")))), ",").alias("failures"),
    )


# ---- grounding of numbers ------------------------------------------------------------------------

#: Values, and claims, of one group that one task holds at once.
VALUES_PER_PART, CLAIMS_PER_PART = 20_000, 5_000
#: Partners looked up at once.
LOOKUPS = 1_000_000


def _near(v: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.abs(v - other) <= np.maximum(DERIVE_ABSOLUTE, DERIVE_RELATIVE * np.maximum(np.abs(v), np.abs(other)))


def _near_range(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Between what bounds the values near ``v`` lie."""
    m = np.abs(v)
    inner, outer = np.minimum(m - DERIVE_ABSOLUTE, m * (1 - DERIVE_RELATIVE)), np.maximum(m + DERIVE_ABSOLUTE, m / (1 - DERIVE_RELATIVE))
    return np.where(v >= 0, inner, -outer), np.where(v >= 0, outer, -inner)


def _some_between(b: np.ndarray, low: np.ndarray, high: np.ndarray, fits: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Whether one of the ascending ``b`` from low to high passes ``fits(which, value)``. All but the outermost pass, so the ends are tried first."""
    first, last = np.searchsorted(b, low), np.searchsorted(b, high, "right") - 1
    out = np.zeros(len(low), bool)
    asked = np.flatnonzero(first <= last)
    while len(asked):
        out[asked] = fits(asked, b[first[asked]]) | fits(asked, b[last[asked]])
        first[asked] += 1
        last[asked] -= 1
        asked = asked[~out[asked] & (first[asked] <= last[asked])]
    return out


def _spread(*sizes: np.ndarray) -> np.ndarray:
    """What rounding can make of numbers of these sizes."""
    return 4e-15 * sum(np.abs(x) for x in sizes)


def _is_rounded(v: np.ndarray, b: np.ndarray) -> np.ndarray:
    reach = ROUND_TOLERANCE + _spread(v)
    return _some_between(b, v - reach, v + reach, lambda i, y: np.abs(v[i] - y) <= ROUND_TOLERANCE)


def _is_derived(v: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of ``v`` are near y - x, x + y or y / x in percent, for one x of ``a`` and one y of the ascending ``b``.

    A few of ``a`` are tried first, in no order, then more and more at a time: what a few derive never meets the others.
    """
    done = np.zeros(len(v), bool)
    a = np.random.default_rng(0).permutation(a)
    at, size = 0, 4
    while at < len(a) and not done.all():
        rest, part = np.flatnonzero(~done), a[at : at + size]
        x, w = np.tile(part, len(rest)), np.repeat(v[rest], len(part))
        low, high = _near_range(w)
        hit = np.zeros(len(x), bool)

        def ask(on: np.ndarray, one: np.ndarray, other: np.ndarray, made: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
            spread = _spread(x[on], one, other)  # noqa: B023
            hit[on] = _some_between(b, np.minimum(one, other) - spread, np.maximum(one, other) + spread, lambda i, y: _near(w[on[i]], made(x[on[i]], y)))  # noqa: B023

        on = np.arange(len(x))
        ask(on, x + low, x + high, lambda x, y: y - x)
        on = np.flatnonzero(~hit)
        ask(on, low[on] - x[on], high[on] - x[on], lambda x, y: x + y)
        on = np.flatnonzero(~hit & (x != 0))
        ask(on, x[on] * low[on] / 100, x[on] * high[on] / 100, lambda x, y: y / x * 100.0)
        done[rest] = hit.reshape(len(rest), -1).any(axis=1)
        at += size
        size = max(1, min(size * 4, LOOKUPS // max(1, int((~done).sum()))))
    return done


def _blocks(numbers: DataFrame, by: list[str], size: int) -> DataFrame:
    """(by, block, least, most, held): the distinct numbers ``x`` of each group, ascending, in runs of at most ``size``."""
    dealt = numbers.repartitionByRange(*by, "x").withColumn("_part", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("_part", *by).orderBy("x")) - 1
    run = F.col("_part").cast("bigint") * (1 << 32) + F.floor(place / size)
    return cut_lineage(dealt.withColumn("block", run).groupBy(*by, "block").agg(F.min("x").alias("least"), F.max("x").alias("most"), F.array_sort(F.collect_list("x")).alias("held")))


def _met(by: list[str], blocks: Mapping[str, DataFrame], reach: Column, judge: Callable[..., np.ndarray]) -> DataFrame:
    """(by, x): claims that ``judge`` finds where blocks of a group meet as far as ``reach`` says; each meeting is a task's own, however large the group."""
    heads = [df.select(*by, *[F.col(c).alias(f"{n}_{c}") for c in ("block", "least", "most")]) for n, df in blocks.items()]
    names = list(blocks)
    keys = [*by, *[f"{n}_block" for n in names]]
    meetings = cut_lineage(reduce(lambda x, y: x.join(y, by), heads).where(reach).select(*keys))
    rows = meetings
    for n, df in blocks.items():
        rows = rows.join(df.select(*by, F.col("block").alias(f"{n}_block"), F.col("held").alias(f"{n}_held")), [*by, f"{n}_block"])

    def found(t: pa.Table) -> pa.Table:
        claims, *others = (t.column(f"{n}_held").combine_chunks().flatten().to_numpy(zero_copy_only=False) for n in names)
        hit = claims[judge(claims, *others)]
        return pa.table({c: t.column(c).take(pa.array(np.zeros(len(hit), np.int64))) for c in by} | {"x": hit})

    kind = StructType([*[meetings.schema[c] for c in by], StructField("x", DoubleType())])
    spread = rows.repartition(min(4_000, max(1, meetings.count())), *keys)  # few bytes, much work: a number that is not merged away
    return spread.groupBy(*keys).applyInArrow(found, kind).distinct()


def _overlap(name: str, *ends: Column) -> Column:
    """Whether a block has room between the least and the greatest of ``ends``."""
    low, high = F.least(*ends), F.greatest(*ends)
    more = F.lit(1e-9) * (F.abs(low) + F.abs(high))
    return (F.col(f"{name}_most") >= low - more) & (F.col(f"{name}_least") <= high + more)


def ground_numbers(claims: DataFrame, pool: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, token, label) for the distinct claimed tokens of each group: literal / rounded / derived / unsupported.

    ``claims`` and ``pool`` hold number texts per group. Rounded is within half a unit of a pool value; derived is a
    difference, sum or share in percent of two pool values (or of one with itself) within the derivation tolerance. Every
    pool value counts. Claims and values meet as ascending blocks of a group, three at a time where their ranges allow it; no
    pair of a claim and a value is written. An infinite number (a text of over 308 digits) is near anything by the tolerance.
    """
    by = list(by)
    asked, known = claims.select(*by, "token").where("token IS NOT NULL").distinct(), pool.select(*by, "token").distinct()
    asked = cut_lineage(asked.join(known.withColumn("literal", F.lit(True)), [*by, "token"], "left"))
    number = F.col("token").try_cast("double")
    values = cut_lineage(known.select(*by, number.alias("x")).where("x IS NOT NULL").distinct())
    rest = cut_lineage(asked.where("literal IS NULL").select(*by, number.alias("x")).where("x IS NOT NULL").distinct())
    finite = F.abs("x") < float("inf")
    in_blocks = _blocks(values.where(finite), by, VALUES_PER_PART)
    c_least, c_most, a_least, a_most = (F.col(f"{n}_{e}") for n in "ca" for e in ("least", "most"))
    close = _overlap("b", c_least - ROUND_TOLERANCE, c_most + ROUND_TOLERANCE)
    rounded = cut_lineage(_met(by, {"c": _blocks(rest.where(finite), by, CLAIMS_PER_PART), "b": in_blocks}, close, _is_rounded))
    rest = rest.join(rounded, [*by, "x"], "left_anti").join(values.groupBy(*by).agg((~F.bool_and(finite)).alias("_any")), by)
    endless = rest.where(F.col("_any") | ~finite).select(*by, "x")
    slack = lambda x: F.greatest(F.lit(DERIVE_ABSOLUTE), F.abs(x) * DERIVE_RELATIVE * 1.01)
    low, high = c_least - slack(c_least), c_most + slack(c_most)
    reach = _overlap("b", a_least + low, a_most + high) | _overlap("b", low - a_most, high - a_least) | _overlap("b", *[x * y / 100 for x in (a_least, a_most) for y in (low, high)])
    open_blocks = _blocks(rest.where(~F.col("_any") & finite).select(*by, "x"), by, CLAIMS_PER_PART)
    derived = _met(by, {"c": open_blocks, "a": in_blocks, "b": in_blocks}, reach, _is_derived).unionByName(endless)
    found = rounded.withColumn("_how", F.lit("rounded")).unionByName(derived.withColumn("_how", F.lit("derived")))
    label = F.when(F.col("literal"), "literal").otherwise(F.coalesce("_how", F.lit("unsupported")))
    return asked.withColumn("x", number).join(found, [*by, "x"], "left").select(*by, "token", label.alias("label"))


def classify_numbers(rows: DataFrame, key: str, claimed: str, supported: str) -> DataFrame:
    """(key, token, label) where each row brings its own arrays of claimed and supported number texts."""
    claims = rows.select(key, F.explode(claimed).alias("token"))
    return ground_numbers(claims, rows.select(key, F.explode(supported).alias("token")), [key])


def unsupported_places(rows: DataFrame, key: str, answer: str, support: str, vocabulary: Sequence[str]) -> DataFrame:
    """Vocabulary names an answer states as whole words and the support never mentions.

    Longest name first; a matched name is consumed so that its parts are not reported again. The
    vocabulary is a fixed list, folded into one expression per row.
    """
    names = F.array(*[F.lit(n) for n in sorted(vocabulary, key=lambda n: (-len(n), n))])
    known = F.lower(F.coalesce(F.col(support), F.lit("")))
    zero = F.struct(
        F.lower(F.coalesce(F.col(answer), F.lit(""))).alias("rest"), F.array().cast("array<string>").alias("found")
    )

    def word(needle: Column) -> Column:
        return F.concat(F.lit(r"(?<![a-z])\Q"), needle, F.lit(r"\E(?![a-z])"))

    def step(acc: Column, name: Column) -> Column:
        needle = F.lower(name)
        hit = F.regexp(acc["rest"], word(needle))
        missing = hit & ~F.regexp(known, word(needle))
        return F.struct(
            F.when(hit, F.replace(acc["rest"], needle, F.lit(" "))).otherwise(acc["rest"]).alias("rest"),
            F.when(missing, F.array_append(acc["found"], name)).otherwise(acc["found"]).alias("found"),
        )

    return rows.select(key, F.array_sort(F.aggregate(names, zero, step)["found"]).alias("unsupported"))


def mask_payload(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Listed array columns replaced by their sizes."""
    return df.withColumns({f: F.size(f) for f in fields})
