"""Profile, detectors, cleaning runs, before/after differences and audits.

Wide checks are one aggregation over the table: every column contributes a few expressions, and the one
row that comes back is turned into one row per column or issue inside Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placescore.functions import clean, compare
from placescore.session import cut_lineage

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _is_text(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.StringType)


def _is_number(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, NUMERIC)


def increasing_violations(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows whose key does not exceed the key before it in ``order`` (ties by key).

    Equal rows are counted once with their number; each copy after the first is a violation. What is left is dealt by ranges of
    (order, key), so a burst within one moment is split too. A range passes on its ends, and only these meet: a row per range.
    """
    pairs = df.groupBy(order, key).agg(F.count(F.lit(1)).alias("n"))
    ranged = cut_lineage(pairs.repartitionByRange(order, key).withColumn("_range", F.spark_partition_id()))
    before = F.lag(key).over(Window.partitionBy("_range").orderBy(order, key))
    inside = ranged.withColumn("_prev", before)
    copies = F.when(F.col(key).isNotNull(), F.col("n") - 1).otherwise(0)
    ends = inside.groupBy("_range").agg(
        F.sum("n").alias("rows"),
        (F.count_if(F.col(key) <= F.col("_prev")) + F.sum(copies)).alias("bad"),
        F.min(F.struct(order, key))[key].alias("first"),
        F.max(F.struct(order, key))[key].alias("last"),
    )
    whole = ends.agg(F.sum("rows").alias("rows"), F.sum("bad").alias("bad"), F.array_sort(F.collect_list(F.struct("_range", "first", "last"))).alias("_ends"))
    n = F.size("_ends")
    seams = F.zip_with(F.slice("_ends", 1, F.greatest(n - 1, F.lit(0))), F.slice("_ends", 2, n), lambda a, b: b["first"] <= a["last"])
    return whole.select((F.col("bad") + F.size(F.filter(seams, lambda x: x))).alias("violations"), "rows")


# ---- profile -----------------------------------------------------------------------------------


def column_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct (column, value, n) over all columns: one shuffle, hot values combined map-side."""
    names = list(columns or df.columns)
    pairs = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in names]
    return (
        df.select(F.explode(F.array(*pairs)).alias("_p"))
        .groupBy("_p.column", "_p.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def profile_columns(df: DataFrame, samples: int = 5) -> DataFrame:
    """Per column: type, nulls, distinct values, min, max and the smallest ``samples`` values as text."""
    values = column_values(df)
    known = F.col("value").isNotNull()
    stats = values.groupBy("column").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("value").alias("n_unique"),
    )
    w = Window.partitionBy("column").orderBy("value")
    first = (
        values.where(known)
        .withColumn("_r", F.row_number().over(w))
        .where(F.col("_r") <= samples)
        .groupBy("column")
        .agg(F.array_sort(F.collect_list("value")).alias("sample_values"))
    )
    extremes = df.agg(
        *[F.min(f"`{c}`").cast("string").alias(f"lo_{i}") for i, c in enumerate(df.columns)],
        *[F.max(f"`{c}`").cast("string").alias(f"hi_{i}") for i, c in enumerate(df.columns)],
    )
    spread = extremes.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                        F.col(f"lo_{i}").alias("min_value"),
                        F.col(f"hi_{i}").alias("max_value"),
                    )
                    for i, c in enumerate(df.columns)
                ]
            )
        ).alias("_e")
    ).select("_e.*")
    return (
        spread.join(stats, "column")
        .join(first, "column", "left")
        .withColumn("null_rate", F.round(F.col("null_count") / F.col("row_count"), 4))
        .withColumn("sample_values", F.coalesce("sample_values", F.array().cast("array<string>")))
        .withColumn("role", semantic_role())
    )


# Name hints of the semantic roles.
DATE_HINTS = ["date", "time", "timestamp", "created", "updated", "modified", "dt", "year", "month", "day"]
ID_HINTS = ["id", "key", "code", "uuid", "guid", "number", "num", "no", "index", "pk"]
GEO_HINTS = [
    "lat", "lng", "lon", "longitude", "latitude", "zip", "zipcode", "postal", "city", "state", "country",
    "borough", "boro", "address", "street", "county", "region", "geo", "coord",
]
POSITIVE_HINTS = [
    "price", "amount", "cost", "fee", "qty", "quantity", "count", "rate", "size", "duration", "weight",
    "height", "length", "age", "rev", "revenue", "income", "balance",
]


def semantic_role() -> Column:
    """Role of a profiled column from its name, type and cardinality."""
    name, dtype = F.lower(F.trim("column")), F.col("dtype")
    share = F.col("n_unique") / F.greatest(F.col("row_count"), F.lit(1))
    is_id = name.rlike("^(" + "|".join(ID_HINTS) + ")$|_(" + "|".join(ID_HINTS) + ")$|^(" + "|".join(ID_HINTS) + ")_")
    text = dtype == "string"
    number = dtype.rlike("int|double|float|decimal")
    size = F.aggregate(F.transform("sample_values", F.length), F.lit(0), lambda a, v: a + v) / F.greatest(
        F.size("sample_values"), F.lit(1)
    )
    return (
        F.when(name.rlike("|".join(DATE_HINTS)) | dtype.rlike("date|timestamp"), "date")
        .when(is_id & (share > 0.9), "identifier")
        .when(name.rlike("|".join(GEO_HINTS)), "geographic")
        .when(text & F.col("n_unique").between(1, 49) & (F.col("row_count") > 100), "category")
        .when(number & ((F.col("n_unique") > 20) | (F.col("row_count") <= 20)), "measure")
        .when(number, "category")
        .when(text & ((size > 50) | (share > 0.5)), "text")
        .when(text, "category")
        .otherwise("unknown")
    )


def structural_issues(profile: DataFrame) -> DataFrame:
    """high_null_rate, empty_column, constant_column, problematic_column_name, suspected_duplicate_columns.

    The profile has one row per column of the table, so pairing columns is small whatever the data; the
    pairs still come from an equi-join on (unique count, samples).
    """
    rate, unique = F.col("null_rate"), F.col("n_unique")
    bad_name = reduce(lambda a, b: a | b, [F.contains("column", F.lit(ch)) for ch in clean.BAD_NAME_CHARACTERS])
    found = F.array(
        F.when(rate > 0.5, F.struct(F.lit("high_null_rate").alias("type"), F.when(rate > 0.8, "high").otherwise("medium").alias("severity"))),
        F.when(rate >= 1.0, F.struct(F.lit("empty_column").alias("type"), F.lit("high").alias("severity"))),
        F.when((unique == 1) & (rate < 1.0), F.struct(F.lit("constant_column").alias("type"), F.lit("low").alias("severity"))),
        F.when(bad_name, F.struct(F.lit("problematic_column_name").alias("type"), F.lit("low").alias("severity"))),
    )
    single = profile.select(
        F.col("column"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("_i")
    ).select("column", "_i.type", "_i.severity")
    a = profile.where(unique > 0).select("column", "n_unique", "sample_values")
    b = a.withColumnRenamed("column", "other")
    twins = a.join(b, ["n_unique", "sample_values"]).where(F.col("column") < F.col("other")).select(
        F.concat("column", F.lit(","), "other").alias("column"),
        F.lit("suspected_duplicate_columns").alias("type"),
        F.lit("medium").alias("severity"),
    )
    return single.unionByName(twins)


# ---- value scanners ----------------------------------------------------------------------------


def scan_quality(df: DataFrame, row_id: str | None = None, examples: int = 5) -> DataFrame:
    """Eleven value-level scanners as (type, column, n, severity, example_rows).

    Everything that can be decided row by row (whitespace, date shapes, numeric text, negatives, bounds)
    is counted in one pass over the table; casing, boolean tokens and duplicates work on distinct
    values. Example rows come from a top-k per fault that is pruned before the shuffle.
    """
    names = [c for c in df.columns if c != row_id]
    parts = [_counted_faults(df, names, row_id, examples), _casing(df, names), _booleans(df, names), _duplicates(df, names)]
    return reduce(DataFrame.unionByName, [p for p in parts if p is not None])


def _issue(df: DataFrame, kind: str | Column, severity: str | Column, examples: Column | None = None) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(
        lit(kind).alias("type"),
        "column",
        F.col("n").cast("bigint").alias("n"),
        lit(severity).alias("severity"),
        (examples if examples is not None else F.array().cast("array<bigint>")).alias("example_rows"),
    )


def _row_tests(df: DataFrame, names: Sequence[str]) -> list[tuple[str, str, str, Column]]:
    """(type, column, severity, row test) of the faults decided row by row."""
    faults: list[tuple[str, str, str, Column]] = []
    for c in names:
        col, lower = F.col(f"`{c}`"), c.lower()
        if _is_text(df, c):
            faults.append(("whitespace_drift", c, "low", col != clean.strip(col)))
            faults.append(
                ("invalid_dates", c, "high", clean.any_date_shape(col) & _lenient_date(clean.strip(col)).isNull())
            )
        elif _is_number(df, c):
            if any(h in lower for h in POSITIVE_HINTS):
                faults.append(("negative_value_unexpected", c, "high", col < 0))
                faults.append(("suspicious_zero", c, "medium", col == 0))
            if "lat" in lower:
                faults.append(("geographic_out_of_bounds", c, "high", ~col.between(-90, 90)))
            elif "lon" in lower or "lng" in lower:
                faults.append(("geographic_out_of_bounds", c, "high", ~col.between(-180, 180)))
    return faults


def _counted_faults(df: DataFrame, names: Sequence[str], row_id: str | None, examples: int) -> DataFrame | None:
    faults = _row_tests(df, names)
    text = [c for c in names if _is_text(df, c)]
    if not faults:
        return None
    at = {c: i for i, c in enumerate(names)}
    aggs = [F.count(f"`{c}`").alias(f"k_{at[c]}") for c in names]
    aggs += [F.count_if(F.coalesce(t, F.lit(False))).alias(f"f_{i}") for i, (_, _, _, t) in enumerate(faults)]
    for c in text:
        col = F.col(f"`{c}`")
        aggs.append(F.count_if(clean.any_date_shape(col)).alias(f"d_{at[c]}"))
        aggs.append(F.count(clean.numeric_text(col)).alias(f"m_{at[c]}"))
        aggs += [F.count_if(clean.date_shape(col, s)).alias(f"s_{at[c]}_{s}") for s in clean.DATE_SHAPES]
    counts = df.agg(*aggs)

    def issue(test: Column, kind: str | Column, c: str, n: Column, severity: str | Column) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.when(
            test,
            F.struct(lit(kind).alias("type"), F.lit(c).alias("column"), n.cast("bigint").alias("n"), lit(severity).alias("severity")),
        )

    found = []
    for i, (kind, c, severity, _) in enumerate(faults):
        n, k = F.col(f"f_{i}"), F.col(f"k_{at[c]}")
        test = n > 0
        if kind == "invalid_dates":
            test = test & (F.col(f"d_{at[c]}") >= 0.5 * k)
        elif kind == "suspicious_zero":
            test = test & (n < 0.5 * k)
        found.append(issue(test, kind, c, n, severity))
    for c in text:
        k, numeric = F.col(f"k_{at[c]}"), F.col(f"m_{at[c]}")
        seen = [F.col(f"s_{at[c]}_{s}") for s in clean.DATE_SHAPES]
        kinds = sum((F.when(x > 0, 1).otherwise(0) for x in seen), F.lit(0))
        found.append(issue((kinds >= 2) & (sum(seen, F.lit(0)) > 0.25 * k), "mixed_date_formats", c, kinds, "high"))
        most = numeric >= 0.95 * k
        found.append(
            issue(
                (k > 0) & (numeric >= 0.70 * k),
                F.when(most, "numeric_stored_as_string").otherwise("mixed_numeric_string"),
                c,
                numeric,
                F.when(most, "medium").otherwise("high"),
            )
        )
    rows = counts.select(F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("_f")).select("_f.*")
    if row_id is None:
        return _issue(rows, F.col("type"), F.col("severity"))
    hits = df.select(
        F.col(row_id).cast("bigint").alias("_row"),
        F.explode(
            F.filter(
                F.array(
                    *[
                        F.when(F.coalesce(t, F.lit(False)), F.struct(F.lit(kind).alias("type"), F.lit(c).alias("column")))
                        for kind, c, _, t in faults
                    ]
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("_h"),
    ).select("_row", "_h.*")
    w = Window.partitionBy("type", "column").orderBy("_row")
    shown = (
        hits.withColumn("_r", F.row_number().over(w))
        .where(F.col("_r") <= examples)
        .groupBy("type", "column")
        .agg(F.array_sort(F.collect_list("_row")).alias("_examples"))
    )
    joined = rows.join(shown, ["type", "column"], "left")
    none = F.array().cast("array<bigint>")
    return _issue(joined, F.col("type"), F.col("severity"), F.coalesce(F.col("_examples"), none))


def _lenient_date(text: Column) -> Column:
    shapes = ["M/d/yyyy", "M/d/yy", "M-d-yyyy", "M-d-yy", "d MMM yyyy", "d-MMM-yyyy", "d/M/yyyy"]
    return F.coalesce(
        text.try_cast("timestamp"), clean.parse_date(text), *[F.try_to_timestamp(text, F.lit(s)) for s in shapes]
    )


def _casing(df: DataFrame, names: Sequence[str]) -> DataFrame | None:
    text = [c for c in names if _is_text(df, c)]
    if not text:
        return None
    v = column_values(df, text).where(F.col("value").isNotNull())
    per = v.groupBy("column", F.lower("value").alias("_l")).agg(F.count(F.lit(1)).alias("_v"))
    found = per.groupBy("column").agg((F.sum("_v") - F.count(F.lit(1))).alias("n")).where(F.col("n") > 0)
    return _issue(found, "casing_inconsistency", "medium")


def _booleans(df: DataFrame, names: Sequence[str]) -> DataFrame | None:
    text = [c for c in names if _is_text(df, c)]
    if not text:
        return None
    v = column_values(df, text).where(F.col("value").isNotNull())
    trimmed = v.select("column", F.trim("value").alias("_t")).distinct()
    token = F.when(F.lower("_t").isin(clean.BOOLEAN_TOKENS), F.lower("_t"))
    found = (
        trimmed.groupBy("column")
        .agg(F.count(F.lit(1)).alias("_u"), F.count_distinct(token).alias("n"))
        .where((F.col("_u") <= 10) & (F.col("n") >= 3))
    )
    return _issue(found, "mixed_boolean_encoding", "high")


def _duplicates(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows taking part in exact-duplicate groups; hot copies collapse map-side."""
    groups = df.groupBy(*[F.col(f"`{c}`") for c in names]).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    found = groups.agg(F.sum("_n").alias("n")).where(F.col("n").isNotNull()).withColumn("column", F.lit(""))
    return _issue(found, "exact_row_duplicates", "high")


def duplicate_identifiers(df: DataFrame, id_columns: Sequence[str]) -> DataFrame:
    """Identifier columns with rows sharing a value."""
    v = column_values(df, id_columns).where(F.col("value").isNotNull() & (F.col("n") > 1))
    return _issue(v.groupBy("column").agg(F.sum("n").alias("n")), "duplicate_identifier", "high")


# ---- cleaning ----------------------------------------------------------------------------------

# The type names a cast may use.
CAST_TYPES = {
    "BOOLEAN": "boolean", "TINYINT": "tinyint", "SMALLINT": "smallint", "INTEGER": "int", "BIGINT": "bigint",
    "HUGEINT": "decimal(38,0)", "UTINYINT": "smallint", "USMALLINT": "int", "UINTEGER": "bigint",
    "UBIGINT": "decimal(20,0)", "FLOAT": "float", "REAL": "float", "DOUBLE": "double", "DECIMAL": "double",
    "VARCHAR": "string", "TEXT": "string", "BLOB": "string", "DATE": "date", "TIME": "string",
    "TIMESTAMP": "timestamp", "TIMESTAMP_S": "timestamp", "TIMESTAMP_MS": "timestamp", "TIMESTAMP_NS": "timestamp",
    "INTERVAL": "interval day to second", "UUID": "string", "JSON": "string",
}


@dataclass(frozen=True)
class Step:
    """What an operation does to the rows before it: new columns, which rows stay, and in which its value could not be had."""

    df: DataFrame
    keep: Column | None = None
    fault: Column | None = None


def _known(df: DataFrame, column: str | None) -> str:
    if column not in df.columns:
        raise ValueError(f"unknown column {column!r}")
    return column


def _drop_column(df: DataFrame, p: Mapping) -> DataFrame:
    return df.drop(_known(df, p.get("column")))


def _rename_column(df: DataFrame, p: Mapping) -> DataFrame:
    old, new = _known(df, p.get("old_name")), p.get("new_name")
    if not new or (new in df.columns and new != old):
        raise ValueError(f"rename target {new!r} is empty or exists")
    return df.withColumnRenamed(old, new)


def _replace_values(df: DataFrame, p: Mapping) -> DataFrame:
    c, mapping = _known(df, p.get("column")), p.get("mapping")
    if not mapping:
        raise ValueError("replace_values needs a mapping")
    return df.withColumn(c, F.coalesce(F.try_element_at(clean.literal_map(mapping), F.col(c)), F.col(c)))


def _cast_type(df: DataFrame, p: Mapping) -> Step:
    c = _known(df, p.get("column"))
    target = str(p.get("target_type")).upper().partition("(")[0].strip()  # DECIMAL(10,2) counts as DECIMAL
    if target not in CAST_TYPES:
        raise ValueError(f"type {target} is not allowed")
    col = F.col(c)
    if target == "BOOLEAN":
        out = clean.parse_boolean(col)
    elif target == "DATE" or target.startswith("TIMESTAMP"):
        out = _lenient_date(clean.strip(col.cast("string"))).cast(CAST_TYPES[target])
    elif "int" in CAST_TYPES[target] and target != "INTERVAL":
        out = clean.to_float(col).try_cast(CAST_TYPES[target])
    else:
        out = col.try_cast(CAST_TYPES[target])
    if target.startswith("U") and target != "UUID":
        out = F.when(out >= 0, out)
    given = F.coalesce(clean.strip(col.cast("string")) != "", F.lit(False))
    return Step(df.withColumn(c, out), fault=given & out.isNull())


def _drop_duplicates(df: DataFrame, p: Mapping) -> DataFrame:
    from placescore.operators.tables import drop_duplicates

    subset = p.get("subset")
    if not subset:
        return df.distinct()
    for c in subset:
        _known(df, c)
    return drop_duplicates(df, subset, p.get("order") or [c for c in df.columns if c not in subset])


def _drop_nulls(df: DataFrame, p: Mapping) -> Step:
    c = F.col(f"`{_known(df, p.get('column'))}`")
    missing = F.isnan(c) if dict(df.dtypes)[p["column"]] in ("float", "double") else F.lit(False)
    return Step(df, keep=c.isNotNull() & ~F.coalesce(missing, F.lit(False)))


def _filter_rows(df: DataFrame, p: Mapping) -> Step:
    c = _known(df, p.get("column"))
    test, fault = compare.condition(df, c, p.get("condition"), p.get("value"), p.get("value2"), p.get("values"))
    return Step(df, keep=test, fault=fault)


def _strip(df: DataFrame, p: Mapping) -> DataFrame:
    c = _known(df, p.get("column"))
    return df.withColumn(c, F.regexp_replace(F.col(c).cast("string"), r"^\s+|\s+$", ""))


def _case(df: DataFrame, p: Mapping) -> DataFrame:
    c, mode = _known(df, p.get("column")), p.get("mode", "lower")
    modes = {"lower": F.lower, "upper": F.upper, "title": clean.title_first}
    if mode not in modes:
        raise ValueError(f"case mode {mode!r} is not allowed")
    return df.withColumn(c, modes[mode](F.col(c).cast("string")))


def _new(df: DataFrame, name: str) -> str:
    if name in df.columns:
        raise ValueError(f"column {name!r} exists")
    return name


def _add_cell(df: DataFrame, p: Mapping) -> DataFrame:
    from placescore.functions import cells

    lat, lon = _known(df, p.get("lat_col")), _known(df, p.get("lon_col"))
    out = _new(df, p.get("output_col", "cell"))
    return df.withColumn(out, cells.cell(F.col(lat).try_cast("double"), F.col(lon).try_cast("double")))


def _transform_coords(df: DataFrame, p: Mapping) -> DataFrame:
    from placescore.functions import cells

    xy = cells.transform_coords(F.col(_known(df, p.get("x_col"))), F.col(_known(df, p.get("y_col"))), p.get("source_crs"))
    lon, lat = _new(df, p.get("out_lon_col", "longitude")), _new(df, p.get("out_lat_col", "latitude"))
    return df.withColumns({lon: xy["lon"], lat: xy["lat"]})


def _polygon_centroid(df: DataFrame, p: Mapping) -> DataFrame:
    from placescore.functions import cells

    c = cells.polygon_centroid(F.col(_known(df, p.get("geom_col"))))
    lon, lat = _new(df, p.get("out_lon_col", "centroid_lon")), _new(df, p.get("out_lat_col", "centroid_lat"))
    return df.withColumns({lon: c["lon"], lat: c["lat"]})


# The operations a cleaning plan may name.
OPERATIONS: dict[str, Callable[[DataFrame, Mapping], DataFrame | Step]] = {
    "drop_column": _drop_column,
    "rename_column": _rename_column,
    "replace_values": _replace_values,
    "cast_type": _cast_type,
    "drop_duplicates": _drop_duplicates,
    "drop_nulls": _drop_nulls,
    "filter_rows": _filter_rows,
    "strip_whitespace": _strip,
    "transform_case": _case,
    "add_cell_index": _add_cell,
    "transform_coords": _transform_coords,
    "polygon_centroid": _polygon_centroid,
}


@dataclass
class Applied:
    """A cleaning plan over a table: the rows, and what is needed to count its log.

    Row tests do not drop rows at once but mark them, so all steps between two that shuffle are counted in one pass over
    the rows. ``segments`` holds those passes: the marked rows with the counters of their steps.
    """

    df: DataFrame
    log: list[dict]
    segments: list[tuple[DataFrame, dict[str, Column]]]


_ALIVE = "_alive"


def applied(df: DataFrame, plan: Sequence[Mapping]) -> Applied:
    """Fold the operations; an unknown one, or one whose columns or literals do not fit, is noted and skipped."""
    log: list[dict] = []
    segments: list[tuple[DataFrame, dict[str, Column]]] = []
    now = df.withColumn(_ALIVE, F.lit(True))
    counters, flags = {"start": F.count(F.lit(1))}, [0]

    def flag(rows: DataFrame, column: Column) -> tuple[DataFrame, str]:
        flags[0] += 1
        return rows.withColumn(f"_flag{flags[0]}", column), f"_flag{flags[0]}"

    for number, op in enumerate(plan, start=1):
        kind = op.get("op")
        entry = {"step": number, "op": str(kind), "status": "ok", "detail": "", "segment": len(segments), "after": None, "faults": None}
        try:
            if kind not in OPERATIONS:
                raise ValueError(f"unknown operation {kind!r}")
            shown = now.drop(*[c for c in now.columns if c == _ALIVE or c.startswith("_flag")])
            if kind == "drop_duplicates":
                rows = OPERATIONS[kind](now.where(_ALIVE).select(*shown.columns), op)
                rows.schema  # noqa: B018  (resolves names now, so a bad step fails here and not later)
                segments.append((now, counters))
                now, counters = rows.withColumn(_ALIVE, F.lit(True)), {"start": F.count(F.lit(1))}
                entry["segment"] = len(segments)
            else:
                made = OPERATIONS[kind](now, op)
                step = made if isinstance(made, Step) else Step(made)
                step.df.schema  # noqa: B018
                source, fresh = now, {}
                if step.fault is not None:
                    source, name = flag(now, F.col(_ALIVE) & step.fault)
                    fresh[f"faults{number}"] = F.count_if(name)
                    made = OPERATIONS[kind](source, op)
                    step = made if isinstance(made, Step) else Step(made)
                rows = step.df
                if step.keep is not None:
                    rows = rows.withColumn(_ALIVE, F.col(_ALIVE) & step.keep)
                    rows, name = flag(rows, F.col(_ALIVE))
                    fresh[f"after{number}"] = F.count_if(name)
                    entry["after"] = f"after{number}"
                rows.schema  # noqa: B018
                entry["faults"] = f"faults{number}" if step.fault is not None else None
                now, counters = rows, counters | fresh
        except Exception as problem:  # noqa: BLE001
            entry |= {"status": "skipped", "detail": type(problem).__name__, "segment": len(segments), "after": None, "faults": None}
        log.append(entry)
    segments.append((now, counters))
    out = now.where(_ALIVE).select(*[c for c in now.columns if c != _ALIVE and not c.startswith("_flag")])
    return Applied(out, log, segments)


def apply_plan(df: DataFrame, plan: Sequence[Mapping]) -> tuple[DataFrame, list[dict], list]:
    """Cleaned rows, the log as far as it is known without reading rows, and the passes that count it."""
    a = applied(df, plan)
    return a.df, a.log, a.segments


def run_plan(df: DataFrame, plan: Sequence[Mapping]) -> tuple[DataFrame, DataFrame]:
    """Cleaned rows and a log (step, op, status, detail, rows_before, rows_after, faults).

    ``faults`` counts the rows whose value a step could not have: a cast that gave nothing, a text beside a number test. No
    row ends the run. The log takes one pass per shuffling step and one more.
    """
    spark = df.sparkSession
    plan_of = applied(df, plan)
    passes = []
    for i, (rows, counters) in enumerate(plan_of.segments):
        pairs = F.create_map(*[x for name, c in counters.items() for x in (F.lit(name), c)])
        passes.append(rows.agg(pairs.alias("counts")).withColumn("segment", F.lit(i)))
    counts = reduce(DataFrame.unionByName, passes).groupBy().agg(F.map_from_entries(F.collect_list(F.struct("segment", "counts"))).alias("all"))
    rows, last, segment = [], "start", 0
    for e in plan_of.log:
        if e["segment"] != segment:  # a shuffling step: the rows before it are those the last segment ends with
            rows.append((e["step"], e["op"], e["status"], e["detail"], segment, last, e["segment"], "start", None))
            segment, last = e["segment"], "start"
        else:
            after = e["after"] or last
            rows.append((e["step"], e["op"], e["status"], e["detail"], segment, last, segment, after, e["faults"]))
            last = after
    steps = spark.createDataFrame(rows, "step int, op string, status string, detail string, _bs int, _b string, _as int, _a string, _f string")

    def count(segment: str, name: str) -> Column:
        return F.try_element_at(F.try_element_at(F.col("all"), F.col(segment)), F.col(name))

    joined = steps.join(F.broadcast(counts), F.lit(True))  # one row
    return plan_of.df, joined.select(
        "step", "op", "status", "detail", count("_bs", "_b").alias("rows_before"), count("_as", "_a").alias("rows_after"), F.coalesce(count("_as", "_f"), F.lit(0)).alias("faults")
    )


# ---- differences and audits --------------------------------------------------------------------


def column_stats(df: DataFrame) -> DataFrame:
    v = column_values(df)
    known = F.col("value").isNotNull()
    types = clean.literal_map({c: df.schema[c].dataType.simpleString() for c in df.columns})
    return v.groupBy("column").agg(
        F.round(F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)) / F.sum("n"), 4).alias("null_rate"),
        F.count("value").alias("n_unique"),
    ).withColumn("dtype", F.element_at(types, F.col("column")))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Column by column: status, types, null-rate change, unique counts and the problems that appeared."""
    b = column_stats(before).select("column", *[F.col(c).alias(f"{c}_before") for c in ("dtype", "null_rate", "n_unique")])
    a = column_stats(after).select("column", *[F.col(c).alias(f"{c}_after") for c in ("dtype", "null_rate", "n_unique")])
    j = b.join(a, "column", "full")
    nb, na = F.col("null_rate_before"), F.col("null_rate_after")
    problems = F.array(
        F.when((na > nb) & (nb < 0.01), F.lit("new_nulls_introduced")),
        F.when(na > nb + 0.1, F.lit("significant_null_increase")),
        F.when((F.col("n_unique_after") == 1) & (F.col("n_unique_before") > 1), F.lit("collapsed_to_constant")),
    )
    status = F.when(F.col("dtype_after").isNull(), "removed").when(F.col("dtype_before").isNull(), "added").otherwise("common")
    return j.withColumns(
        {
            "status": status,
            "type_changed": F.col("dtype_before") != F.col("dtype_after"),
            "null_rate_delta": F.round(na - nb, 4),
            "problems": F.array_join(F.filter(problems, lambda x: x.isNotNull()), ","),
        }
    )


def audit_ready(tables: Mapping[str, DataFrame], as_of: Column, box: tuple[float, float, float, float]) -> DataFrame:
    """Gate counts per published table: bad scores, coordinates, cells, quarters and rows."""
    from placescore.functions import cells

    parts = []
    for name, df in tables.items():
        have = set(df.columns)
        zero = F.lit(0).cast("bigint")
        quarter = F.col("quarter") if "quarter" in have else None
        limit = F.concat(F.year(as_of).cast("string"), F.lit("Q"), F.quarter(as_of).cast("string"))
        shape = r"^\d{4}Q[1-4]$"
        parts.append(
            df.agg(
                F.count(F.lit(1)).alias("rows"),
                (F.count_if(~F.coalesce(F.col("score").between(0, 100), F.lit(False))) if "score" in have else zero).alias("bad_scores"),
                (F.count_if(~cells.in_box(F.col("lat"), F.col("lon"), box)) if {"lat", "lon"} <= have else zero).alias("bad_coordinates"),
                (F.count_if(F.col("cell").isNull()) if "cell" in have else zero).alias("empty_cells"),
                (F.count_if(~F.coalesce(quarter.rlike(shape), F.lit(False))) if quarter is not None else zero).alias("malformed_quarters"),
                (F.count_if(quarter.rlike(shape) & (quarter < "2000Q1")) if quarter is not None else zero).alias("early_quarters"),
                (F.count_if(quarter.rlike(shape) & (quarter > limit)) if quarter is not None else zero).alias("future_quarters"),
            ).select(F.lit(name).alias("table"), "*")
        )
    rows = reduce(DataFrame.unionByName, parts)
    bad = F.col("bad_scores") + F.col("bad_coordinates") + F.col("empty_cells") + F.col("malformed_quarters") + F.col("early_quarters") + F.col("future_quarters")
    return rows.withColumn("valid", (F.col("rows") > 0) & (bad == 0))


def audit_raw(expected: DataFrame, actual: DataFrame, allowed: Sequence[str] = ()) -> DataFrame:
    """(path, rows, status, errors) of every expected or present file of a snapshot.

    ``expected`` is (path, columns) and perhaps ``expected_rows``; ``actual`` is (path, columns, rows) and perhaps ``parsed``, false
    where the full parse failed. A present file that nothing expects is ``auxiliary`` when allowed, else ``unexpected``; an
    expected one is ``missing``, ``invalid`` (not parsed), ``incompatible`` (columns missing or doubled, no rows, another row
    count) or ``ok``.
    """
    want = expected.select("path", F.col("columns").alias("_want"), (F.col("expected_rows") if "expected_rows" in expected.columns else F.lit(None)).cast("bigint").alias("_rows"), F.lit(True).alias("_e"))
    have = actual.select("path", F.col("columns").alias("_have"), "rows", (F.col("parsed") if "parsed" in actual.columns else F.lit(True)).alias("_parsed"), F.lit(True).alias("_a"))
    j = want.join(have, "path", "full")
    lost = F.array_except("_want", "_have")
    doubled = F.array_distinct(F.filter("_have", lambda c: F.size(F.filter("_have", lambda d: d == c)) > 1))
    found = F.array_compact(
        F.array(
            F.when(F.size(lost) > 0, F.concat(F.lit("without "), F.array_join(F.array_sort(lost), ","))),
            F.when(F.size(doubled) > 0, F.concat(F.lit("twice "), F.array_join(F.array_sort(doubled), ","))),
            F.when(F.col("rows") == 0, F.lit("no rows")),
            F.when(F.col("rows") != F.col("_rows"), F.concat(F.lit("rows "), F.col("rows").cast("string"), F.lit(" of "), F.col("_rows").cast("string"))),
        )
    )
    status = (
        F.when(F.col("_a").isNull(), "missing")
        .when(F.col("_e").isNull(), F.when(F.col("path").isin(list(allowed)), "auxiliary").otherwise("unexpected"))
        .when(~F.coalesce("_parsed", F.lit(False)), "invalid")
        .when(F.size(found) > 0, "incompatible")
        .otherwise("ok")
    )
    judged = j.withColumn("status", status)
    errors = F.when(F.col("status") == "incompatible", F.array_join(found, "; ")).when(F.col("status") == "invalid", "not parsed").otherwise("")
    return judged.select("path", "rows", "status", errors.alias("errors"))


BAD_STATUS = ["missing", "unexpected", "invalid", "incompatible"]


def audit_status(judged: DataFrame, status: str = "status") -> DataFrame:
    """One row: how many of each status, and whether the whole is ok."""
    names = ["ok", "auxiliary", *BAD_STATUS]
    counts = judged.agg(*[F.count_if(F.col(status) == n).alias(n) for n in names])
    return counts.withColumn("status", F.when(sum((F.col(n) for n in BAD_STATUS), F.lit(0)) == 0, "ok").otherwise("invalid"))


def audit_ready_set(audited: DataFrame, expected: Sequence[str], auxiliary: Sequence[str] = (), partial: str = ".partial") -> DataFrame:
    """The tables of :func:`audit_ready` against the set that should be there: (table, rows, status).

    Status is ok, missing, unexpected, auxiliary, ``incompatible`` (a gate failed) or ``invalid`` (a write that was not finished).
    """
    names = F.array(*[F.lit(n) for n in expected])
    want = audited.sparkSession.range(1).select(F.explode(names).alias("table"), F.lit(True).alias("_e"))  # a fixed list
    j = want.join(audited.select("table", "rows", "valid"), "table", "full")
    status = (
        F.when(F.col("valid").isNull(), "missing")
        .when(F.col("table").endswith(partial), "invalid")
        .when(F.col("_e").isNull(), F.when(F.col("table").isin(list(auxiliary)), "auxiliary").otherwise("unexpected"))
        .when(~F.col("valid"), "incompatible")
        .otherwise("ok")
    )
    return j.select("table", "rows", status.alias("status"))


def assert_domain(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Violations per rule in one aggregation."""
    one = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    return one.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])).alias("_r")
    ).select("_r.*")


def cross_check(a: DataFrame, b: DataFrame, key: str, date: str | None = None) -> DataFrame:
    """Shared columns, key overlap both ways, orphan keys, key types and date-range overlap of two tables."""
    shared = sorted(set(a.columns) & set(b.columns))
    ka, kb = a.select(key).where(F.col(key).isNotNull()).distinct(), b.select(key).where(F.col(key).isNotNull()).distinct()
    both = ka.withColumn("_a", F.lit(True)).join(kb.withColumn("_b", F.lit(True)), key, "full")
    out = both.agg(
        F.count_if(F.col("_a") & F.col("_b")).alias("shared_keys"),
        F.count_if(F.col("_b").isNull()).alias("orphans_a"),
        F.count_if(F.col("_a").isNull()).alias("orphans_b"),
    ).withColumns(
        {
            "shared_columns": F.lit(",".join(shared)),
            "same_key_type": F.lit(a.schema[key].dataType == b.schema[key].dataType),
        }
    )
    if date:
        ra = a.agg(F.min(date).alias("_a0"), F.max(date).alias("_a1"))
        rb = b.agg(F.min(date).alias("_b0"), F.max(date).alias("_b1"))
        overlap = (F.col("_a0") <= F.col("_b1")) & (F.col("_b0") <= F.col("_a1"))
        out = out.join(F.broadcast(ra), F.lit(True)).join(F.broadcast(rb), F.lit(True)).withColumn("dates_overlap", overlap).drop("_a0", "_a1", "_b0", "_b1")
    return out


def extra_checks(df: DataFrame, value: str, date: str, required: Sequence[str]) -> DataFrame:
    """Row completeness, largest gap between days, and values above ten times the 99th percentile."""
    from placescore.operators import ordering

    complete = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in required])
    p99 = ordering.exact_quantiles(df, value, [0.99]).select(F.col("quantiles")[0].alias("_p99"))
    head = df.join(F.broadcast(p99), F.lit(True)).agg(
        F.round(F.count_if(complete) / F.count(F.lit(1)), 4).alias("completeness"),
        F.count_if(F.col(value) > 10 * F.col("_p99")).alias("outliers"),
    )
    # one row per calendar day meets in this window: bounded by the span of dates
    days = df.select(F.to_date(date).alias("_day")).where(F.col("_day").isNotNull()).distinct()
    gaps = days.withColumn("_gap", F.datediff("_day", F.lag("_day").over(Window.orderBy("_day")))).agg(
        F.max("_gap").alias("largest_gap_days"), F.count(F.lit(1)).alias("days")
    )
    return head.join(F.broadcast(gaps), F.lit(True))


def catalog_sync(pages: DataFrame, reported_total: int, minimum_share: float = 0.97) -> DataFrame:
    """Catalogue pages merged by id (newest page wins); refuses when under 97 % of the reported total."""
    from placescore.operators.tables import concat_last_wins

    merged = concat_last_wins([pages], "id", ["page", "updated_at"])
    total = merged.agg(F.count(F.lit(1)).alias("_n"))
    ok = F.col("_n") >= F.lit(minimum_share * reported_total)
    return merged.join(F.broadcast(total), F.lit(True)).withColumn(
        "complete", F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("catalogue is truncated")).cast("boolean"))
    ).drop("_n")
