"""Normalisers, lenient parsing and row predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# NA tokens, date formats in trial order, borough codes, boolean spellings.
NA_TOKENS = ["", "NA", "N/A", "n/a", "null", "NULL", "None"]
DATE_FORMATS = [
    "M/d/yyyy",
    "M/d/yyyy h:mm:ss a",
    "yyyyMMdd",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
]
MISSING_DATE_WORDS = ["", "nat", "nan", "none", "null"]
BOROUGH_CODES = {
    "MN": "MANHATTAN",
    "BK": "BROOKLYN",
    "BX": "BRONX",
    "QN": "QUEENS",
    "SI": "STATEN ISLAND",
}
BOOLEAN_WORDS = {
    "true": True,
    "false": False,
    "yes": True,
    "no": False,
    "y": True,
    "n": False,
    "1": True,
    "0": False,
    "t": True,
    "f": False,
}


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def normalize_zip(c: Column, drop_fraction: bool = False) -> Column:
    """Digits only, first five, left-padded with zeros; nothing left means NULL."""
    text = c.cast("string")
    if drop_fraction:
        text = F.substring_index(text, ".", 1)
    digits = F.left(F.regexp_replace(text, r"\D", ""), F.lit(5))
    return F.when(F.length(digits) > 0, F.lpad(digits, 5, "0"))


def normalize_borough(c: Column) -> Column:
    name = F.upper(F.trim(c))
    return F.coalesce(F.try_element_at(literal_map(BOROUGH_CODES), name), name)


def parse_date(c: Column) -> Column:
    """First of the known formats that fits the text or its first 19 characters."""
    text = F.trim(c.cast("string"))
    usable = F.when(~F.lower(text).isin(MISSING_DATE_WORDS), text)
    tries = [
        F.try_to_timestamp(candidate, F.lit(fmt))
        for candidate in (usable, F.left(usable, F.lit(19)))
        for fmt in DATE_FORMATS
    ]
    return F.coalesce(*tries)


def parse_when(c: Column) -> Column:
    """Epoch seconds or ISO text to a timestamp; no zone means UTC."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(r"^\d+$"), F.timestamp_seconds(text.try_cast("bigint"))).otherwise(
        text.try_cast("timestamp")
    )


def valid_event_date(c: Column, as_of: Column) -> Column:
    """The date when it lies in 2000-01-01 .. as_of, otherwise NULL."""
    day = F.to_date(c)
    return F.when(day.between(F.lit("2000-01-01").cast("date"), F.to_date(as_of)), day)


def quarter_label(c: Column, as_of: Column | None = None) -> Column:
    """'2024Q1'; outside the accepted range NULL."""
    day = c if as_of is None else valid_event_date(c, as_of)
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))


def canonical_quarter(c: Column, as_of: Column | None = None) -> Column:
    """'YYYYQn' or 'YYYY-Qn' to 'YYYY-Qn'; before 2000 and future quarters are rejected."""
    text = F.trim(c)
    shape = r"^(\d{4})-?Q([1-4])$"
    year = F.regexp_extract(text, shape, 1)
    label = F.concat(year, F.lit("-Q"), F.regexp_extract(text, shape, 2))
    ok = text.rlike(shape) & (year >= "2000")
    if as_of is not None:
        limit = F.concat(
            F.year(as_of).cast("string"), F.lit("-Q"), F.quarter(as_of).cast("string")
        )
        ok = ok & (label <= limit)
    return F.when(ok, label)


def quarter_index(label: Column) -> Column:
    """4 * year + quarter - 1 of 'YYYYQn' or 'YYYY-Qn'."""
    return (
        F.left(label, F.lit(4)).cast("int") * 4 + F.right(label, F.lit(1)).cast("int") - 1
    )


def is_consecutive(earlier: Column, later: Column) -> Column:
    return quarter_index(later) - quarter_index(earlier) == 1


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(c, F.lit(" \t\n\r\x0b\x0c"))


def as_double(c: Column) -> Column:
    """Number or NULL; a text that ends in a letter ('1d', '2f', 'NaN') is no number."""
    return F.when(~c.cast("string").rlike(r"[A-Za-z]\s*$"), c.try_cast("double"))


def to_float(c: Column) -> Column:
    """Finite number or NULL."""
    v = as_double(c)
    return F.when(F.abs(v) < F.lit(float("inf")), v)


def to_int(c: Column) -> Column:
    return to_float(c).try_cast("bigint")


def blank_na(c: Column) -> Column:
    return F.when(~c.isin(NA_TOKENS), c)


def parse_boolean(c: Column) -> Column:
    return F.try_element_at(literal_map(BOOLEAN_WORDS), F.lower(c.cast("string")))


def title_first(c: Column) -> Column:
    """First character upper, the rest lower; not per word."""
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, 2, 1 << 30)))


def within_days(c: Column, days: int, as_of: Column) -> Column:
    """0 <= as_of - date <= days; unparseable or future dates are false."""
    return F.coalesce(F.datediff(as_of, c).between(0, days), F.lit(False))


def between_cast(c: Column, low: float, high: float) -> Column:
    return F.coalesce(as_double(c).between(low, high), F.lit(False))


# The named row filters. contains any / one of / lacks.
ROW_FILTERS: dict[str, tuple[str, list[str]]] = {
    "rodent_positive": ("contains", ["RAT", "FAILED", "ACTIVE"]),
    "safety_311": ("one_of", ["RODENT", "SANITATION CONDITION", "UNSANITARY CONDITION"]),
    "open_violations": ("lacks", ["CLOSE"]),
    "active_aep": ("lacks", ["DISCHARG"]),
    "alive_tree": ("one_of", ["ALIVE"]),
    "live_linknyc": ("one_of", ["LIVE"]),
    "operational_toilet": ("one_of", ["OPERATIONAL"]),
    "current_bike_route": ("one_of", ["CURRENT"]),
}


def named_filter(mode: str, c: Column) -> Column:
    """One of the named row filters applied to a column; NULL counts as empty text."""
    kind, words = ROW_FILTERS[mode]
    text = F.upper(F.coalesce(c, F.lit("")))
    if kind == "one_of":
        return text.isin(words)
    hit = text.rlike("|".join(words))
    return ~hit if kind == "lacks" else hit


def has_tokens(c: Column, tokens: Sequence[str]) -> Column:
    """Every token occurs as a whole word of the upper-cased text."""
    text = F.upper(F.coalesce(c, F.lit("")))
    test = F.lit(True)
    for token in tokens:
        test = test & text.rlike(f"(^|[^A-Z0-9]){token}([^A-Z0-9]|$)")
    return test


def words_of(c: Column) -> Column:
    """Distinct whole words (A-Z0-9 runs) of the upper-cased text."""
    return F.array_distinct(
        F.filter(F.split(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]+"), lambda w: w != "")
    )


def first_valid(
    candidates: Sequence[tuple[Column, float, float]], default: float
) -> tuple[Column, Column]:
    """First candidate with 0 < value <= limit, times its factor; plus whether any was usable."""
    picked = F.coalesce(
        *[
            F.when((as_double(c) > 0) & (as_double(c) <= limit), as_double(c) * factor)
            for c, limit, factor in candidates
        ]
    )
    return F.coalesce(picked, F.lit(float(default))), picked.isNotNull()


# The shapes a date text may take, and boolean tokens a column may mix.
DATE_SHAPES = {
    "iso_date": r"^\d{4}-\d{2}-\d{2}$",
    "iso_datetime": r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2})?$",
    "us_slash": r"^\d{1,2}/\d{1,2}/\d{2,4}$",
    "us_dash": r"^\d{1,2}-\d{1,2}-\d{2,4}$",
    "eu_slash": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "month_word": r"^\d{1,2}[-\s][A-Za-z]{3,}[-\s]\d{2,4}$",
}
BOOLEAN_TOKENS = ["y", "yes", "true", "t", "1", "on", "n", "no", "false", "f", "0", "off"]
BAD_NAME_CHARACTERS = " !@#$%^&*()+=[]{}|;:'\",<>?/\\"


def date_shape(c: Column, shape: str) -> Column:
    return F.coalesce(strip(c).rlike(DATE_SHAPES[shape]), F.lit(False))


def any_date_shape(c: Column) -> Column:
    return F.coalesce(
        strip(c).rlike("|".join(f"(?:{p})" for p in DATE_SHAPES.values())), F.lit(False)
    )


def numeric_text(c: Column) -> Column:
    """The number behind a text with thousands separators, or NULL."""
    return as_double(F.regexp_replace(strip(c), ",", ""))
