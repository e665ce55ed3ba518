"""Query normalisation, answer canonicalisation and id / sentence assembly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Borough aliases in trial order, and trailing address qualifiers.
BOROUGH_ALIASES: list[tuple[str, str | None]] = [
    ("STATEN ISLAND", "STATEN ISLAND"),
    ("THE BRONX", "BRONX"),
    ("MANHATTAN", "MANHATTAN"),
    ("BROOKLYN", "BROOKLYN"),
    ("QUEENS", "QUEENS"),
    ("BRONX", "BRONX"),
    ("NEW YORK CITY", None),
    ("NEW YORK", "MANHATTAN"),
    ("NYC", None),
]
QUALIFIERS = ["NY", "N.Y.", "N Y", "USA", "U.S.A.", "US", "UNITED STATES"]
POSTAL_TAIL = r"(?:N\.?\s?Y\.?\s+)?\d{5}(?:-\d{4})?"
ORDINAL = r"\b(\d+)(?:ST|ND|RD|TH)\b"


def parse_query(c: Column) -> Column:
    """Struct(tokens, borough): qualifiers dropped, ordinals folded, one borough alias lifted out."""
    names = "|".join(q.replace(".", r"\.") for q in QUALIFIERS)
    tail = rf"(?:\s*,\s*(?:{names}|{POSTAL_TAIL})\s*)+$"
    text = F.trim(F.upper(F.coalesce(c, F.lit(""))))
    text = F.regexp_replace(text, tail, "")
    text = F.trim(F.regexp_replace(text, ORDINAL, "$1"))
    borough = F.lit(None).cast("string")
    rest = text
    for alias, name in reversed(BOROUGH_ALIASES):
        pattern = rf"(?:^|[^A-Z]){alias}(?:[^A-Z]|$)"
        hit = text.rlike(pattern)
        borough = F.when(hit, F.lit(name)).otherwise(borough)
        rest = F.when(hit, F.regexp_replace(text, pattern, " ")).otherwise(rest)
    tokens = F.filter(F.split(rest, "[^A-Z0-9]+"), lambda t: t != "")
    return F.struct(tokens.alias("tokens"), borough.alias("borough"))


# Typographic characters and what they become; spaces; zero-width characters.
CURLY = "‘’“”‐‑‒–—"
STRAIGHT = "''\"\"-----"
WIDE_SPACES = (
    "               　"
)
ZERO_WIDTH = "​‌‍⁠﻿"
NUMBER = r"\d+\.\d+|\d{2,}"


def canon(c: Column) -> Column:
    return F.translate(
        F.coalesce(c, F.lit("")), CURLY + WIDE_SPACES + ZERO_WIDTH, STRAIGHT + " " * len(WIDE_SPACES)
    )


def numbers(c: Column) -> Column:
    """Distinct number texts in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({NUMBER})"), F.lit(1)))


def sentence_count(c: Column) -> Column:
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"\d+\.\d+", "0")
    text = F.regexp_replace(text, r"\b(e\.g|i\.e|vs|approx|St|Ave)\.", "$1")
    return F.size(F.filter(F.split(text, "[.!?。！？]+"), lambda p: F.trim(p) != ""))


def json_object(c: Column) -> Column:
    """The JSON object inside a text (fenced or bare) as text, or NULL when it does not parse."""
    body = F.trim(F.coalesce(c, F.lit("")))
    fenced = F.regexp_extract(body, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(F.length(fenced) > 0, F.trim(fenced)).otherwise(body)
    span = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(span).isNotNull(), span)


def canonical_id(c: Column) -> Column:
    return F.concat(F.lit("pluto_"), c.try_cast("double").cast("bigint").cast("string"))


def first_sentence(c: Column, limit: int = 200) -> Column:
    text = F.trim(F.coalesce(c, F.lit("")))
    out = F.left(text, F.lit(limit))
    for sep in reversed([". ", "! ", "? ", "\n"]):
        out = F.when(
            F.contains(text, F.lit(sep)), F.left(F.trim(F.substring_index(text, sep, 1)), F.lit(limit))
        ).otherwise(out)
    return out


def signed(c: Column, digits: int = 1) -> Column:
    return F.format_string(f"%+.{digits}f", c.cast("double"))


def is_subsequence(expected: Column, actual: Column) -> Column:
    """Expected items occur in actual in this order, gaps allowed."""
    walked = F.aggregate(
        actual,
        F.lit(0),
        lambda at, item: at + F.when(F.coalesce(F.get(expected, at) == item, F.lit(False)), 1).otherwise(0),
    )
    return walked == F.size(expected)


def contains_all(actual: Column, required: Column) -> Column:
    return F.size(F.array_except(required, actual)) == 0
