"""Comparisons between a column and literals of any type that never fail on a row.

Equality and membership across types are false, an order between types that have none is refused when the plan is made, and
a text that cannot be read as the number it is compared with is a fault: no match, and counted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placescore.functions import clean

ORDERS: dict[str, Callable[[Column, Column], Column]] = {
    "gt": lambda a, b: a > b,
    "lt": lambda a, b: a < b,
    "gte": lambda a, b: a >= b,
    "lte": lambda a, b: a <= b,
}


def never() -> Column:
    return F.lit(False)


class Incomparable(ValueError):
    """The literal has no order or equality with the column's type."""


def family(df: DataFrame, name: str) -> str:
    kind = df.schema[name].dataType
    for base, what in ((T.NumericType, "number"), (T.StringType, "text"), (T.BooleanType, "flag"), ((T.DateType, T.TimestampType, T.TimestampNTZType), "time")):
        if isinstance(kind, base):
            return what
    return "other"


def sides(df: DataFrame, name: str, literal: object) -> tuple[Column, Column, Column]:
    """(column, literal, fault) as values of one type."""
    c, what = F.col(f"`{name}`"), family(df, name)
    if isinstance(literal, bool):
        if what == "flag":
            return c, F.lit(literal), never()
    elif isinstance(literal, (int, float)):
        if what == "number":
            return c, F.lit(literal), never()
        if what == "text":
            number = clean.as_double(c)
            return number, F.lit(float(literal)), F.coalesce((clean.strip(c) != "") & number.isNull(), never())
    elif isinstance(literal, (date, datetime)):
        if what == "time":
            return c, F.lit(literal), never()
    elif isinstance(literal, str):
        if what == "text":
            return c, F.lit(literal), never()
        if what == "time":
            try:
                return c, F.lit(datetime.fromisoformat(literal)), never()
            except ValueError:
                pass
    raise Incomparable(f"{type(literal).__name__} beside {what} column {name!r}")


def equals(df: DataFrame, name: str, literal: object) -> tuple[Column, Column]:
    """(test, fault); values of other types are not equal."""
    try:
        left, right, fault = sides(df, name, literal)
    except Incomparable:
        return never(), never()
    return F.coalesce(left == right, never()), fault


def one_of(df: DataFrame, name: str, literals: Sequence) -> tuple[Column, Column]:
    """Membership in a list of mixed types: every literal is met as what it is. Faults are not counted, another type may match."""
    by_type: dict[type, list] = {}
    for x in literals:
        by_type.setdefault(float if isinstance(x, int) and not isinstance(x, bool) else type(x), []).append(x)
    test = never()
    for same in by_type.values():
        try:
            left, _, _ = sides(df, name, same[0])
        except Incomparable:
            continue
        rights = [sides(df, name, x)[1] for x in same if _fits(df, name, x)]
        if rights:
            test = test | F.coalesce(left.isin(rights), never())
    return test, never()


def _fits(df: DataFrame, name: str, literal: object) -> bool:
    try:
        sides(df, name, literal)
    except Incomparable:
        return False
    return True


def ordered(df: DataFrame, name: str, kind: str, literal: object) -> tuple[Column, Column]:
    left, right, fault = sides(df, name, literal)
    return F.coalesce(ORDERS[kind](left, right), never()), fault


def condition(df: DataFrame, name: str, kind: str, value: object = None, value2: object = None, values: Sequence | None = None) -> tuple[Column, Column]:
    """(row test, fault) of one of ten conditions. A NULL meets no comparison but ``neq`` and ``not_in``."""
    c = F.col(f"`{name}`")
    if kind == "is_null":
        return c.isNull(), never()
    if kind == "not_null":
        return c.isNotNull(), never()
    if kind in ("in", "not_in"):
        if not values:
            raise ValueError(f"{kind} needs values")
        test, fault = one_of(df, name, list(values))
        return (~test if kind == "not_in" else test), fault
    if kind not in (*ORDERS, "eq", "neq", "between"):
        raise ValueError(f"condition {kind!r} is not allowed")
    if value is None or (kind == "between" and value2 is None):
        raise ValueError(f"{kind} needs a value")
    if kind in ORDERS:
        return ordered(df, name, kind, value)
    if kind == "between":
        low, fault = ordered(df, name, "gte", value)
        high, more = ordered(df, name, "lte", value2)
        return low & high, fault | more
    test, fault = equals(df, name, value)
    return (~test if kind == "neq" else test), fault
