"""Row predicates; none of them gives null, so negation keeps what it should."""

from __future__ import annotations

import datetime as dt
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.coerce import number

#: Whole numbers below this are the same as doubles.
_EXACT = 2.0**53


def _number(value: object) -> float | None:
    if isinstance(value, bool | int | float):
        return float(value)
    try:
        return float(str(value).strip().replace(",", "").lstrip("$"))
    except ValueError:
        return None


def predicate(c: Column, kind: T.DataType, operator: str, value: object) -> Column:
    have = c.cast("string")
    if operator in ("isEmpty", "isNotEmpty"):
        empty = F.coalesce(F.trim(have), F.lit("")) == ""
        return empty if operator == "isEmpty" else ~empty
    if operator == "contains":
        if value is None:
            return F.lit(False)
        truthy = F.when(c.cast("double") == 0, F.lit("")).otherwise(have) if isinstance(kind, T.NumericType) else have
        return F.contains(F.lower(F.coalesce(truthy, F.lit(""))), F.lower(F.lit(str(value))))
    want, n = _number(value), number(c, kind)
    if operator in ("equals", "notEquals"):
        same = F.coalesce(have, F.lit("None")) == F.lit("None" if value is None else str(value))
        if want is not None:
            same = F.when(n.isNotNull(), n == F.lit(want)).otherwise(same)
        return same if operator == "equals" else ~same
    if want is None:
        return F.lit(False)
    return F.coalesce(n > F.lit(want) if operator == "greaterThan" else n < F.lit(want), F.lit(False))


def _pushed_number(c: Column, kind: T.DataType, operator: str, want: float) -> Column | None:
    if isinstance(kind, T.DoubleType):
        value = F.lit(want)
    elif isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType) and abs(want) < _EXACT:
        if operator in ("equals", "notEquals") and want != int(want):
            return None
        value = F.lit(math.ceil(want) if operator == "lessThan" else math.floor(want))
    else:
        return None
    if operator == "notEquals":
        return c.isNull() | (c != value)
    return {"equals": c == value, "greaterThan": c > value, "lessThan": c < value}[operator]


def pushed(c: Column, kind: T.DataType, operator: str, value: object) -> Column | None:
    """A bare comparison that all rows of ``predicate`` meet and that a scan can check; None where there is none.

    For numbers and text it is the predicate itself; for empty cells and parts of text it says which nulls can't pass.
    """
    want = _number(value)
    numeric = isinstance(kind, T.NumericType)
    if operator in ("isEmpty", "isNotEmpty"):
        if operator == "isNotEmpty":
            return c.isNotNull()
        return None if isinstance(kind, T.StringType) else c.isNull()
    if operator == "contains":
        return c.isNotNull() if value not in (None, "") else None
    if numeric and want is not None and math.isfinite(want):
        return _pushed_number(c, kind, operator, want)
    if operator in ("greaterThan", "lessThan"):
        return F.lit(False) if want is None or isinstance(kind, T.DateType) else None
    if want is not None or value in (None, "None"):
        return None
    if isinstance(kind, T.StringType):
        same = c == F.lit(str(value))
    elif isinstance(kind, T.DateType) and re.fullmatch(r"[1-9]\d{3}-\d{2}-\d{2}", str(value)):
        try:
            same = c == F.lit(dt.date.fromisoformat(str(value)))
        except ValueError:
            return F.lit(False) if operator == "equals" else None
    else:
        return None
    return same if operator == "equals" else c.isNull() | ~same
