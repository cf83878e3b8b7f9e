"""Calendar buckets and calendar numbers of a date column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket_start(grain: str, d: Column) -> Column:
    """First day of the day, ISO week, month, quarter or year of ``d``."""
    return d if grain == "day" else F.trunc(d, grain)


def bucket_label(grain: str, start: Column) -> Column:
    """Label of a bucket from its first day."""
    if grain == "week":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), start).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(start).cast("string"), 2, "0"))
    pattern = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "quarter": "yyyy-'Q'q", "year": "yyyy"}[grain]
    return F.date_format(start, pattern)


SCALARS = {
    "week_of_year": F.weekofyear,
    "month_of_year": F.month,
    "quarter_of_year": F.quarter,
    "day_of_week": lambda d: F.weekday(d) + 1,
    "year": F.year,
}


def next_start(grain: str, start: Column, steps: Column | int) -> Column:
    """First day of the bucket ``steps`` after that of ``start``; weeks run on past W53."""
    n = F.lit(steps) if isinstance(steps, int) else steps
    if grain in ("day", "week"):
        return F.date_add(start, (n * (7 if grain == "week" else 1)).cast("int"))
    return F.add_months(start, (n * {"month": 1, "quarter": 3, "year": 12}[grain]).cast("int"))


def index_of(grain: str, start: Column) -> Column:
    """A whole number that grows by one from bucket to bucket."""
    if grain in ("day", "week"):
        days = F.datediff(start, F.lit("1970-01-05").cast("date"))
        return days if grain == "day" else F.floor(days / 7).cast("int")
    months = F.year(start) * 12 + F.month(start) - 1
    return F.floor(months / {"month": 1, "quarter": 3, "year": 12}[grain]).cast("int")


def grain_of(label: Column) -> Column:
    """The grain whose labels look like ``label``; null for other text."""
    shapes = {"day": r"^\d{4}-\d{2}-\d{2}$", "week": r"^\d{4}-W\d{2}$", "month": r"^\d{4}-\d{2}$", "quarter": r"^\d{4}-Q\d$", "year": r"^\d{4}$"}
    text = label.cast("string")
    return F.coalesce(*(F.when(text.rlike(shape), F.lit(grain)) for grain, shape in shapes.items()))


def start_of(grain: str, label: Column) -> Column:
    """First day of a bucket from its label."""
    year = F.substring(label, 1, 4).cast("int")
    if grain == "day":
        return label.try_cast("date")
    if grain == "week":
        first = F.trunc(F.make_date(year, F.lit(1), F.lit(4)), "week")
        return F.date_add(first, (F.substring(label, 7, 2).cast("int") - 1) * 7)
    month = {"month": F.substring(label, 6, 2).cast("int"), "quarter": F.substring(label, 7, 1).cast("int") * 3 - 2, "year": F.lit(1)}[grain]
    return F.make_date(year, month, F.lit(1))
