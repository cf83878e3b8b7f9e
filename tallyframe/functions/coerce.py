"""Type on use: numbers, days and text out of cells of any column type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed formats, tried in this order on the whole cell after the ISO prefix.
DAY_FORMATS = ("M/d/yyyy", "M/d/yy", "yyyyMMdd", "yyyy-M", "yyyy/M", "M/yyyy", "M-yyyy", "MMM yyyy", "MMMM yyyy", "d MMM yyyy", "d MMMM yyyy")

_NUMBER = r"(?i)^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|nan|inf(?:inity)?)$"


def kind_of(df: DataFrame, name: str) -> T.DataType:
    """Type of a column; a column that is not there reads as an empty string column."""
    return df.schema[name].dataType if name in df.columns else T.StringType()


def cell(df: DataFrame, name: str) -> Column:
    """A column by its plain name, dots included; null where the table lacks it."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def number(c: Column, kind: T.DataType) -> Column:
    """A double, or null where the cell is no number; text may have ``,`` and a leading ``$``."""
    if isinstance(kind, T.NumericType | T.BooleanType):
        return c.cast("double")
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(c.cast("string")), ",", ""), r"^\$+", ""))
    return F.when(bare.rlike(_NUMBER), bare.try_cast("double"))


def day(c: Column, kind: T.DataType) -> Column:
    """A date, or null; a bare year is none."""
    if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        return c.cast("date")
    s = F.trim(c.cast("string"))
    iso = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(s, 1, 10).try_cast("date"))
    return F.coalesce(iso, *(F.try_to_timestamp(s, F.lit(f)).cast("date") for f in DAY_FORMATS))


def text(c: Column) -> Column:
    """Trimmed text; null is empty."""
    return F.coalesce(F.trim(c.cast("string")), F.lit(""))
