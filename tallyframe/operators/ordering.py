"""Ranks over whole tables without sorting them in one task: rows are dealt out by ranges of their order.

Ranges are cut at values of the whole sort key, taken from the ``SAMPLE`` rows whose keys hash lowest; text
with a common beginning and numbers with many ties are cut like any others, the latter by the columns after
them. A table of fewer rows than the sample is one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.scratch import free_names

#: Rows that cuts are chosen from, at most; they pass through the driver.
SAMPLE = 4096


def _key(df: DataFrame, order: list[str]) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in order))


def cuts(df: DataFrame, order: list[str]) -> list[tuple]:
    """Values of the sort key that divide the table into about as many equal ranges as there are shuffle partitions."""
    keys = df.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(order)))
    whole = [f"k{i}" for i in range(len(order))]
    found = keys.orderBy(F.xxhash64(*whole), *whole).limit(SAMPLE).orderBy(*whole).collect()
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if len(found) < SAMPLE:
        return []
    places = sorted({k * SAMPLE // n for k in range(1, n)} - {0})
    return sorted_distinct([tuple(found[at]) for at in places])


def sorted_distinct(keys: list[tuple]) -> list[tuple]:
    """Neighbours that are equal once."""
    return [k for i, k in enumerate(keys) if not i or k != keys[i - 1]]


def range_of(df: DataFrame, order: list[str], at: list[tuple]) -> Column:
    """The number of the range a row lies in: how many cuts are not above its key, found by halving."""
    key = _key(df, order)

    def value(cut: tuple) -> Column:
        return F.struct(*(F.lit(v).cast(df.schema[c].dataType).alias(c) for v, c in zip(cut, order, strict=True)))

    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < value(at[middle]), within(low, middle)).otherwise(within(middle + 1, high))

    return within(0, len(at))


def running_before(df: DataFrame, order: str | list[str], amount: str, out: str) -> DataFrame:
    """``df`` with the sum of ``amount`` over all rows that come before in the order of ``order``; nulls come first."""
    order = [order] if isinstance(order, str) else order
    at = cuts(df, order)
    (place,) = free_names(df, "range")
    ranged = df.withColumn(place, range_of(df, order, at))
    offset = F.lit(0)
    if at:
        sums = {r[0]: r[1] for r in ranged.groupBy(place).agg(F.sum(amount)).collect()}
        starts, before = [], 0
        for k in range(len(at) + 1):
            starts.append(F.lit(before))
            before += sums.get(k) or 0
        offset = F.get(F.array(*starts), F.col(place))
    within = Window.partitionBy(place).orderBy(*(F.col(f"`{c}`") for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.withColumn(out, (offset + F.coalesce(F.sum(amount).over(within), F.lit(0))).cast("long")).drop(place)


def positions(df: DataFrame, order_by: str | list[str], out: str) -> DataFrame:
    """``df`` with the 0-based position of each row in the order of columns that together are unique."""
    (one,) = free_names(df, "one")
    return running_before(df.withColumn(one, F.lit(1)), order_by, one, out).drop(one)
