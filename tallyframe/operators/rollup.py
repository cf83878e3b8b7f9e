"""Frames kept as states: built batch by batch, merged, and rolled up to coarser buckets, without the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import dates, registered
from tallyframe.operators.frame import kept_rows
from tallyframe.plans.spec import Spec, resolve

# The buckets that buckets of a grain nest in.
NESTS = {"day": ("day", "week", "month", "quarter", "year"), "week": ("week",), "month": ("month", "quarter", "year"), "quarter": ("quarter", "year"), "year": ("year",)}


def _checked(document: dict | Spec) -> Spec:
    s = document if isinstance(document, Spec) else resolve(document)
    if no := [m.out for m in s.measures if registered.algebraic(m.function) is None]:
        raise ValueError(f"states: {', '.join(no)} can't be merged of parts")
    if any(k.returns == "position" for k in s.keys):
        raise ValueError("states: positions count the rows of one table")
    if len({k.source for k in s.keys if not k.spine}) > 1 or (len(s.sources) > 1 and any(not k.spine for k in s.keys)):
        raise ValueError("states: every source needs every key")
    return s


def states(rows: DataFrame | dict[str, DataFrame], document: dict | Spec) -> DataFrame:
    """A row for each bucket: its keys, buckets of time as their first day, and the states of each measure as ``<out>__<state>``.

    One shuffle, combined before it. Late values are filed by the batch that brings them, so states of
    several batches, merged, are those of all their rows.
    """
    s = _checked(document)
    kept, _ = kept_rows(rows, s)
    parts = []
    for m in s.measures:
        value = F.col(f"__v_{m.out}")
        by = F.col(f"__e_{m.out}") if m.entity else F.lit(None).cast("string")
        parts += [c.alias(f"{m.out}__{name}") for name, c in registered.states_of(m.function, value, by).items()]
        parts.append(F.count(value).alias(f"{m.out}__values"))
    return kept.groupBy(*(F.col(f"__k{i}").alias(k.name) for i, k in enumerate(s.keys))).agg(*parts)


def merged(tables: DataFrame, document: dict | Spec, grain: str = "") -> DataFrame:
    """The frame of states, whichever batches they come from, with buckets of ``grain`` instead of the spec's if it says so."""
    s = _checked(document)
    if grain and (s.spine is None or grain not in NESTS[s.spine.grain]):
        raise ValueError(f"states: buckets don't nest in those of '{grain}'")

    def start(k):
        return dates.bucket_start(grain, F.col(f"`{k.name}`")) if grain and k.spine else F.col(f"`{k.name}`")

    merges, counts = [], []
    for m in s.measures:
        merges += [f(F.col(f"`{m.out}__{name}`")).alias(f"{m.out}__{name}") for name, f in registered.algebraic(m.function).merge.items()]
        counts.append(F.sum(f"`{m.out}__values`").alias(f"{m.out}__values"))
    names = [f"__k{i}" for i in range(len(s.keys))]
    whole = tables.groupBy(*(start(k).alias(n) for n, k in zip(names, s.keys, strict=True))).agg(*merges, *counts)

    def value(m):
        a = registered.algebraic(m.function)
        done = a.finish({name: F.col(f"`{m.out}__{name}`") for name in a.merge}).cast("double")
        return F.round(F.when(F.col(f"`{m.out}__values`") > 0, done), 6)

    labels = [(dates.bucket_label(grain if grain and k.spine else k.grain, F.col(n)) if k.returns == "bucket" else F.col(n)).alias(k.name) for n, k in zip(names, s.keys, strict=True)]
    found = whole.select(*labels, *(value(m).alias(m.out) for m in s.measures), *(dates.SCALARS[d.via](F.col(names[d.key])).alias(d.out) for d in s.derives))
    return found.where(F.coalesce(*(F.col(f"`{m.out}`") for m in s.measures)).isNotNull())
