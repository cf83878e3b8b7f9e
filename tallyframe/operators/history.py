"""What was known of a row's past when it happened: rolling values and the last one, without rows that had not arrived.

A row counts for others of its group from its arrival on, until its window has passed. So each row is a
step up, a step down for each window, and a question; answers are running totals over the steps in time.
Only steps that change something are made: rows that arrive after their windows, say, are questions alone.
Rows are shuffled once, by group, and become steps in the task that runs their totals. A group of more than
``GROUP`` rows is spread over blocks of time instead: its steps are shuffled, and totals start from those of the
blocks before. No rows are joined with rows.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import coerce
from tallyframe.functions.scratch import materialise
from tallyframe.plans.catalogs import ROW_DERIVES
from tallyframe.plans.spec import RowDerive

_DAY = 86_400_000_000
_EXACT = "decimal(28,6)"
#: Rows of a group whose history is computed in one task, at most.
GROUP = 200_000
#: Rows that are dealt to one task, about.
ROWS_A_TASK = 100_000


def _moment(rows: DataFrame, name: str) -> Column:
    """Microseconds of a clock; text is read as a day."""
    c, kind = coerce.cell(rows, name), coerce.kind_of(rows, name)
    when = c if isinstance(kind, T.TimestampType | T.TimestampNTZType) else coerce.day(c, kind)
    return F.unix_micros(when.cast("timestamp"))


def with_history(rows: DataFrame, features: list[RowDerive], event: str, arrival: str = "", block_days: int = 1, asked: Column | None = None) -> DataFrame:
    """``rows`` with a column for each feature.

    A feature of a row sees rows of equal ``by`` that happened before it, at most ``days`` earlier, and had arrived
    by its own time; without an arrival a row arrives as it happens. ``rolling_sum`` and ``rolling_mean`` are null
    where nothing is seen, ``rolling_count`` is 0; ``last_value`` is that of the latest seen row (of equally late
    ones the largest) and looks back over everything if it has no ``days``. Cells that are no number, or not below
    1e22, aren't seen; sums are exact to six places. Rows without a time keep their place, with nulls. Rows for which
    ``asked``, a condition on columns of ``rows``, doesn't hold are seen by others and left out.
    """
    out, groups = rows, list(dict.fromkeys(f.by for f in features))
    for by in groups:
        out = _for_group(out, [f for f in features if f.by == by], by, event, arrival, block_days, asked if by == groups[-1] else None)
    return out if groups or asked is None else out.where(asked)


def _for_group(rows: DataFrame, features: list[RowDerive], by: tuple[str, ...], event: str, arrival: str, block_days: int, asked: Column | None) -> DataFrame:
    if clash := {f.out.lower() for f in features} & {c.lower() for c in rows.columns}:
        raise ValueError(f"row derives: the table has a column '{sorted(clash)[0]}'")
    for f in features:
        if f.via not in ROW_DERIVES:
            raise ValueError(f"row derives: unknown '{f.via}'")
    e = _moment(rows, event)
    a = F.greatest(e, _moment(rows, arrival)) if arrival else e
    texts = [coerce.text(coerce.cell(rows, c)) for c in by] or [F.lit("")]
    g = texts[0] if len(texts) == 1 else F.to_json(F.array(*texts))

    def value(f: RowDerive) -> Column:
        x = coerce.number(coerce.cell(rows, f.column), coerce.kind_of(rows, f.column))
        return F.when(F.abs(x) < 1e22, F.lit(True) if f.via == "rolling_count" else x.cast(_EXACT))

    own = [f"c{i}" for i in range(len(rows.columns))]
    asks = F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))
    work = rows.select(g.alias("g"), e.alias("e"), a.alias("a"), asks.alias("q"), *(F.col(f"`{c}`").alias(n) for c, n in zip(rows.columns, own, strict=True)), *(value(f).alias(f"v{i}") for i, f in enumerate(features)))
    e, a = F.col("e"), F.col("a")
    nothing, no_last = F.lit(0).cast(_EXACT), F.lit(None).cast(f"struct<at:bigint,v:{_EXACT}>")
    totals = [c for i, f in enumerate(features) for c in {"last_value": [f"l{i}"], "rolling_count": [f"n{i}"]}.get(f.via, [f"s{i}", f"n{i}"])]
    ends = sorted({f.days for f in features if f.via != "last_value"})

    def seen(i: int) -> Column:
        """Whether any question can see the row: it has a value and a time, and arrives before its window has passed."""
        days = features[i].days
        return F.col(f"v{i}").isNotNull() & (a <= e + F.lit(days * _DAY) if days else e.isNotNull())

    def any_seen(days: int = 0) -> Column:
        return reduce(or_, (seen(i) for i, f in enumerate(features) if not days or (f.days == days and f.via != "last_value")))

    def steps(of: DataFrame) -> DataFrame:
        """Up, down at the end of each window, and a question, with what each feature adds to the running totals there.

        What arrives late is seen at once (kind 0), what happens now only after the question (kind 1).
        """
        kinds = [(F.col("q"), e, F.lit(1), 0), (any_seen(), a, F.when(a > e, 0).otherwise(2), -1), *((any_seen(d), e + F.lit(d * _DAY), F.lit(2), d) for d in ends)]
        moves = F.array(*(F.when(needed, F.struct(at.alias("at"), kind.alias("kind"), F.lit(step).alias("step"))) for needed, at, kind, step in kinds))
        each = of.withColumn("x", F.explode(moves)).where(F.col("x").isNotNull())
        step, parts = F.col("x.step"), []
        for i, f in enumerate(features):
            v = F.col(f"v{i}")
            if f.via == "last_value":
                parts.append(F.when((step == -1) & seen(i), F.struct(e.alias("at"), v.alias("v"))).otherwise(no_last).alias(f"l{i}"))
                continue
            sign = F.when(seen(i) & (step == -1), 1).when(seen(i) & (step == f.days), -1).otherwise(0)
            if f.via != "rolling_count":
                parts.append(F.when(sign == 1, v).when(sign == -1, -v).otherwise(nothing).cast(_EXACT).alias(f"s{i}"))
            parts.append(sign.cast("long").alias(f"n{i}"))
        question = F.col("x.kind") == F.lit(1)
        return each.select("g", "x.at", "x.kind", *(F.when(question, F.col(c)).alias(c) for c in own), *parts)

    add = lambda c: F.max(c) if c.startswith("l") else F.sum(c)

    def answers(of: DataFrame, *parts: str) -> DataFrame:
        run = Window.partitionBy(*parts).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return of.select(*parts, "kind", *own, *(add(c).over(run).alias(c) for c in totals), "at").where("kind = 1")

    sizes = work.groupBy("g").agg(F.count("*").alias("n"))
    counted = sizes.agg(F.sum("n").alias("rows"), F.count_if(F.col("n") > GROUP).alias("large")).first()
    spread = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((counted["rows"] or 0) / ROWS_A_TASK))
    kinds = {"n": "long", "s": "decimal(38,6)", "l": f"struct<at:bigint,v:{_EXACT}>"}
    if asked is not None:
        work = work.where(F.col("q") | any_seen())
    small, large, nothing_before = work, None, [F.lit(None).cast(kinds[c[0]]).alias(f"b_{c}") for c in totals]
    if counted["large"]:  # a row for each GROUP rows at most
        hot = F.broadcast(materialise(sizes.where(F.col("n") > GROUP).select("g"), "history-large"))
        small, large = work.join(hot, "g", "left_anti"), steps(work.join(hot, "g", "left_semi"))
    asked = answers(steps(small.repartition(spread, "g")), "g").select("at", *own, *totals, *nothing_before)
    if large is not None:
        large = large.withColumn("block", F.coalesce(F.floor(F.col("at") / F.lit(block_days * _DAY)), F.lit(-(1 << 60))).cast("long"))
        blocks = large.groupBy("g", "block").agg(*(add(c).alias(c) for c in totals))
        earlier = Window.partitionBy("g").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.select("g", "block", *(add(c).over(earlier).alias(f"b_{c}") for c in totals))
        there = answers(large, "g", "block").join(blocks, ["g", "block"], "left")
        asked = asked.unionByName(there.select("at", *own, *totals, *(F.col(f"b_{c}").cast(kinds[c[0]]).alias(f"b_{c}") for c in totals)))

    def whole(c: str) -> Column:
        if c.startswith("l"):
            return F.greatest(F.col(c), F.col(f"b_{c}"))
        return F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"b_{c}"), F.lit(0))

    def answer(i: int, f: RowDerive) -> Column:
        if f.via == "last_value":
            last, far = whole(f"l{i}"), F.col("at") - F.lit(f.days * _DAY)
            found = last["v"] if not f.days else F.when(last["at"] >= far, last["v"])
        elif f.via == "rolling_count":
            found = whole(f"n{i}")
        else:
            total = whole(f"s{i}").cast("double")
            found = F.when(whole(f"n{i}") > 0, total if f.via == "rolling_sum" else total / whole(f"n{i}"))
        return F.when(F.col("at").isNotNull(), found.cast("double")).alias(f.out)

    return asked.select(*(F.col(n).alias(c) for n, c in zip(own, rows.columns, strict=True)), *(answer(i, f) for i, f in enumerate(features)))


def of_sources(rows: DataFrame | dict[str, DataFrame], derives: tuple[RowDerive, ...], sources: tuple, source_from: str, asked: dict[str, Column] | None = None) -> DataFrame | dict[str, DataFrame]:
    """Tables with the row derives of a spec: each source's own, or, in one table, apart by the column that tells sources.

    ``asked``: by a source's id, the condition on its rows that are to be in its table; not with ``source_from``.
    """
    asked = asked or {}
    if not derives:
        return rows
    place = {s.id: s for s in sources}
    if isinstance(rows, dict):
        return {name: with_history(df, [d for d in derives if d.source == name], place[name].time_from, place[name].available_from, asked=asked.get(name)) if name in place else df for name, df in rows.items()}
    if source_from:
        derives = tuple(RowDerive(d.out, d.via, d.source, d.column, (source_from, *d.by), d.days) for d in derives)
    return reduce(lambda df, s: with_history(df, [d for d in derives if d.source == s.id], s.time_from, s.available_from, asked=asked.get(s.id)), sources, rows)
