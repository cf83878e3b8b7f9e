"""The canonical frame: filter, align sources on time, resolve keys, bucket time, aggregate.

One conditional aggregation per set of keys that sources share. A late value of a ``past_only``
measure moves to the bucket of its arrival: every row is copied once for its event and, if it
arrived in a later bucket, once for its arrival, and each measure reads one of the copies. Sources
that lack a key are aggregated by the keys they have and joined to the others' rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import coerce, dates, registered
from tallyframe.functions.scratch import free_names, materialise
from tallyframe.operators.filters import predicate, pushed
from tallyframe.operators.history import of_sources
from tallyframe.operators.ordering import positions
from tallyframe.plans.spec import Key, Measure, Spec, resolve

#: Rows of an alias table that go to every task.
BROADCAST_ALIASES = 200_000
#: Classes of a label that ``meta`` lists.
LISTED_CLASSES = 10_000

_SRC, _ORD, _EVENT, _ARRIVAL, _FORWARD, _DROP = "__src", "__ord", "__event", "__arrival", "__forward", "__drop"


def tag_sources(sources: dict[str, DataFrame]) -> tuple[DataFrame, str]:
    """Tables by source id as one table, and the name of the column that holds the id: one that no table has."""
    taken = reduce(lambda a, b: a + [c for c in b.columns if c not in a], sources.values(), [])
    tag = "source"
    while tag.lower() in {c.lower() for c in taken}:
        tag += "_"
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged), tag


def alias_table(key: str, table: DataFrame) -> DataFrame:
    """``value, replace_with`` of an alias table without nulls and repeats; two meanings of a value, and chains, are errors."""
    both = [F.trim(F.col(c).cast("string")).alias(c) for c in ("value", "replace_with")]
    clean = table.select(*both).where("value IS NOT NULL AND replace_with IS NOT NULL AND value <> replace_with").distinct()
    if twice := clean.groupBy("value").count().where("count > 1").head(1):
        raise ValueError(f"aliases of '{key}': '{twice[0]['value']}' has several replacements")
    chained = clean.alias("a").join(clean.alias("b"), F.col("a.replace_with") == F.col("b.value"), "left_semi").head(1)
    if chained:
        raise ValueError(f"aliases of '{key}': '{chained[0]['value']}' becomes '{chained[0]['replace_with']}', which is replaced itself")
    return clean


def _with_aliases(rows: DataFrame, s: Spec, tables: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, str]]:
    """Rows with a column of replacements for each key that has an alias table, and these columns' names by key.

    A table of up to BROADCAST_ALIASES rows goes to every task, and so do the aliases that occur if only these are so few;
    beyond that both sides are shuffled, and hot values are split as they are read.
    """
    replaced = {}
    for name, table in tables.items():
        key = next((k for k in s.keys if k.name == name and k.returns == "raw"), None)
        if key is None:
            raise ValueError(f"aliases: '{name}' is no key that is read from a column as it is")
        value, other = free_names(rows, "value", "replace_with")
        rows = rows.withColumn(value, coerce.text(coerce.cell(rows, key.column)))
        own = table.select(F.col("value").alias(value), F.col("replace_with").alias(other))
        if own.limit(BROADCAST_ALIASES + 1).count() > BROADCAST_ALIASES:
            own = materialise(own.join(rows.select(value).distinct(), value, "left_semi"), "aliases")
        small = own.limit(BROADCAST_ALIASES + 1).count() <= BROADCAST_ALIASES
        rows = rows.join(F.broadcast(own) if small else own, value, "left").drop(value)
        replaced[name] = other
    return rows, replaced


def _key_column(rows: DataFrame, key: Key, event: str, place: str, replaced: dict[str, str]) -> Column:
    """The value that rows are grouped by: a bucket's first day, a number, or text."""
    if key.returns == "bucket":
        d = F.col(event) if key.spine else coerce.day(coerce.cell(rows, key.column), coerce.kind_of(rows, key.column))
        return dates.bucket_start(key.grain, d)
    if key.returns == "scalar":
        return dates.SCALARS[key.via](coerce.day(coerce.cell(rows, key.column), coerce.kind_of(rows, key.column)))
    if key.returns == "position":
        return F.concat(F.lit(key.prefix), F.lit("r"), F.when(F.col(place) < 1_000_000, F.lpad(F.col(place).cast("string"), 6, "0")).otherwise(F.col(place).cast("string")))
    value = coerce.text(coerce.cell(rows, key.column))
    if key.name in replaced:
        value = F.coalesce(F.col(replaced[key.name]), value)
    if key.aliases:
        pairs = F.create_map(*(F.lit(x) for pair in dict(key.aliases).items() for x in pair))
        value = F.coalesce(F.try_element_at(pairs, value), value)
    return F.concat(F.lit(key.prefix), value) if key.prefix else value


def _aggregate(m: Measure, order: bool) -> Column:
    v = F.col(f"__v_{m.out}")
    if m.function in registered.AGGREGATES:
        return registered.over_rows(m.function, v, F.col(f"__e_{m.out}") if m.entity else F.lit(None).cast("string"))
    if m.function in ("sum", "min", "max"):
        return getattr(F, m.function)(v)
    if m.function == "mean":
        return F.avg(v)
    if m.function == "count":
        return F.nullif(F.count(v), F.lit(0)).cast("double")
    if m.function == "label":
        return F.mode(v, True)
    by = F.when(v.isNotNull(), F.col(_ORD))
    return (F.min_by if m.function == "first" else F.max_by)(v, by)


@dataclass
class Frame:
    """A frame's rows and, on demand, what happened on the way."""

    spec: Spec
    df: DataFrame
    _everything: Callable[[], DataFrame]
    _unmatched: DataFrame | None
    #: For each label measure: ``id, name`` of its classes.
    classes: dict[str, DataFrame]

    @cached_property
    def _rows(self) -> DataFrame:
        return self._everything()

    def sorted(self) -> DataFrame:
        """Rows in key order. Bucket labels sort as their days do."""
        return self.df.orderBy(*(k.name for k in self.spec.keys))

    def drop_counts(self) -> DataFrame:
        """``reason, rows`` for rows that no bucket took: the first of the reasons that holds."""
        return self._rows.where(F.col(_DROP).isNotNull()).groupBy(F.col(_DROP).alias("reason")).agg(F.count("*").alias("rows"))

    @cached_property
    def meta(self) -> dict:
        """Counts and ranges, from one pass over the rows and one over the frame.

        A label with more than ``LISTED_CLASSES`` classes has only their number here; ``classes`` holds them all.
        """
        s, df = self.spec, self.df
        spine = s.spine
        others = [k.name for k in s.keys if not k.spine]
        aggs = [F.count("*").alias("frame_rows"), *(F.count_if(F.col(f"`{m.out}`").isNull()).alias(f"null_{i}") for i, m in enumerate(s.measures))]
        aggs.append((F.count_distinct(F.struct(*others)) if others else F.least(F.count("*"), F.lit(1))).alias("series"))
        if spine:
            aggs += [F.min(spine.name).alias("t_min"), F.max(spine.name).alias("t_max")]
        f = df.agg(*aggs).first()
        moved = [F.count_if(F.col(_DROP).isNull() & F.col(f"__v_{m.out}").isNotNull() & (F.col(_ARRIVAL) > F.col(_EVENT))) for m in s.measures if m.availability == "past_only"]
        bad = [F.count_if(F.col(_DROP).isNull() & F.col(f"__bad_{m.out}")) for m in s.measures if f"__bad_{m.out}" in self._rows.columns]
        r = self._rows.agg(F.count("*").alias("rows_in"), sum(moved, F.lit(0)).alias("refiled"), sum(bad, F.lit(0)).alias("bad_measure")).first()
        dropped = dict.fromkeys(("not_a_row", "unknown_source", "filtered", "bad_time"), 0) | {x["reason"]: x["rows"] for x in self.drop_counts().collect()} | {"bad_measure": r["bad_measure"]}
        out = {
            "rows_in": r["rows_in"], "rows_dropped": dropped, "frame_rows": f["frame_rows"], "series_count": f["series"] if f["frame_rows"] else 0,
            "t_key": spine.name if spine else None, "t_min": f["t_min"] if spine else None, "t_max": f["t_max"] if spine else None, "grain": spine.grain if spine else "",
            "keys": [k.name for k in s.keys], "measures": [m.out for m in s.measures], "derived": [d.out for d in s.derives], "warnings": list(s.warnings),
        }
        gaps = {m.out: f[f"null_{i}"] for i, m in enumerate(s.measures)}
        if any(gaps.values()):
            out["nulls_per_measure"] = {k: v for k, v in gaps.items() if v}
        if self.classes:
            found = {name: c.limit(LISTED_CLASSES + 1).collect() for name, c in self.classes.items()}
            out["classes"] = {name: {str(int(x["id"])): x["name"] for x in rows} for name, rows in found.items() if len(rows) <= LISTED_CLASSES}
            if len(out["classes"]) < len(found):
                out["class_counts"] = {name: self.classes[name].count() for name in found if name not in out["classes"]}
        if len(s.sources) > 1:
            out["join"] = {"on": "time", "gaps": gaps, "broadcast_unmatched": self._unmatched.count() if self._unmatched is not None else 0}
            out["sources"] = {x[_SRC]: x["count"] for x in self._rows.where(F.coalesce(F.col(_DROP) != "unknown_source", F.lit(True))).groupBy(_SRC).count().collect()}
        if any(x.available_from for x in s.sources):
            out["leakage"] = {"features_refiled_forward": r["refiled"]}
        if any(k.returns == "position" for k in s.keys):
            out["row_number_key"] = {"buckets": f["frame_rows"], "rows_kept": r["rows_in"] - sum(v for k, v in dropped.items() if k != "bad_measure"), "always_one": [m.out for m in s.measures if m.function == "count"]}
        return out


def _holding(table: DataFrame, s: Spec, source: str) -> list[Column]:
    """Conditions that the rows which a source's filters keep meet in its own table, as far as its scan can tell.

    Positions count rows before filters, so a spec that has them reads all rows.
    """
    if any(k.returns == "position" for k in s.keys):
        return []
    own = [f for f in s.filters if f.source == source and not f.applied_upstream and f.column in table.columns]
    found = [pushed(coerce.cell(table, f.column), coerce.kind_of(table, f.column), f.operator, f.value) for f in own]
    return [holds for holds in found if holds is not None]


def _pruned(table: DataFrame, s: Spec, source: str) -> DataFrame:
    """A source's own table without the rows that its filters drop."""
    return reduce(lambda df, holds: df.where(holds), _holding(table, s, source), table)


def _with_histories(rows: DataFrame | dict[str, DataFrame], s: Spec) -> tuple[DataFrame | dict[str, DataFrame], Callable[[], DataFrame | dict[str, DataFrame]]]:
    """Rows with the spec's row derives, and a function that gives those that filters drop as well: these are history, but have none."""
    derived = {d.source for d in s.row_derives}
    holding = {} if s.source_from else {x.id: _holding(rows[x.id] if isinstance(rows, dict) else rows, s, x.id) for x in s.sources if x.id in derived and (not isinstance(rows, dict) or x.id in rows)}
    asked = {name: reduce(and_, conditions) for name, conditions in holding.items() if conditions}
    least = of_sources(rows, s.row_derives, s.sources, s.source_from, asked)
    return least, (lambda: of_sources(rows, s.row_derives, s.sources, s.source_from)) if asked else (lambda: least)


def _prepared(rows: DataFrame, s: Spec, tag: str, also: tuple[str, ...] = (), replaced: dict[str, str] | None = None) -> DataFrame:
    """Rows with reasons for dropping, clocks, keys and measure inputs; columns of ``also`` as ``__also0`` and on.

    What is computed beside the rows' own columns has names that these don't have.
    """
    place, passes_name, event, arrival = free_names(rows, "place", "passes", "event", "arrival")
    if s.order_by:
        rows = positions(rows, s.order_by, place) if any(k.returns == "position" for k in s.keys) else rows.withColumn(place, F.col(f"`{s.order_by}`"))
    src = F.col(tag)
    kind = lambda name: coerce.kind_of(rows, name)
    passes = F.lit(True)
    for f in s.filters:
        if not f.applied_upstream:
            passes = passes & ((src != f.source) | predicate(coerce.cell(rows, f.column), kind(f.column), f.operator, f.value))

    def by_source(column) -> Column:
        out = F.lit(None).cast("date")
        for x in s.sources:
            if column(x):
                out = F.when(src == x.id, coerce.day(coerce.cell(rows, column(x)), kind(column(x)))).otherwise(out)
        return out

    rows = rows.withColumn(passes_name, passes)
    spine = s.spine
    if spine:
        rows = rows.withColumn(event, dates.bucket_start(spine.grain, by_source(lambda x: x.time_from)))
        rows = rows.withColumn(arrival, F.coalesce(dates.bucket_start(spine.grain, by_source(lambda x: x.available_from)), F.col(event)))
    else:
        rows = rows.withColumns({event: F.lit(None).cast("date"), arrival: F.lit(None).cast("date")})
    owned = {i: F.when(src == k.source, _key_column(rows, k, event, place, replaced or {})) if k.source is not None else _key_column(rows, k, event, place, replaced or {}) for i, k in enumerate(s.keys)}
    bad = F.lit(False)
    for i, k in enumerate(s.keys):
        if k.returns in ("bucket", "scalar"):
            bad = bad | (owned[i].isNull() & ((src == k.source) if k.source is not None else F.lit(True)))
    known = src.isin([x.id for x in s.sources])
    drop = F.when(~F.coalesce(known, F.lit(False)), "unknown_source").when(~F.col(passes_name), "filtered").when(bad, "bad_time")
    columns = {f"__k{i}": c for i, c in owned.items()} | {_DROP: drop}
    for m in s.measures:
        c, own = coerce.cell(rows, m.column), src == m.source
        if m.function == "count" and not m.column:
            value = F.lit(1.0)
        elif m.function == "label":
            value = F.nullif(coerce.text(c), F.lit(""))
        else:
            value = coerce.number(c, kind(m.column))
            columns[f"__bad_{m.out}"] = own & value.isNull() & (coerce.text(c) != "")
        columns[f"__v_{m.out}"] = F.when(own, value)
        if m.entity:
            columns[f"__e_{m.out}"] = coerce.text(coerce.cell(rows, m.entity))
    keep = {tag: _SRC, event: _EVENT, arrival: _ARRIVAL} | ({place: _ORD} if s.order_by else {})
    return rows.select(*(F.col(f"`{c}`").alias(n) for c, n in keep.items()), *(F.col(f"`{c}`").alias(f"__also{i}") for i, c in enumerate(also)), *(c.alias(n) for n, c in columns.items()))


def _copies(rows: DataFrame, s: Spec) -> DataFrame:
    """A copy for the event and, where a late value may move, one for the arrival."""
    late = [m for m in s.measures if m.availability == "past_only"]
    if not (s.spine and late and any(x.available_from for x in s.sources)):
        return rows
    moves = F.col(_ARRIVAL) > F.col(_EVENT)
    here, there = F.struct(F.col(_EVENT).alias("t"), F.lit(False).alias("f")), F.struct(F.col(_ARRIVAL).alias("t"), F.lit(True).alias("f"))
    rows = rows.withColumn("__copy", F.explode(F.when(moves, F.array(here, there)).otherwise(F.array(here)))).withColumn(_FORWARD, F.col("__copy.f"))
    for i, k in enumerate(s.keys):
        if k.spine:
            rows = rows.withColumn(f"__k{i}", F.col("__copy.t"))
    for m in s.measures:
        own = F.col(_FORWARD) == moves if m.availability == "past_only" else ~F.col(_FORWARD)
        rows = rows.withColumn(f"__v_{m.out}", F.when(own, F.col(f"__v_{m.out}")))
    return rows


def _reduced(rows: DataFrame, keys: list[str], measures: list[Measure], order: bool) -> DataFrame:
    """One row for each bucket. Group functions first sum by entity."""
    plain = [m for m in measures if m.function not in ("hhi", "top_share")]
    aggs = [_aggregate(m, order).alias(f"__m_{m.out}") for m in plain]
    shared: dict[tuple, list[Measure]] = {}
    for m in measures:
        if m not in plain:
            shared.setdefault((m.column, m.entity, m.availability, m.source), []).append(m)
    out = None
    if aggs or not shared:
        out = rows.groupBy(*keys).agg(*(aggs or [F.lit(None).cast("double").alias("__none")]))
    for group in shared.values():
        lead = group[0].out
        have = F.col(f"__v_{lead}").isNotNull()
        nets = rows.groupBy(*keys, F.when(have, F.col(f"__e_{lead}")).alias("__e")).agg(F.sum(f"__v_{lead}").alias("__net"), F.count_if(have).alias("__n"))
        net = F.when(F.col("__n") > 0, F.col("__net"))  # buckets without a value stay, as null
        total = F.sum(net)
        how = {"hhi": 10_000 * F.sum(net * net) / (total * total), "top_share": 100 * F.max(net) / total}
        parts = nets.groupBy(*keys).agg(*(F.when(total > 0, how[m.function]).alias(f"__m_{m.out}") for m in group))
        out = parts if out is None else out.join(parts, keys, "left")
    return out


def kept_rows(rows: DataFrame | dict[str, DataFrame], s: Spec, aliases: dict[str, DataFrame] | None = None) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """The rows that buckets are made of, and a function that gives all rows with the reasons for dropping them."""
    tables = {name: alias_table(name, table) for name, table in (aliases or {}).items()}
    if not isinstance(rows, dict) and not s.source_from and len(s.sources) > 1:
        raise ValueError("source_from: needed with several sources in one table")
    rows, all_rows = _with_histories(rows, s)

    def tagged(rows: DataFrame | dict[str, DataFrame], of_source: Callable[[DataFrame, Spec, str], DataFrame]) -> tuple[DataFrame, str]:
        if isinstance(rows, dict):
            return tag_sources({name: of_source(df, s, name) for name, df in rows.items()})
        (tag,) = free_names(rows, "source")
        if s.source_from:
            return rows.withColumn(tag, coerce.text(coerce.cell(rows, s.source_from))), tag
        return of_source(rows, s, s.sources[0].id).withColumn(tag, F.lit(s.sources[0].id)), tag

    counted = any(k.returns == "position" for k in s.keys)

    def with_reasons(table: DataFrame, tag: str) -> DataFrame:
        table, replaced = _with_aliases(table, s, tables)
        return _prepared(table, s, tag, replaced=replaced)

    prepared = with_reasons(*tagged(rows, _pruned))
    kept = _copies(prepared.where(F.col(_DROP).isNull()), s)
    one = counted or (bool(s.source_from) and not isinstance(rows, dict))
    everything = (lambda: prepared) if one else (lambda: with_reasons(*tagged(all_rows(), lambda df, _s, _name: df)))  # only counts of what was dropped need it
    return kept, everything


def build(rows: DataFrame | dict[str, DataFrame], document: dict | Spec, aliases: dict[str, DataFrame] | None = None) -> Frame:
    """The frame of a table, of tables by source id, or of one table tagged by ``source_from``.

    ``aliases`` has tables of ``value, replace_with`` by the name of a key, for dictionaries too large for the spec;
    they are looked up before the spec's own.
    """
    s = document if isinstance(document, Spec) else resolve(document)
    kept, everything = kept_rows(rows, s, aliases)
    names = [f"__k{i}" for i in range(len(s.keys))]

    groups: dict[tuple[int, ...], list[str]] = {}
    for x in s.sources:
        mask = tuple(i for i, k in enumerate(s.keys) if k.source is None or k.source == x.id)
        groups.setdefault(mask, []).append(x.id)
    parts = {}
    for mask, ids in groups.items():
        own = [m for m in s.measures if m.source in ids]
        part = kept if len(groups) == 1 else kept.where(F.col(_SRC).isin(ids))
        parts[mask] = _reduced(part, [names[i] for i in mask], own, bool(s.order_by)) if mask or own else None
    whole = tuple(range(len(names)))
    base, rest, unmatched = parts.pop(whole, None), {k: v for k, v in parts.items() if v is not None}, None
    if rest and (base is None or base.isEmpty()):
        base = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (v.withColumns({names[i]: F.lit("") for i in whole if i not in mask}) for mask, v in rest.items()))
    else:
        for mask, part in rest.items():
            on = [names[i] for i in mask]
            if on:
                gone = part.join(base.select(*on).distinct(), on, "left_anti").select(F.lit(1).alias("x"))
                base = base.join(part, on, "left")
            else:
                gone = part.select(F.lit(1).alias("x")).limit(0)
                base = base.crossJoin(F.broadcast(part))  # one row: a source without any key
            unmatched = gone if unmatched is None else unmatched.unionByName(gone)

    outs = {m.out: F.col(f"__m_{m.out}") if f"__m_{m.out}" in base.columns else F.lit(None).cast("string" if m.function == "label" else "double") for m in s.measures}
    found = base.where(F.coalesce(*(c.cast("string") for c in outs.values())).isNotNull())

    def label(i: int, k: Key) -> Column:
        c = F.col(names[i])
        if k.returns == "bucket":
            return dates.bucket_label(k.grain, c) if base.schema[names[i]].dataType.simpleString() == "date" else c
        return c

    values = [F.round(c, 6).alias(m.out) if m.function != "label" else c.alias(m.out) for m, c in zip(s.measures, outs.values(), strict=True)]
    scalars = [dates.SCALARS[d.via](F.col(names[d.key])).alias(d.out) for d in s.derives]
    df = found.select(*(label(i, k).alias(k.name) for i, k in enumerate(s.keys)), *values, *scalars)
    classes = {}
    for m in s.measures:
        if m.function == "label":
            distinct = df.select(F.col(f"`{m.out}`").alias("name")).where(F.col("name").isNotNull()).distinct()
            classes[m.out] = positions(distinct, "name", "id").withColumn("id", F.col("id").cast("double"))
            (place,) = free_names(df, "place")
            df = df.join(classes[m.out].select(F.col("name").alias(m.out), F.col("id").alias(place)), m.out, "left").withColumn(m.out, F.col(place)).drop(place)
    return Frame(s, df.select(*(F.col(f"`{c}`") for c in s.columns)), everything, unmatched, classes)
