"""Frame specs: checked once, then plain data that the frame operator turns into columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from tallyframe.plans.catalogs import DERIVES, FILTERS, ROW_DERIVES, functions, known


@dataclass(frozen=True)
class Source:
    id: str = ""
    time_from: str = ""
    available_from: str = ""


@dataclass(frozen=True)
class Key:
    """``source`` is None for the time spine and for positions, which every source supplies."""

    name: str
    via: str
    returns: str
    source: str | None
    column: str
    prefix: str = ""
    aliases: tuple[tuple[str, str], ...] = ()

    @property
    def spine(self) -> bool:
        return self.returns == "bucket" and self.source is None

    @property
    def grain(self) -> str:
        return self.via.removeprefix("bin:")


@dataclass(frozen=True)
class Measure:
    out: str
    function: str
    source: str
    column: str
    entity: str = ""
    availability: str = ""


@dataclass(frozen=True)
class Derive:
    out: str
    via: str
    key: int


@dataclass(frozen=True)
class RowDerive:
    """A column of a source's rows, from rows of equal ``by`` up to ``days`` before (0: any)."""

    out: str
    via: str
    source: str
    column: str
    by: tuple[str, ...] = ()
    days: int = 0


@dataclass(frozen=True)
class Filter:
    source: str
    column: str
    operator: str
    value: object
    applied_upstream: bool = False


@dataclass(frozen=True)
class Spec:
    sources: tuple[Source, ...]
    source_from: str
    keys: tuple[Key, ...]
    measures: tuple[Measure, ...]
    derives: tuple[Derive, ...]
    filters: tuple[Filter, ...]
    order_by: str = ""
    row_derives: tuple[RowDerive, ...] = ()
    warnings: tuple[str, ...] = field(default=(), compare=False)

    @property
    def spine(self) -> Key | None:
        return next((k for k in self.keys if k.spine), None)

    @property
    def columns(self) -> list[str]:
        return [*(k.name for k in self.keys), *(m.out for m in self.measures), *(d.out for d in self.derives)]


_FIELDS = {"keys", "aggregates", "derives", "filters", "validity", "time_from", "available_from", "sources", "source_from", "order_by"}
_FIELDS_OF = {
    "keys": {"name", "from", "via", "prefix", "aliases"},
    "aggregates": {"name", "using", "of", "by", "source", "availability", "out", "ord", "role"},
    "derives": {"name", "scope", "from", "via", "out", "ord", "availability", "of", "by", "days"},
    "filters": {"of", "using", "value", "applied_upstream", "column", "operator"},
    "sources": {"id", "time_from", "available_from"},
}


def _text(value: object) -> str:
    return "" if value is None else str(value).strip()


# What a flat spec may say, as a whole and in its parts.
_FLAT_FIELDS = {"sources", "source_from", "time_from", "available_from", "validity", "order_by", "series_from", "series_prefix", "series_aliases", "time_grain", "targets", "target_metric", "target_measure", "features", "filters"}
_FLAT_MEASURE = {"name", "fn", "metric", "measure", "entity", "source", "availability"}


def is_flat(document: dict) -> bool:
    """Whether a document is of the older dialect, which names neither keys nor aggregates."""
    return document.get("keys") is None and document.get("aggregates") is None


def flat_warnings(flat: dict) -> list[str]:
    """Fields that the flat dialect does not know."""
    found = [f"unknown field '{k}'" for k in flat if k not in _FLAT_FIELDS]
    for part in ("targets", "features"):
        known_here = _FLAT_MEASURE | ({"derive"} if part == "features" else set())
        found += [f"{part}[{i}]: unknown field '{k}'" for i, e in enumerate(flat.get(part) or []) for k in e if k not in known_here]
    return found


def translate_flat(flat: dict) -> dict:
    """The older flat dialect as a spec with the columns ``series_id, t``, its targets and ``x_<feature>``.

    Series are told apart by one column at most. A spec without targets has one, ``y``, of ``target_metric`` and
    ``target_measure``. Targets come before features, each in their own order, and features that are derived
    from the clock come last.
    """
    series = _text(flat.get("series_from"))
    keys = [{"name": "series_id", "from": series, "prefix": flat.get("series_prefix"), "aliases": flat.get("series_aliases")}] if series else []
    keys.append({"name": "t", "via": "bin:" + (_text(flat.get("time_grain")).lower() or "week")})

    def measure(entry: dict, out: str, default: str) -> dict:
        using = _text(entry.get("fn")) or _text(entry.get("metric")) or default
        return {"name": _text(entry.get("name")) or out, "out": out, "using": using, "of": entry.get("measure"), "by": entry.get("entity"), "source": entry.get("source"), "availability": entry.get("availability")}

    targets = flat.get("targets") or [{"name": "y", "fn": flat.get("target_metric"), "measure": flat.get("target_measure")}]
    aggregates, derives = [], []
    for i, entry in enumerate(targets):
        out = _text(entry.get("name")) or ("y" if len(targets) == 1 else "")
        if not out:
            raise ValueError(f"targets[{i}]: needs a name, as there are several")
        aggregates.append(measure(entry, out, "sum"))
    for i, entry in enumerate(flat.get("features") or []):
        name, via = _text(entry.get("name")), _text(entry.get("derive")).lower()
        if not name:
            raise ValueError(f"features[{i}]: needs a name")
        if via and _text(entry.get("measure")):
            raise ValueError(f"features[{i}]: '{name}' is measured or derived, not both")
        if via:
            derives.append({"name": name, "out": f"x_{name}", "from": "t", "via": via, "availability": entry.get("availability")})
        else:
            aggregates.append(measure(entry, f"x_{name}", "max"))
    filters = [{k: v for k, v in f.items() if k not in ("using", "operator")} | {"using": _text(f.get("using")) or _text(f.get("operator")) or "equals"} for f in flat.get("filters") or []]
    kept = ("sources", "source_from", "time_from", "available_from", "validity", "order_by")
    return {k: flat[k] for k in kept if k in flat} | {"keys": keys, "aggregates": aggregates, "derives": derives, "filters": filters}


def resolve(document: dict) -> Spec:
    """A checked spec; every error names the entry and what would be right."""
    flat = is_flat(document)
    p = translate_flat(document) if flat else document
    warnings = flat_warnings(document) if flat else [f"unknown field '{k}'" for k in p if k not in _FIELDS]
    for part, names in _FIELDS_OF.items():
        warnings += [f"{part}[{i}]: unknown field '{k}'" for i, e in enumerate(p.get(part) or []) for k in e if k not in names]
    raw_keys = p.get("keys") or []
    has_spine = any(_text(k.get("via")).startswith("bin:") and not _text(k.get("from")) for k in raw_keys)
    top_time = _text(p.get("time_from"))
    top_arrival = _text(p.get("available_from")) or _text((p.get("validity") or {}).get("arrival_from"))
    sources = tuple(Source(_text(s.get("id")), _text(s.get("time_from")) or top_time, _text(s.get("available_from")) or top_arrival) for s in p.get("sources") or []) or (Source("", top_time, top_arrival),)
    ids = [s.id for s in sources]
    multi = len(sources) > 1
    if len(set(ids)) != len(ids):
        raise ValueError("sources: ids must differ")
    if p.get("sources") and "" in ids:
        raise ValueError("sources: every source needs an id")
    if has_spine and (late := [s.id for s in sources if not s.time_from]):
        raise ValueError(f"time_from: needed by {', '.join(x or 'the source' for x in late)}")
    source_from = _text(p.get("source_from"))

    def place(name: object, what: str, own: str = "") -> tuple[str, str]:
        column = _text(name)
        head, _, rest = column.partition(".")
        if rest and head in ids:
            if own and own != head:
                raise ValueError(f"{what}: column of '{head}', but its source is '{own}'")
            return head, rest
        if own:
            return own, column
        if multi:
            raise ValueError(f"{what}: with several sources, name columns <source>.<column>, not '{column}'")
        return ids[0], column

    keys, taken = [], set()
    for i, k in enumerate(raw_keys):
        name, via, column = _text(k.get("name")), _text(k.get("via")), _text(k.get("from"))
        if not name or name in taken:
            raise ValueError(f"keys[{i}]: needs a name of its own")
        taken.add(name)
        returns = DERIVES[known(DERIVES, via, f"keys[{i}].via")] if via else "raw"
        shared = returns == "position" or (returns == "bucket" and not column)
        if not shared and not column:
            raise ValueError(f"keys[{i}]: needs 'from'; only a bin: key may do without, reading each source's clock")
        source, column = (None, "") if shared else place(column, f"keys[{i}]")
        aliases = tuple((str(a["value"]), str(a["replace_with"])) for a in k.get("aliases") or [] if a.get("value") is not None and a.get("replace_with") is not None)
        keys.append(Key(name, via, returns, source, column, str(k.get("prefix") or ""), aliases))
    if not keys:
        raise ValueError("keys: at least one is needed")
    if len({k.via for k in keys if k.spine}) > 1:
        raise ValueError("keys: the time spine has one grain")
    spine = next((k.name for k in keys if k.spine), "")

    ordered, outs = [], set()

    def claim(out: str, what: str) -> None:
        if out in taken:
            raise ValueError(f"{what}: '{out}' is a key column")
        if out in outs:
            raise ValueError(f"{what}: '{out}' is taken")
        outs.add(out)

    for i, a in enumerate(p.get("aggregates") or []):
        what = f"aggregates[{i}]"
        name = _text(a.get("name"))
        out = _text(a.get("out")) or name
        if not name:
            raise ValueError(f"{what}: needs a name")
        claim(out, what)
        function = known(functions(), _text(a.get("using")), f"{what}.using")
        needs = functions()[function][1]
        own = _text(a.get("source"))
        if own and own not in ids:
            raise ValueError(f"{what}: unknown source '{own}'")
        column = _text(a.get("of"))
        if "measure" in needs and not column:
            raise ValueError(f"{what}: {function} needs 'of'")
        if column:
            source, column = place(column, what, own)
        elif own or not multi:
            source = own or ids[0]
        else:
            raise ValueError(f"{what}: {function} over several sources needs 'source'")
        entity = ""
        if "entity" in needs:
            if not _text(a.get("by")):
                raise ValueError(f"{what}: {function} needs 'by'")
            entity = place(a["by"], what, source)[1]
        availability = _text(a.get("availability")).lower()
        if availability not in ("", "known_ahead", "past_only"):
            raise ValueError(f"{what}: availability is known_ahead or past_only, not '{availability}'")
        at = a.get("ord")
        ordered.append((i if at is None else int(at), Measure(out, function, source, column, entity, availability)))
    if not ordered:
        raise ValueError("aggregates: at least one is needed")

    derives, row_derives = [], []
    for i, d in enumerate(p.get("derives") or []):
        what = f"derives[{i}]"
        name, via = _text(d.get("name")), _text(d.get("via"))
        out = _text(d.get("out")) or name
        if not name:
            raise ValueError(f"{what}: needs a name")
        if _text(d.get("scope")) == "row":
            known(dict.fromkeys(ROW_DERIVES), via, f"{what}.via")
            if not _text(d.get("of")):
                raise ValueError(f"{what}: {via} needs 'of'")
            source, column = place(d["of"], what)
            if not next(s for s in sources if s.id == source).time_from:
                raise ValueError(f"{what}: needs the clock of its source")
            by = d.get("by") or []
            days = int(d.get("days") or 0)
            if days < 0 or (days == 0 and via != "last_value"):
                raise ValueError(f"{what}: {via} needs 'days', 1 at least")
            if any(r.out == out and r.source == source for r in row_derives):
                raise ValueError(f"{what}: '{out}' is taken")
            row_derives.append(RowDerive(out, via, source, column, tuple(place(b, what, source)[1] for b in ([by] if isinstance(by, str) else by)), days))
            continue
        claim(out, what)
        if _text(d.get("scope")) not in ("", "key"):
            raise ValueError(f"{what}: scope is key or row")
        if DERIVES[known(DERIVES, via, f"{what}.via")] != "scalar":
            raise ValueError(f"{what}: '{via}' gives no number")
        target = _text(d.get("from")) or spine
        at = next((j for j, k in enumerate(keys) if k.name == target), None)
        if at is None or keys[at].returns != "bucket":
            raise ValueError(f"{what}: 'from' must be a bin: key (known: {', '.join(k.name for k in keys if k.returns == 'bucket')})")
        derives.append((1000 + i if d.get("ord") is None else int(d["ord"]), Derive(out, via, at)))

    filters = []
    for i, f in enumerate(p.get("filters") or []):
        operator = known(FILTERS, _text(f.get("using") or f.get("operator")), f"filters[{i}].using")
        source, column = place(f.get("of") or f.get("column"), f"filters[{i}]")
        filters.append(Filter(source, column, operator, f.get("value"), bool(f.get("applied_upstream"))))
    order_by = _text(p.get("order_by"))
    needs_order = [m.out for _, m in ordered if m.function in ("first", "last")] + [k.name for k in keys if k.returns == "position"]
    if needs_order and not order_by:
        raise ValueError(f"order_by: needed by {', '.join(needs_order)}, as tables have no order of rows")
    by_ord = lambda rows: tuple(x for _, x in sorted(rows, key=lambda r: r[0]))
    return Spec(sources, source_from, tuple(keys), by_ord(ordered), by_ord(derives), tuple(filters), order_by, tuple(row_derives), tuple(warnings))
