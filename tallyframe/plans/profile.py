"""From a profile of logical names and a task to a frame spec and a run configuration.

A profile says how quantities are computed (``metrics``), which ``dimensions`` there are and what the
``task`` is; a binding says which column each logical name stands for. The spec never depends on
what the task predicts: that goes into the run configuration alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import coerce
from tallyframe.plans.catalogs import DERIVES, TASKS, check_task, functions, known


def _pointed(task: dict, pointer: str | None) -> list[str]:
    value = task.get(pointer) if pointer else None
    return [value] if isinstance(value, str) else list(value or [])


PARTS = ("clock", "keys", "target", "signal", "label", "covariates")


def _key_names(keys: list) -> list[str]:
    """Keys by name, or by the column or derive they come from; a bucket of time is the clock and no key."""
    named = [k if isinstance(k, str) else "" if DERIVES.get(k.get("via")) == "bucket" else k.get("from") or k.get("via") or "" for k in keys]
    return [k.strip() for k in named if k.strip()]


def lift_task(profile: dict) -> tuple[dict, bool]:
    """The task of a profile, and whether some of it was read from the older flat shape.

    There, ``kind`` (forecast if none), ``time`` and ``keys`` (or one ``x-deep`` series) stand at the
    top and every metric has the role of a target or feature. What a task says itself comes first.
    """
    own = profile.get("task")
    if own is None:
        own = {}
    if not isinstance(own, dict):
        raise ValueError("profile: task must be an object")
    if unknown := set(own) - {"kind", *PARTS}:
        raise ValueError(f"task: does not know {', '.join(sorted(unknown))}")
    kind = str(own.get("kind") or profile.get("kind") or "forecast").strip().lower()
    kind = {"anomaly": "detect_anomaly"}.get(kind, kind)
    task, pointer = {"kind": kind}, TASKS[known(TASKS, kind, "task kind")][4] or "target"
    said = {k: own[k] for k in PARTS if own.get(k) not in (None, "", [], {})}
    clock = said.get("clock") or profile.get("time")
    if clock:
        if not isinstance(clock, dict) or not clock.get("event"):
            raise ValueError("task: the clock needs an event")
        task["clock"] = clock
    series = (profile.get("x-deep") or profile.get("x_deep") or {}).get("series")
    keys = _key_names(said.get("keys") or profile.get("keys") or ([series] if series else []))
    if keys:
        task["keys"] = keys
    lifted = bool(clock) and "clock" not in said
    if pointed := {k: v for k, v in said.items() if k not in ("clock", "keys")}:
        return task | pointed, lifted
    if kind == "cluster" and "task" in profile:
        return task, lifted
    roles: dict[str, list] = {"target": [], "feature": []}
    for m in profile.get("metrics") or []:
        roles[known(tuple(roles), str(m.get("role") or "").strip().lower(), f"metric {m.get('name')}: role")].append(m)
    if roles["target"]:
        task[pointer] = [m["name"] for m in roles["target"]]
    if roles["feature"]:
        task["covariates"] = [{"metric": m["name"], "availability": m.get("availability") or "past_only"} for m in roles["feature"]]
    return task, True


def compile_profile(profile: dict, binding: dict, naming: str = "v1") -> tuple[dict, dict]:
    """``spec, run configuration``. Every logical name must be bound.

    ``v1`` names a single key ``series_id`` (several ``k_<dimension>``), the clock ``t``, a single
    target ``y`` and other columns ``x_<metric>``; ``logical`` keeps the profile's names.
    """
    task = check_task(lift_task(profile)[0])
    pointer = TASKS[task["kind"]][4]
    bind = binding.get("bind") or {}
    metrics = profile.get("metrics") or []
    names = [m.get("name") for m in metrics]
    targets = _pointed(task, pointer)
    if lost := [t for t in targets if t not in names]:
        raise ValueError(f"task {task['kind']}: {pointer} names no metric: {', '.join(lost)}")

    def column(logical: str, what: str) -> str:
        if logical not in bind:
            raise ValueError(f"{what}: '{logical}' is not bound to a column")
        return bind[logical]

    dimensions = {d if isinstance(d, str) else d["name"] for d in profile.get("dimensions") or []}
    keys, clock = [], task.get("clock")
    series = list(task.get("keys") or [])
    for k in series:
        if k not in dimensions:
            raise ValueError(f"task {task['kind']}: key '{k}' is no dimension")
        name = k if naming == "logical" else "series_id" if len(series) == 1 else f"k_{k}"
        keys.append({"name": name, "from": column(k, "keys")})
    spec: dict = {}
    if clock:
        if not clock.get("grain"):
            raise ValueError("task: the clock needs a grain")
        spec["time_from"] = column(clock["event"], "clock")
        keys.append({"name": "period" if naming == "logical" else "t", "via": f"bin:{clock['grain']}"})
    spec["keys"] = keys
    availability = {c["metric"]: c.get("availability") for c in task.get("covariates") or []}
    aggregates, outs = [], {}
    for m in metrics:
        function = known(functions(), m.get("function") or "", f"metric {m.get('name')}")
        out = m["name"] if naming == "logical" or (m["name"] in targets and len(targets) > 1) else "y" if m["name"] in targets else f"x_{m['name']}"
        outs[m["name"]] = out
        a = {"name": out, "using": function}
        if m.get("measure"):
            a["of"] = column(m["measure"], f"metric {m['name']}")
        if m.get("by"):
            a["by"] = column(m["by"], f"metric {m['name']}")
        if availability.get(m["name"]):
            a["availability"] = availability[m["name"]]
        aggregates.append(a)
    spec["aggregates"] = aggregates
    if profile.get("filters"):
        spec["filters"] = [{"of": column(f["of"], "filters"), "using": f["using"], **({"value": f["value"]} if "value" in f else {})} for f in profile["filters"]]
    if binding.get("available_from"):
        spec["validity"] = {"arrival_from": binding["available_from"]}
    features = [n for n in names if n not in targets]
    run = {"kind": task["kind"], "pointer": pointer, "targets": [outs[t] for t in names if t in targets], "features": [outs[n] for n in features], "known_ahead": [outs[n] for n in features if availability.get(n) == "known_ahead"]}
    if len(run["targets"]) == 1:
        run["target"] = run["targets"][0]
    return spec, run


def column_roles(df: DataFrame) -> DataFrame:
    """``column, role, cardinality`` for drafting a profile: date, number, entity or dimension.

    A column is a date or number where nearly all its non-blank cells read as one, an entity where
    nearly all its cells differ. One pass, pre-aggregated by column and value.
    """
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns))
    values = df.select(F.explode(cells).alias("c")).select("c.column", "c.value").where(F.trim("value") != "").groupBy("column", "value").agg(F.count("*").alias("n"))
    kind = coerce.T.StringType()
    is_day, is_number = coerce.day(F.col("value"), kind).isNotNull(), coerce.number(F.col("value"), kind).isNotNull()
    by = values.groupBy("column").agg(F.sum("n").alias("cells"), F.count("*").alias("cardinality"), F.sum(F.when(is_day, F.col("n")).otherwise(0)).alias("days"), F.sum(F.when(is_number, F.col("n")).otherwise(0)).alias("numbers"))
    most = 0.95 * F.col("cells")
    role = F.when((F.col("days") >= most) & (F.col("numbers") < most), "date").when(F.col("numbers") >= most, "number").when(F.col("cardinality") >= most, "entity").otherwise("dimension")
    return by.select("column", role.alias("role"), "cardinality")
