"""What a spec may name: functions, derives and task kinds, as plain tables."""

from __future__ import annotations

from tallyframe.functions.registered import AGGREGATES

# Names, kinds and needs.
FUNCTIONS = {
    "sum": ("reduction", {"measure"}),
    "mean": ("reduction", {"measure"}),
    "min": ("reduction", {"measure"}),
    "max": ("reduction", {"measure"}),
    "count": ("reduction", set()),
    "first": ("reduction", {"measure"}),
    "last": ("reduction", {"measure"}),
    "label": ("class", {"measure"}),
    "hhi": ("group", {"measure", "entity"}),
    "top_share": ("group", {"measure", "entity"}),
}

# What each derive returns.
DERIVES = {
    "bin:day": "bucket",
    "bin:week": "bucket",
    "bin:month": "bucket",
    "bin:quarter": "bucket",
    "bin:year": "bucket",
    "week_of_year": "scalar",
    "month_of_year": "scalar",
    "quarter_of_year": "scalar",
    "day_of_week": "scalar",
    "year": "scalar",
    "row_number": "position",
}

#: Derives of single rows, from rows before them: see ``operators/history.py``.
ROW_DERIVES = ("rolling_sum", "rolling_mean", "rolling_count", "last_value")

# Required parts, permitted parts, least and most keys, what the task points at.
TASKS = {
    "forecast": (("clock", "target"), ("keys", "covariates"), 0, 4, "target"),
    "detect_anomaly": (("signal",), ("clock", "keys", "covariates"), 0, 4, "signal"),
    "classify": (("label", "keys"), ("clock", "covariates"), 1, 4, "label"),
    "regress": (("target", "keys"), ("clock", "covariates"), 1, 4, "target"),
    "cluster": (("keys",), ("clock", "covariates"), 1, 4, None),
    "recommend": (("keys", "signal"), ("covariates",), 2, 2, "signal"),
    "rank": (("keys", "signal"), ("covariates",), 2, 2, "signal"),
}

FILTERS = ("equals", "notEquals", "greaterThan", "lessThan", "contains", "isEmpty", "isNotEmpty")


def functions() -> dict[str, tuple[str, set[str]]]:
    """The functions above and those that were registered."""
    return FUNCTIONS | {name: ("registered", {"measure", "entity"} if a.by else {"measure"}) for name, a in AGGREGATES.items()}


def known(table: dict | tuple, name: str, what: str) -> str:
    """``name`` if the table has it; else an error that lists what it has."""
    if name not in table:
        raise ValueError(f"{what}: unknown '{name}' (known: {', '.join(sorted(table))})")
    return name


def check_task(task: dict) -> dict:
    """A task with its kind's required parts, no others, and a fitting number of keys."""
    kind = {"anomaly": "detect_anomaly"}.get(task.get("kind", ""), task.get("kind", ""))
    needs, may, least, most, _ = TASKS[known(TASKS, kind, "task kind")]
    given = {k for k, v in task.items() if k != "kind" and v not in (None, "", [], {})}
    if missing := set(needs) - given:
        raise ValueError(f"task {kind}: needs {', '.join(sorted(missing))}")
    if extra := given - set(needs) - set(may):
        raise ValueError(f"task {kind}: does not take {', '.join(sorted(extra))}")
    if not least <= len(task.get("keys") or []) <= most:
        raise ValueError(f"task {kind}: takes {least} to {most} keys")
    return {**task, "kind": kind}
