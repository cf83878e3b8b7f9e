"""A frame under the column names of forecasting and recommendation libraries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import coerce, dates
from tallyframe.operators import forecast

# Fixed names: series, clock and value; user, item and rating.
CLOCKED = {"nixtla": ("unique_id", "ds", "y"), "autogluon": ("item_id", "timestamp", "target"), "local": ("series_id", "t", "y")}
PAIRED = {"recbole": ("user_id:token", "item_id:token", "rating:float")}

#: Buckets of each grain that make a year's season.
SEASONS = {"day": 7, "week": 52, "month": 12, "quarter": 4, "year": 1}


def to_dialect(frame: DataFrame, dialect: str, keys: list[str], target: str, clock: str | None = None, covariates: list[str] | None = None) -> DataFrame:
    """Series keys joined by ``|`` (``all`` without any), clock, target and covariates."""
    more = [F.col(f"`{c}`") for c in covariates or []]
    if dialect in PAIRED:
        if len(keys) < 2:
            raise ValueError(f"{dialect}: needs two keys, a user and an item")
        names = PAIRED[dialect]
        return frame.select(F.col(f"`{keys[0]}`").alias(names[0]), F.col(f"`{keys[1]}`").alias(names[1]), F.col(f"`{target}`").alias(names[2]), *more)
    if dialect not in CLOCKED:
        raise ValueError(f"dialect: unknown '{dialect}' (known: {', '.join(sorted([*CLOCKED, *PAIRED]))})")
    if clock is None:
        raise ValueError(f"{dialect}: needs a clock")
    names = CLOCKED[dialect]
    series = F.concat_ws("|", *(F.col(f"`{k}`").cast("string") for k in keys)) if keys else F.lit("all")
    return frame.select(series.alias(names[0]), F.col(f"`{clock}`").alias(names[1]), F.col(f"`{target}`").alias(names[2]), *more)


def compatibility(keys: list[str], clock: str | None, dialect: str, horizon: int | None = None, season: int | None = None, history: int | None = None, grain: str | None = None) -> list[str]:
    """What speaks against running a dialect on a frame of these axes."""
    found = []
    if dialect in CLOCKED and clock is None:
        found.append("no time key")
    if horizon and clock is None:
        found.append("a horizon needs a clock")
    if dialect in ("nixtla", "autogluon") and len(keys) > 1:
        found.append("more than one entity key is joined into one series name")
    if season and grain and season > 1 and season % SEASONS.get(grain, 1):
        found.append(f"a season of {season} is not the {SEASONS.get(grain)} of {grain} buckets")
    if season and history is not None and history < 2 * season:
        found.append("fewer than two seasons of history")
    return found


def checks(frame: DataFrame, keys: list[str], target: str, dialect: str, clock: str | None = None, grain: str | None = None, horizon: int | None = None, season: int | None = None) -> list[str]:
    """``compatibility``, and what only the data can say: text in the target, little history, holes in the clock."""
    value = F.col(f"`{target}`")
    text = F.min(F.when(value.isNotNull() & coerce.number(value, frame.schema[target].dataType).isNull(), value.cast("string")))
    series = F.count_distinct(F.struct(*(F.col(f"`{k}`") for k in keys))) if keys else F.lit(1)
    seen = frame.agg(F.count("*").alias("rows"), series.alias("series"), text.alias("text")).first()
    found = compatibility(keys, clock, dialect, horizon, season, seen["rows"] // max(seen["series"], 1), grain)
    if seen["text"] is not None:
        found.append(f"the target '{target}' holds text, such as '{seen['text']}'")
    if clock and grain:
        at = frame.select(*(F.col(f"`{k}`") for k in keys), dates.start_of(grain, F.col(f"`{clock}`")).alias("__start"))
        holes = forecast.clock_holes(at, keys, "__start", grain).select(*keys).distinct().count()
        if holes:
            found.append(f"{holes} series skip buckets")
    return found


# What a run may set for each kind of task.
KNOBS = {
    "forecast": ("target", "features", "model", "horizon", "season_length", "quantiles", "backtest"),
    "recommend": ("target", "top_k", "holdout", "folds", "user_key", "item_key"),
    "classify": ("target", "features", "model", "folds", "trees", "depth", "class_weight", "positive_class", "threshold"),
}


def ignored_knobs(kind: str, config: dict) -> list[str]:
    """Settings that have a value and no effect on tasks of this kind."""
    used = {"engine", "kind", *KNOBS.get(kind, ())}
    return sorted(k for k, v in config.items() if k not in used and v not in (None, "", [], {}))


def route(kind: str, keys: list[str], clock: str | None) -> str:
    """Which estimator serves a task: ``forest``, ``recommender`` or ``smoothing``."""
    if kind == "classify":
        if clock is not None:
            raise ValueError("classify: a frame with a clock is not supported; leave the clock out of the keys")
        return "forest"
    if clock is None and len(keys) >= 2:
        return "recommender"
    if clock is None:
        raise ValueError(f"{kind}: no estimator without a clock or two keys")
    return "smoothing"
