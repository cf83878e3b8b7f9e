"""Exponential smoothing of many series: simple, Holt and Holt-Winters by grid search.

A series is one row of ordered values. Rows are dealt out over the cluster, a fit runs the whole
parameter grid through the recursion at once, and a backtest takes the fits of all its origins from one
pass over the series.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import dates
from tallyframe.functions.scratch import materialise
from tallyframe.operators.ordering import running_before

#: Smoothing parameters tried.
GRID = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
LEAST_POINTS = 4
MAX_FOLDS = 24


@dataclass
class Fit:
    alpha: float
    beta: float | None
    gamma: float | None
    season: np.ndarray | None
    level: float
    trend: float
    n: int
    fitted: np.ndarray
    sse: float

    @property
    def model(self) -> str:
        return "holt-winters" if self.season is not None else "holt" if self.beta is not None else "ses"

    def ahead(self, h: int) -> np.ndarray:
        steps = np.arange(1, h + 1)
        out = self.level + steps * self.trend
        return out if self.season is None else out + self.season[(self.n + steps - 1) % len(self.season)]


def _grid(seasonal: bool) -> np.ndarray:
    """Rows ``alpha, beta, gamma`` in order of preference; nan where a part is left out."""
    rows = []
    for a in GRID:
        rows.append((a, np.nan, np.nan))
        for b in GRID:
            rows.append((a, b, np.nan))
            rows += [(a, b, g) for g in GRID] if seasonal else []
    return np.array(rows)


def fits(y: np.ndarray, origins: list[int], season: int | None = None, fitted: bool = False) -> list[Fit]:
    """For each of several lengths, the first of the grid's fits of so many points with the least squared error in sample.

    The recursion of a short history is the beginning of that of a longer one, so all of them come from one pass.
    """
    y = np.asarray(y, dtype=float)
    n = max(origins)
    m = season if season and n >= 2 * season else 0
    grid = _grid(bool(m))
    alpha, holt, winter = grid[:, 0], ~np.isnan(grid[:, 1]), ~np.isnan(grid[:, 2])
    beta, gamma = np.nan_to_num(grid[:, 1]), np.nan_to_num(grid[:, 2])
    level, trend = np.full(len(grid), y[0]), np.where(holt, y[1] - y[0] if n > 1 else 0.0, 0.0)
    seasons = np.zeros((max(m, 1), len(grid)))
    if m:
        first, second = y[:m].mean(), y[m : 2 * m].mean()
        level, trend = np.where(winter, first, level), np.where(winter, (second - first) / m, trend)
        seasons = np.where(winter, (y[:m] - first)[:, None], 0.0)
    kept, sse, found = np.empty((n if fitted else 0, len(grid))), np.zeros(len(grid)), {}
    for t in range(n):
        s = seasons[t % m].copy() if m else 0.0
        ahead = level + trend + s
        if fitted:
            kept[t] = ahead
        sse += (y[t] - ahead) ** 2
        last = level
        level = alpha * (y[t] - s) + (1 - alpha) * (level + trend)
        trend = np.where(holt, beta * (level - last) + (1 - beta) * trend, trend)
        if m:
            seasons[t % m] = np.where(winter, gamma * (y[t] - last - trend) + (1 - gamma) * s, 0.0)
        if t + 1 in origins:
            k = int((sse if m and t + 1 >= 2 * m else np.where(winter, np.inf, sse)).argmin())
            own = seasons[:, k].copy() if winter[k] else None
            found[t + 1] = Fit(float(alpha[k]), float(beta[k]) if holt[k] else None, float(gamma[k]) if winter[k] else None, own, float(level[k]), float(trend[k]), t + 1, kept[: t + 1, k].copy() if fitted else np.zeros(0), float(sse[k]))
    return [found[o] for o in origins]


def fit(y: np.ndarray, season: int | None = None) -> Fit:
    """The first of the grid's fits of a whole series with the least squared error in sample."""
    return fits(y, [len(y)], season, fitted=True)[0]


def series(df: DataFrame, keys: list[str], start: str, target: str) -> DataFrame:
    """One row for each series: keys, ordered ``starts`` and values ``y``, null values left out."""
    points = F.array_sort(F.collect_list(F.when(F.col(target).isNotNull(), F.struct(F.col(start).alias("t"), F.col(target).cast("double").alias("v")))))
    return df.groupBy(*keys).agg(points.alias("p")).select(*keys, F.col("p.t").alias("starts"), F.col("p.v").alias("y"))


def forecast(rows: DataFrame, keys: list[str], grain: str, horizon: int = 4, season: int | None = None) -> DataFrame:
    """Keys, ``start, y, yhat, is_forecast`` of every point and of ``horizon`` further buckets.

    ``rows`` come from ``series``. A series of fewer than four points keeps its points without yhat.
    """
    wanted = [*keys, "starts", "y"]
    fitted = "array<double>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*wanted).schema) + f", fitted {fitted}, ahead {fitted}"

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            fits = [fit(np.array(y), season) if len(y) >= LEAST_POINTS else None for y in pdf["y"]]
            pdf["fitted"] = [f.fitted.tolist() if f else [] for f in fits]
            pdf["ahead"] = [f.ahead(horizon).tolist() if f else [] for f in fits]
            yield pdf

    done = rows.select(*wanted).mapInPandas(run, schema)
    past = done.select(*keys, F.posexplode("starts").alias("i", "start"), "y", "fitted").select(*keys, "start", F.get("y", F.col("i")).alias("y"), F.round(F.get("fitted", F.col("i")), 4).alias("yhat"), F.lit("no").alias("is_forecast"))
    last = F.element_at("starts", -1)
    future = done.select(*keys, last.alias("last"), F.posexplode("ahead").alias("i", "v")).select(*keys, dates.next_start(grain, F.col("last"), F.col("i") + 1).alias("start"), F.lit(None).cast("double").alias("y"), F.round("v", 4).alias("yhat"), F.lit("yes").alias("is_forecast"))
    return past.unionByName(future)


def _origins(n: Column, horizon: int, season: int | None) -> Column:
    """Up to MAX_FOLDS evenly spread lengths of training, from the shortest to the longest."""
    least = F.when(n >= 2 * season, F.lit(max(LEAST_POINTS, 2 * season))).otherwise(F.lit(LEAST_POINTS)) if season else F.lit(LEAST_POINTS)
    count = n - horizon + 1 - least
    few = F.sequence(least, least + count - 1)
    many = F.transform(F.sequence(F.lit(0), F.lit(MAX_FOLDS - 1)), lambda i: least + F.floor(i * count / F.lit(MAX_FOLDS)).cast("int"))
    return F.when(count < 1, F.array().cast("array<int>")).when(count > MAX_FOLDS, many).otherwise(few)


def backtest(rows: DataFrame, keys: list[str], horizon: int = 1, season: int | None = None) -> DataFrame:
    """Keys, ``origin, step, actual, predicted, naive``; parameters are tuned anew at every origin."""
    return _predicted(rows, keys, _origins(F.size("y"), horizon, season), F.lit(horizon), season)


def holdout(rows: DataFrame, keys: list[str], season: int | None = None, points: int | None = None) -> DataFrame:
    """As ``backtest``, from one origin: the last ``points`` are predicted from all before them.

    By default a quarter of the series is held out, at most a season (or four points), at least one.
    A series that keeps fewer than four points for its fit has no rows.
    """
    n = F.size("y")
    held = F.lit(points) if points else F.greatest(F.lit(1), F.least(F.floor(n / 4).cast("int"), F.lit(season or 4)))
    return _predicted(rows.where(n - held >= LEAST_POINTS), keys, F.array(n - held), held, season)


def _predicted(rows: DataFrame, keys: list[str], origins: Column, ahead: Column, season: int | None) -> DataFrame:
    told = rows.select(*keys, "y", origins.cast("array<int>").alias("origins"), ahead.cast("int").alias("ahead")).where(F.size("origins") > 0)
    if keys:  # a fit costs far more than its bytes, so series are dealt out by number
        told = told.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in told.schema) + ", predicted array<array<double>>, scales array<double>"

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            predicted, scales = [], []
            for y, at, h in zip(pdf["y"], pdf["origins"], pdf["ahead"], strict=True):
                own, past = fits(np.array(y), list(at), season), np.array(y)
                predicted.append([f.ahead(h).tolist() for f in own])
                scales.append([step_size(past[: f.n], None if f.season is None else len(f.season)) for f in own])
            pdf["predicted"], pdf["scales"] = predicted, scales
            yield pdf

    done = told.mapInPandas(run, schema)
    folds = done.select(*keys, "y", F.posexplode("origins").alias("k", "origin"), "predicted", "scales").withColumns({"said": F.get("predicted", F.col("k")), "scale": F.get("scales", F.col("k"))})
    steps = folds.select(*keys, "y", "origin", "scale", F.posexplode("said").alias("i", "predicted"))
    return steps.select(*keys, "origin", (F.col("i") + 1).alias("step"), F.get("y", F.col("origin") + F.col("i")).alias("actual"), "predicted", F.get("y", F.col("origin") - 1).alias("naive"), "scale")


def step_size(y: np.ndarray, season: int | None = None) -> float:
    """The mean size of steps, from season to season where the series is longer than one."""
    lag = season if season and len(y) > season else 1
    return float(np.abs(y[lag:] - y[:-lag]).mean()) if len(y) > 1 else 0.0


def accuracy(errors: DataFrame, keys: list[str]) -> DataFrame:
    """MAE, RMSE, skill against the last value carried on, MASE and, where it means something, MAPE.

    MASE scales by the steps of the longest training part and is null where those are all zero;
    series scored together share the largest.
    """
    e, b = F.col("actual") - F.col("predicted"), F.col("actual") - F.col("naive")
    size = F.abs("actual")
    last = F.max(F.struct("origin", "scale"))
    sums = errors.groupBy(*keys).agg(
        F.count("*").alias("points"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(b)).alias("naive_mae"), F.sqrt(F.avg(b * b)).alias("naive_rmse"),
        F.avg(F.when(size > 0, F.abs(e) / size)).alias("ape"), F.avg(F.when(size > 0, F.abs(b) / size)).alias("naive_ape"), F.min("actual").alias("low"), F.min(size).alias("least"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY abs(actual) DESC)").alias("typical"), last.alias("last"),
    )
    skill = F.when(F.col("naive_rmse") == 0, F.when(F.col("rmse") == 0, 0.0).otherwise(-100.0)).otherwise((1 - F.col("rmse") / F.col("naive_rmse")) * 100)
    usable = (F.col("low") >= 0) & (F.col("typical") > 0) & (F.col("least") >= 0.01 * F.col("typical"))
    mase = F.when(F.col("last.scale") > 0, F.col("mae") / F.col("last.scale"))
    return sums.select(*keys, "points", *(F.round(c, 4).alias(c) for c in ("mae", "rmse", "naive_mae", "naive_rmse")), F.round(skill, 4).alias("skill"), F.round(mase, 4).alias("mase"), F.when(usable, F.round(F.col("ape") * 100, 4)).alias("mape"), F.when(usable, F.round(F.col("naive_ape") * 100, 4)).alias("naive_mape"))


def evaluate(rows: DataFrame, keys: list[str], horizon: int = 1, season: int | None = None) -> DataFrame:
    """``accuracy`` with ``method``: rolling origins, or one hold-out for series too short to roll."""
    rolls = F.size(_origins(F.size("y"), horizon, season)) > 0
    parts = [("rolling-origin", backtest(rows, keys, horizon, season)), ("holdout", holdout(rows.where(~rolls), keys, season))]
    done = [accuracy(errors, keys).withColumn("method", F.lit(method)) for method, errors in parts]
    return done[0].unionByName(done[1]).where("points > 0")


def error_quantiles(errors: DataFrame, probabilities: list[float]) -> DataFrame:
    """``step, probability, error``: conformal quantiles of errors, over the size of steps, for each horizon.

    Errors of all series and origins of ``backtest`` make one pool for each step; the quantile at p is the
    ceil((n + 1) p)-th smallest of n, and null where that lies beyond them. Ranks come from counts by distinct error (six places),
    added up within ranges. Series that never moved have no scale and are left out.
    """
    error = F.round((F.col("actual") - F.col("predicted")) / F.col("scale"), 6)
    counts = materialise(errors.where("scale > 0").groupBy("step", error.alias("error")).agg(F.count("*").alias("n")), "forecast-errors")
    ranked = running_before(counts, ["step", "error"], "n", "before")
    sizes = counts.groupBy("step").agg(F.sum("n").alias("size"))
    starts = sizes.alias("a").join(sizes.alias("b"), F.col("b.step") < F.col("a.step"), "left").groupBy(F.col("a.step").alias("step"), F.col("a.size").alias("size")).agg(F.coalesce(F.sum("b.size"), F.lit(0)).alias("start"))  # one row for each step
    asked = F.explode(F.array(*(F.lit(float(p)) for p in probabilities))).alias("probability")
    wanted = starts.select("step", "start", asked, F.ceil(F.round((F.col("size") + 1) * F.col("probability"), 9)).alias("rank"))
    reached = F.col("before") - F.col("start") + F.col("n") >= F.col("rank")
    return wanted.join(ranked, "step", "left").groupBy("step", "probability").agg(F.min(F.when(reached, F.col("error"))).alias("error"))


def forecast_quantiles(rows: DataFrame, keys: list[str], grain: str, horizon: int, probabilities: list[float], season: int | None = None) -> DataFrame:
    """Keys, ``start, probability, value`` of each future bucket: the forecast and a band around it from what backtests missed by."""
    levels = error_quantiles(backtest(rows, keys, horizon, season), probabilities)
    future = forecast(rows, keys, grain, horizon, season).where("is_forecast = 'yes'")
    last = rows.select(*keys, F.element_at("starts", -1).alias("last"), _step_size("y", season).alias("scale"))
    placed = future.join(last, keys) if keys else future.crossJoin(last)  # one series
    step = (dates.index_of(grain, F.col("start")) - dates.index_of(grain, F.col("last"))).cast("int")
    return placed.withColumn("step", step).join(levels, "step").select(*keys, "start", "probability", F.round(F.col("yhat") + F.col("error") * F.col("scale"), 4).alias("value"))


def _step_size(y: str, season: int | None) -> Column:
    """``step_size`` of an array."""
    lag = F.when(F.size(y) > season, season).otherwise(1) if season else F.lit(1)
    n = F.size(y) - lag
    steps = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.abs(F.get(y, i + lag) - F.get(y, i)))
    return F.when(n > 0, F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) / n)


def coverage(errors: DataFrame, quantiles: DataFrame) -> DataFrame:
    """``step, probability, points, covered, pinball``: the share of errors at or below each quantile, and the mean pinball loss."""
    scaled = errors.where("scale > 0").select("step", F.round((F.col("actual") - F.col("predicted")) / F.col("scale"), 6).alias("e"))
    both = scaled.join(quantiles.where(F.col("error").isNotNull()), "step")
    miss = F.col("e") - F.col("error")
    loss = F.when(miss >= 0, F.col("probability") * miss).otherwise((F.col("probability") - 1) * miss)
    return both.groupBy("step", "probability").agg(F.count("*").alias("points"), F.round(F.avg((miss <= 0).cast("double")), 4).alias("covered"), F.round(F.avg(loss), 4).alias("pinball"))


def clock_holes(df: DataFrame, keys: list[str], start: str, grain: str) -> DataFrame:
    """Keys, ``start, missing``: buckets that lack between a point and the one before it."""
    from pyspark.sql import Window

    at = dates.index_of(grain, F.col(start))
    gap = at - F.lag(at).over(Window.partitionBy(*keys).orderBy(start)) - 1
    return df.select(*keys, start, gap.alias("missing")).where("missing > 0")


def verdict(skill: float | None, mape: float | None = None, mase: float | None = None) -> str:
    if skill is None:
        return "exact baseline"
    if mape is not None and mape < 1:
        return "exact"
    accurate = mape < 15 if mape is not None else mase < 1 if mase is not None else None
    if skill > 20 and accurate is not None:
        return "trusted" if accurate else "mixed"
    return "weak" if skill > 0 else "unpredictable"
