"""Forecasts with covariates that are known ahead: a regression by series, and smoothing of what it leaves.

For each series, the target is regressed on a constant, time and the covariates by least squares; the
covariates' part is taken off, the rest is smoothed and carried on like any series, and the part of the future's
covariates is added. The future is a spine of the buckets after a series' last, joined with the covariates that are
known for them; these stand in the future rows.

A covariate is known ahead, or it can't be used: one that is ``past_only`` is refused. Points that lack their target or a covariate
are left out of the fit and have no ``yhat``; future buckets that lack a covariate, or are not in the
future's table at all, have none either. A covariate that never varied in a series has no weight there. Series of fewer points
than covariates and ``forecast.LEAST_POINTS`` together keep their points without ``yhat``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import dates
from tallyframe.operators import forecast
from tallyframe.plans.spec import Spec


def known_ahead(spec: Spec, wanted: list[str]) -> list[str]:
    """``wanted`` columns of a frame that may be used as covariates: measures known ahead, and derives of the clock."""
    kinds = {m.out: m.availability for m in spec.measures} | {d.out: "known_ahead" for d in spec.derives}
    for name in wanted:
        if name not in kinds:
            raise ValueError(f"covariate '{name}': the frame has no such column (known: {', '.join(kinds)})")
        if kinds[name] != "known_ahead":
            raise ValueError(f"covariate '{name}': {kinds[name] or 'of no stated availability'}, only what is known ahead can stand in future rows")
    return wanted


def fit_one(y: np.ndarray, x: np.ndarray, season: int | None = None) -> tuple[np.ndarray, forecast.Fit]:
    """Weights of the covariates of one series, and the smoothing of what they leave."""
    n = len(y)
    varies = np.ptp(x, axis=0) > 0
    design = np.column_stack([np.ones(n), np.arange(n) / max(n - 1, 1), x[:, varies]])
    size = np.maximum(np.abs(design).max(axis=0), 1e-300)
    weights = np.zeros(x.shape[1])
    weights[varies] = (np.linalg.lstsq(design / size, y, rcond=1e-10)[0] / size)[2:]
    return weights, forecast.fit(y - x @ weights, season)


def forecast_with(points: DataFrame, keys: list[str], start: str, target: str, covariates: list[str], future: DataFrame, grain: str, horizon: int = 4, season: int | None = None) -> DataFrame:
    """Keys, ``start, y, yhat, is_forecast``, the covariates, and ``weights`` of the series.

    ``future`` has the keys that its covariates depend on (all of ``keys``, some or none), ``start`` and the covariates, a row for each.
    """
    if not covariates:
        raise ValueError("covariates: at least one is needed, see forecast.forecast for none")
    shared = [k for k in keys if k in future.columns]
    if missing := [c for c in (start, *covariates) if c not in future.columns]:
        raise ValueError(f"future: lacks {', '.join(missing)}")
    cell = lambda c: F.col(f"`{c}`").cast("double")
    past = points.select(*keys, F.col(f"`{start}`").alias("start"), cell(target).alias("y"), F.array(*(cell(c) for c in covariates)).alias("x"))
    ends = past.where(F.col("y").isNotNull()).groupBy(*keys).agg(F.max("start").alias("last"))
    spine = ends.select(*keys, F.explode(F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda i: dates.next_start(grain, F.col("last"), i))).alias("start"))
    known = future.select(*shared, F.col(f"`{start}`").alias("start"), F.array(*(cell(c) for c in covariates)).alias("x")).dropDuplicates([*shared, "start"])
    ahead = spine.join(known, [*shared, "start"], "left").select(*keys, "start", F.lit(None).cast("double").alias("y"), "x")
    both = past.join(ends, keys, "left") if keys else past.crossJoin(ends)  # one series
    rows = both.where("last IS NULL OR start <= last").drop("last").withColumn("ahead", F.lit(False)).unionByName(ahead.withColumn("ahead", F.lit(True)))
    series = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ahead", "start", "y", "x"))).alias("p")).select(*keys, *(F.col(f"p.{c}").alias(c) for c in ("ahead", "start", "y", "x")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in series.schema) + ", yhat array<double>, weights array<double>"

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            told, weighed = [], []
            for later, y, x in zip(pdf["ahead"], pdf["y"], pdf["x"], strict=True):
                later, y = np.array(later, dtype=bool), np.array(y, dtype=float)
                x = np.array([np.full(len(covariates), np.nan) if r is None else np.array(r, dtype=float) for r in x]).reshape(len(y), len(covariates))
                whole = np.isfinite(x).all(axis=1)
                use, out = ~later & np.isfinite(y) & whole, np.full(len(y), np.nan)
                weights = None
                if use.sum() >= forecast.LEAST_POINTS + len(covariates):
                    weights, rest = fit_one(y[use], x[use], season)
                    out[use] = rest.fitted + x[use] @ weights
                    out[later] = rest.ahead(int(later.sum())) + x[later] @ weights  # nan where a covariate lacks
                told.append([None if np.isnan(v) else float(v) for v in out])
                weighed.append(None if weights is None else weights.tolist())
            pdf["yhat"], pdf["weights"] = told, weighed
            yield pdf

    done = series.mapInPandas(run, schema)
    at = F.posexplode("start").alias("i", "at")
    flat = done.select(*keys, at, "y", "x", "yhat", "ahead", "weights")
    value = lambda c: F.get(c, F.col("i"))
    return flat.select(*keys, F.col("at").alias("start"), value("y").alias("y"), F.round(value("yhat"), 4).alias("yhat"), F.when(value("ahead"), "yes").otherwise("no").alias("is_forecast"), *(F.get(value("x"), F.lit(j)).alias(c) for j, c in enumerate(covariates)), "weights")
