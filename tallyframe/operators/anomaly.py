"""Anomaly scores of series: one-step residuals, a robust scale for each series, ranks counted over all of them.

Each point is predicted from the points before it by the smoothing that fits its series best. Its
residual, over the median size of the series' residuals, is its score; how many of all scores are
no smaller gives a conformal p-value, so a threshold on it holds for series of any scale. Ranks are counts
by distinct score, added up within ranges, so no task sorts all scores.

The first two points of a series, from which the smoothing starts, and null signals have no score, nor
have series of fewer than ``forecast.LEAST_POINTS`` points. Where more than half of a series' residuals are 0, their
mean size scales it; where all are, every score is 0. Scores are rounded to six places, so that ties share a rank.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.scratch import materialise
from tallyframe.operators import forecast
from tallyframe.operators.ordering import running_before

#: Fixed value: the median size of normal residuals times this is their standard deviation.
NORMAL = 1.4826
WARM_UP = 2


def residuals(rows: DataFrame, keys: list[str], season: int | None = None) -> DataFrame:
    """Keys, ``start, y, expected, residual, scale`` of every scored point of the rows of ``forecast.series``."""
    wanted = rows.where(F.size("y") >= forecast.LEAST_POINTS).select(*keys, "starts", "y")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema) + ", expected array<double>"

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pdf["expected"] = [forecast.fit(np.array(y), season).fitted.tolist() for y in pdf["y"]]
            yield pdf

    fitted = wanted.mapInPandas(run, schema)
    sizes = F.array_sort(F.slice(F.transform(F.arrays_zip("y", "expected"), lambda p: F.abs(p["y"] - p["expected"])), F.lit(WARM_UP + 1), F.size("y")))
    n = F.size("sizes")
    low, high = F.get("sizes", F.floor((n - 1) / 2).cast("int")), F.get("sizes", F.floor(n / 2).cast("int"))
    mean = F.aggregate("sizes", F.lit(0.0), lambda a, x: a + x) / n
    scaled = fitted.withColumn("sizes", sizes).withColumn("scale", F.when(low + high > 0, NORMAL * (low + high) / 2).otherwise(mean))
    points = scaled.select(*keys, "scale", "starts", "expected", F.posexplode("y").alias("i", "y")).where(F.col("i") >= WARM_UP)
    expected = F.get("expected", F.col("i"))
    return points.select(*keys, F.get("starts", F.col("i")).alias("start"), "y", expected.alias("expected"), (F.col("y") - expected).alias("residual"), "scale")


def scored(residual: DataFrame, alpha: float = 0.01) -> DataFrame:
    """``residuals``' rows with ``score, p_value, is_anomaly``: p-values of at most ``alpha`` are anomalies.

    A p-value is the share of all scores that are no smaller, its own included.
    """
    score = F.when(F.col("scale") > 0, F.round(F.abs("residual") / F.col("scale"), 6)).otherwise(0.0)
    rows = materialise(residual.withColumn("score", score), "anomaly-scores")
    counts = rows.groupBy("score").agg(F.count("*").alias("same"))
    ranked = running_before(counts, "score", "same", "below")
    total = counts.agg(F.sum("same")).first()[0] or 0
    p_value = F.round((F.lit(total) - F.col("below")) / F.lit(max(total, 1)), 6)
    return rows.join(ranked.select("score", p_value.alias("p_value")), "score").select(*residual.columns, "score", "p_value", (F.col("p_value") <= alpha).alias("is_anomaly"))


def quantiles(residual: DataFrame, alphas: list[float]) -> DataFrame:
    """``alpha, threshold``: the least score that an anomaly at ``alpha`` has; null where no score is that rare."""
    done = scored(residual).groupBy("score", "p_value").agg(F.count("*").alias("n"))
    each = F.explode(F.array(*(F.lit(float(a)) for a in alphas))).alias("alpha")
    rare = done.select("score", "p_value", each).groupBy("alpha").agg(F.min(F.when(F.col("p_value") <= F.col("alpha"), F.col("score"))).alias("threshold"))
    return rare


def anomalies(rows: DataFrame, keys: list[str], season: int | None = None, alpha: float = 0.01) -> DataFrame:
    """Scores of every series of ``forecast.series``."""
    return scored(residuals(rows, keys, season), alpha)
