"""Linear regression of frame rows from Gram matrices.

Features and target are standardised, and products of all pairs are summed on the cluster, by fold, in one
aggregation: a matrix of p x p for each fold is all that reaches the driver. The matrix of a fold's training
rows is the whole less its own, so no fold needs a pass of its own. The ridge with the least out-of-fold
error is chosen from the same matrices, as a fold's squared error is a quadratic form in them.

Rows are scorable (target and features are there), to predict (no target) or unscorable (a feature lacks); only scorable ones are
summed, and a number that is not finite counts as lacking. Features that never vary, and those that others determine, share what
weight there is as the least-squares solution of smallest norm has it. Scorable rows in fewer than two folds are refused.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RIDGES = (0.0, 0.001, 0.01, 0.1, 1.0)
#: The products of so many features and the target are one aggregation.
MOST_FEATURES = 64


@dataclass
class Model:
    """Weights by feature in the units of the columns, for all rows and for the rows outside each fold."""

    target: str
    features: list[str]
    ridge: float
    intercept: float
    weights: np.ndarray
    by_fold: dict[int, tuple[float, np.ndarray]]
    #: Out-of-fold root mean squared error by ridge.
    errors: dict[float, float]

    def prediction(self, intercept: float | None = None, weights: np.ndarray | None = None) -> Column:
        weights = self.weights if weights is None else weights
        return sum((F.col(f"`{c}`").cast("double") * float(w) for c, w in zip(self.features, weights, strict=True)), F.lit(float(self.intercept if intercept is None else intercept)))


def hash_fold(key: str, k: int, seed: int = 0) -> Column:
    """A fold from the digest of a row's key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(f"`{key}`").cast("string")).cast("binary"))
    return F.coalesce((F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % k).cast("int"), F.lit(0))


def _finite(name: str) -> Column:
    c = F.col(f"`{name}`").cast("double")
    return F.when(F.abs(c) < float("inf"), c)


def population(target: str, features: list[str]) -> Column:
    """``no`` for rows to learn from, ``yes`` for those to predict, ``unscorable`` where a feature lacks."""
    lacks = F.lit(False)
    for c in features:
        lacks = lacks | _finite(c).isNull()
    return F.when(lacks, "unscorable").when(_finite(target).isNull(), "yes").otherwise("no")


def _grams(df: DataFrame, columns: list[str], fold: Column) -> tuple[dict[int, np.ndarray], np.ndarray, np.ndarray]:
    """By fold, the matrix of products of a constant and the standardised columns; their means and scales."""
    stats = df.agg(*(f(_finite(c)).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    mean, scale = (np.array([stats[f"{n}{i}"] or 0.0 for i in range(len(columns))]) for n in "ms")
    scale = np.where(scale > 0, scale, 1.0)
    z = [F.lit(1.0), *((_finite(c) - float(m)) / float(s) for c, m, s in zip(columns, mean, scale, strict=True))]
    names = [f"z{i}" for i in range(len(z))]
    rows = df.select(fold.alias("fold"), *(c.alias(n) for c, n in zip(z, names, strict=True)))
    pairs = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
    sums = rows.groupBy("fold").agg(*(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"g{i}_{j}") for i, j in pairs)).collect()
    grams = {}
    for r in sums:
        g = np.zeros((len(z), len(z)))
        for i, j in pairs:
            g[i, j] = g[j, i] = r[f"g{i}_{j}"]
        grams[r["fold"]] = g
    return grams, mean, scale


def _solve(gram: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of constant and features for the last column; the constant is not shrunk."""
    n, a, b = gram[0, 0], gram[:-1, :-1], gram[:-1, -1]
    penalty = ridge * n * np.eye(len(a))
    penalty[0, 0] = 0.0
    return np.linalg.lstsq(a + penalty, b, rcond=1e-12)[0]


def _squared_error(gram: np.ndarray, weights: np.ndarray) -> float:
    w = np.append(weights, -1.0)
    return float(w @ gram @ w)


def fit(df: DataFrame, key: str, target: str, features: list[str], k: int = 5, ridges: tuple[float, ...] = RIDGES, seed: int = 0) -> Model:
    """A model of the scorable rows, with the ridge that predicts rows of other folds best."""
    if not 0 < len(features) <= MOST_FEATURES:
        raise ValueError(f"features: 1 to {MOST_FEATURES}, not {len(features)}")
    rows = df.where(population(target, features) == "no")
    grams, mean, scale = _grams(rows, [*features, target], hash_fold(key, k, seed))
    if len(grams) < 2:
        raise ValueError(f"{target}: rows to learn from lie in {len(grams)} of {k} folds, two are needed")
    whole = sum(grams.values())
    n = whole[0, 0]
    solved = {ridge: {f: _solve(whole - g, ridge) for f, g in grams.items()} for ridge in ridges}
    errors = {ridge: float(np.sqrt(max(sum(_squared_error(grams[f], w) for f, w in by.items()), 0.0) / n) * scale[-1]) for ridge, by in solved.items()}
    ridge = min(ridges, key=lambda r: (round(errors[r] / (min(errors.values()) or 1.0), 9), r))

    def unscaled(w: np.ndarray) -> tuple[float, np.ndarray]:
        weights = w[1:] * scale[-1] / scale[:-1]
        return float(mean[-1] + w[0] * scale[-1] - weights @ mean[:-1]), weights

    intercept, weights = unscaled(_solve(whole, ridge))
    return Model(target, features, ridge, intercept, weights, {f: unscaled(w) for f, w in solved[ridge].items()}, errors)


def coefficients(df: DataFrame, model: Model) -> DataFrame:
    """``fold, name, weight`` of the model (fold null) and of each fold's own."""
    rows = []
    for fold, (intercept, weights) in [(None, (model.intercept, model.weights)), *sorted(model.by_fold.items())]:
        rows += [(fold, "intercept", float(intercept)), *((fold, c, float(w)) for c, w in zip(model.features, weights, strict=True))]
    return df.sparkSession.createDataFrame(rows, "fold int, name string, weight double")


def out_of_fold(df: DataFrame, key: str, model: Model, k: int = 5, seed: int = 0) -> DataFrame:
    """Scorable rows with ``fold`` and ``predicted`` by the model that has not seen them."""
    rows = df.where(population(model.target, model.features) == "no").withColumn("fold", hash_fold(key, k, seed))
    predicted = F.lit(None).cast("double")
    for fold, (intercept, weights) in model.by_fold.items():
        predicted = F.when(F.col("fold") == fold, model.prediction(intercept, weights)).otherwise(predicted)
    return rows.withColumn("predicted", predicted)


def deliverable(df: DataFrame, model: Model) -> DataFrame:
    """Every row with ``predicted`` and ``is_prediction``: no (known), yes (predicted), unscorable (null prediction)."""
    kind = population(model.target, model.features)
    return df.withColumn("predicted", F.when(kind != "unscorable", model.prediction())).withColumn("is_prediction", kind)


def accuracy(predicted: DataFrame, target: str) -> DataFrame:
    """``rows, mae, rmse, r2`` and the error of the mean of all rows, with the lift over it in percent."""
    y, e = F.col(f"`{target}`").cast("double"), F.col(f"`{target}`").cast("double") - F.col("predicted")
    sums = predicted.agg(F.count("*").alias("rows"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.stddev_pop(y).alias("baseline"))
    share = F.col("rmse") / F.col("baseline")
    return sums.select("rows", *(F.round(c, 4).alias(c) for c in ("mae", "rmse", "baseline")), F.when(F.col("baseline") > 0, F.round(1 - share * share, 4)).alias("r2"), F.when(F.col("baseline") > 0, F.round((1 - share) * 100, 4)).alias("lift"))


def verdict(r2: float | None) -> str:
    """A word for how much of the target's spread is predicted."""
    if r2 is None:
        return "no baseline"
    return "trusted" if r2 > 0.5 else "weak" if r2 > 0.1 else "unpredictable"
