"""Clusters of frame rows by k-means with k-means|| seeding.

Rows are standardised and stored once as whole numbers of 2 ** -BITS. Each round of seeding draws a row
with a probability in proportion to its squared distance from the nearest seed so far, by a hash of its key and the
round, so about ``2 k`` seeds come from a round and reach the driver; there they are weighted by the rows
nearest to them and reduced to k by the best of some searches over them. Each step of the search is one pass: a row goes to its nearest center and
is summed there as a cluster feature (rows, sums, sum of squares). Cluster features are sums of whole numbers, so they merge
in any order to the same result: the same rows give the same clusters however they are partitioned.

Rows that lack a feature have no cluster; ties go to the first center, and centers are ordered by their size, then by
their features. Equal rows share a cluster, so there are at most as many clusters as different rows. Rows of one key are drawn together.
An empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.scratch import free_names, materialise
from tallyframe.operators.regress import _finite

#: Standardised features are whole numbers of 2 ** -BITS and at most 2 ** WIDEST in size, so that sums of 2 ** 38 rows are exact.
BITS, WIDEST = 16, 9
ROUNDS, STEPS, RESTARTS = 5, 30, 8
UNIT = float(1 << BITS)


@dataclass
class Clusters:
    """Centers in standardised units, the scaling, and what the search ended with."""

    features: list[str]
    mean: np.ndarray
    scale: np.ndarray
    centers: np.ndarray
    steps: int
    settled: bool


def _standardised(features: list[str], mean: np.ndarray, scale: np.ndarray) -> Column:
    limit = float((1 << WIDEST) * UNIT)
    z = [F.round((_finite(c) - float(m)) / float(s) * UNIT) for c, m, s in zip(features, mean, scale, strict=True)]
    return F.array(*(F.when(v.isNotNull(), F.greatest(F.least(v, F.lit(limit)), F.lit(-limit))).cast("long") for v in z))


def _nearest(point: str, centers: np.ndarray) -> Column:
    """``k, d, next``: the nearest center to the point of a column, the squared distance to it and to the next one.

    Built as text: many centers are many small terms.
    """
    terms = (" + ".join(f"pow(`{point}`[{j}] - {float(c)!r}D, 2)" for j, c in enumerate(center)) for center in centers)
    ranked = ", ".join(f"named_struct('d', ({t}) / {UNIT * UNIT!r}D, 'k', {k})" for k, t in enumerate(terms))
    return F.expr(f"transform(array(array_sort(array({ranked}))), r -> named_struct('k', r[0].k, 'd', r[0].d, 'next', get(r, 1).d))[0]")


def _draw(key: str, round_: int, seed: int) -> Column:
    """A number from 0 to 1 from a row's key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{round_}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def _reduced(seeds: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """The best of some searches for k centers of weighted seeds, each from seeds drawn by weight and squared distance."""
    best, least = seeds[:1], np.inf
    for _ in range(RESTARTS):
        chosen = [int(np.searchsorted(np.cumsum(weights), rng.random() * weights.sum(), side="right"))]
        while len(chosen) < min(k, len(seeds)):
            far = ((seeds[:, None, :] - seeds[chosen][None, :, :]) ** 2).sum(axis=2).min(axis=1) * weights
            if far.sum() <= 0:
                break
            chosen.append(int(np.searchsorted(np.cumsum(far), rng.random() * far.sum(), side="right")))
        centers = seeds[chosen]
        for _ in range(STEPS):
            apart = ((seeds[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2)
            near = apart.argmin(axis=1)
            moved = np.array([np.average(seeds[near == c], axis=0, weights=weights[near == c]) if weights[near == c].sum() > 0 else centers[c] for c in range(len(centers))])
            if np.array_equal(moved, centers):
                break
            centers = moved
        cost = float((apart.min(axis=1) * weights).sum())
        if cost < least:
            best, least = centers, cost
    return best


def _seeds(rows: DataFrame, key: str, k: int, seed: int) -> np.ndarray:
    first = rows.orderBy(_draw(key, -1, seed), "z").limit(1).collect()
    centers = np.array([r["z"] for r in first], dtype=float)
    for round_ in range(ROUNDS):
        near = rows.withColumn("d", _nearest("z", centers)["d"])
        cost = near.agg(F.sum(F.round(F.col("d") * 1024).cast("long"))).first()[0]
        if not cost:
            break
        drawn = near.where(_draw(key, round_, seed) < F.col("d") * (2.0 * k * 1024 / cost)).select("z").distinct().collect()
        if drawn:
            centers = np.unique(np.vstack([centers, np.array([r["z"] for r in drawn], dtype=float)]), axis=0)
    counts = {r["cluster"]: r["count"] for r in rows.select(_nearest("z", centers)["k"].alias("cluster")).groupBy("cluster").count().collect()}
    weights = np.array([counts.get(i, 0) for i in range(len(centers))], dtype=float)
    return _reduced(centers, weights, k, np.random.default_rng(seed))


def fit(df: DataFrame, key: str, features: list[str], k: int, seed: int = 0) -> Clusters | None:
    """Centers of k clusters, fewer where there are fewer different rows; None for a table without complete rows."""
    stats = df.agg(*(f(_finite(c)).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    mean, scale = (np.array([float(f"{stats[f'{n}{i}'] or 0.0:.9g}") for i in range(len(features))]) for n in "ms")  # sums of doubles differ in their last digits from run to run
    scale = np.where(scale > 0, scale, 1.0)
    whole = df.select(F.col(f"`{key}`"), _standardised(features, mean, scale).alias("z")).where(F.forall("z", lambda x: x.isNotNull()))
    rows = materialise(whole, "cluster-rows")
    if rows.isEmpty():
        return None
    centers = _seeds(rows, key, k, seed)
    settled, steps = False, 0
    while not settled and steps < STEPS:
        placed = rows.select("z", _nearest("z", centers)["k"].alias("c"))
        found = {r["c"]: r for r in placed.groupBy("c").agg(F.count("*").alias("n"), *(F.sum(F.get("z", F.lit(j))).alias(f"s{j}") for j in range(len(features)))).collect()}
        moved = np.array([[found[c][f"s{j}"] / found[c]["n"] for j in range(len(features))] if c in found else centers[c] for c in range(len(centers))])
        settled, steps = bool(np.allclose(moved, centers, rtol=0, atol=0)), steps + 1
        sizes = [found[c]["n"] if c in found else 0 for c in range(len(centers))]
        centers = moved
    order = sorted(range(len(centers)), key=lambda c: (-sizes[c], centers[c].tolist()))
    return Clusters(features, mean, scale, centers[order], steps, settled)


def assign(df: DataFrame, model: Clusters | None) -> DataFrame:
    """``df`` with ``cluster, distance, silhouette``, null where a feature lacks.

    The simplified silhouette compares the distance to one's own center with that to the next one; it is 0 for a lone cluster.
    """
    if model is None:
        return df.withColumns({"cluster": F.lit(None).cast("int"), "distance": F.lit(None).cast("double"), "silhouette": F.lit(None).cast("double")})
    point, at = free_names(df, "point", "at")
    placed = df.withColumn(point, _standardised(model.features, model.mean, model.scale))
    placed = placed.withColumn(at, F.when(F.forall(point, lambda x: x.isNotNull()), _nearest(point, model.centers)))
    near, other = F.sqrt(F.col(f"{at}.d")), F.sqrt(F.col(f"{at}.next"))
    silhouette = F.when(F.col(at).isNotNull(), F.coalesce(F.when(other > 0, (other - near) / other), F.lit(0.0)))
    return placed.withColumns({"cluster": F.col(f"{at}.k"), "distance": near, "silhouette": silhouette}).drop(point, at)


def summary(assigned: DataFrame, features: list[str]) -> DataFrame:
    """``cluster, rows, inertia, silhouette`` and the mean of each feature."""
    means = [F.avg(F.col(f"`{c}`").cast("double")).alias(f"mean_{c}") for c in features]
    return assigned.where(F.col("cluster").isNotNull()).groupBy("cluster").agg(F.count("*").alias("rows"), F.sum(F.col("distance") * F.col("distance")).alias("inertia"), F.avg("silhouette").alias("silhouette"), *means)


def verdict(silhouette: float | None) -> str:
    """A word for how far clusters lie apart."""
    if silhouette is None:
        return "nothing to tell apart"
    return "trusted" if silhouette > 0.5 else "weak" if silhouette > 0.25 else "unpredictable"
