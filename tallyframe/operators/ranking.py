"""Ranking of items for each user by factors of users and items, from what users took.

Factors are fitted by alternating least squares on implicit feedback, block by block, as Spark's own
library does it; users and items are numbered by ranges with counted offsets, not by a dictionary on the
driver. What a user took is never ranked for that user. Factors of up to ``HELD_CELLS`` numbers go to every task,
which scores its users against all items. Of larger catalogues, users are grouped by how many items they took, to a
power of two, and the library is asked for that many more ranks than are wanted, so nothing is cut off.

Users without interactions get no ranks; equal scores go by item. Interactions are those of
``recommend.interactions``; weights below 0 are preferences against an item, as the library has it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.scratch import materialise
from tallyframe.operators.ordering import positions

#: Numbers of all items' factors that go to every task.
HELD_CELLS = 1_000_000
#: Users that are scored at once: so many that their scores stay under this many.
SCORES_AT_ONCE = 4_000_000
#: Items, and interactions, to a block of items while factors are fitted.
ITEMS_A_BLOCK, ROWS_A_BLOCK = 1000, 20_000_000


@dataclass
class Factors:
    """``user, features`` and ``item, features``, and the library's model over their numbers."""

    model: object
    users: DataFrame
    items: DataFrame
    user_numbers: DataFrame
    item_numbers: DataFrame


def _numbers(data: DataFrame, column: str) -> DataFrame:
    return materialise(positions(data.select(column).distinct(), column, "number").withColumn("number", F.col("number").cast("int")), f"rank-{column}s")


def fit(data: DataFrame, rank: int = 16, steps: int = 10, confidence: float = 10.0, shrink: float = 0.05, seed: int = 0) -> Factors:
    """Factors of ``user, item, w``."""
    from pyspark.ml.recommendation import ALS

    users, items = _numbers(data, "user"), _numbers(data, "item")
    if users.isEmpty():
        raise ValueError("no interactions to learn from")
    rows = data.join(users.withColumnRenamed("number", "u").hint("merge"), "user").join(items.withColumnRenamed("number", "i"), "item").select("u", "i", F.col("w").cast("float").alias("w"))
    rows, blocks = materialise(rows, "rank-rows"), max(2, int(data.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # a user's factors go to each block that holds one of its items, so blocks of few items multiply what is shuffled
    item_blocks = min(blocks, max(4, math.ceil(items.count() / ITEMS_A_BLOCK), math.ceil(rows.count() / ROWS_A_BLOCK)))
    als = ALS(rank=rank, maxIter=steps, regParam=shrink, alpha=confidence, implicitPrefs=True, userCol="u", itemCol="i", ratingCol="w", seed=seed, numUserBlocks=blocks, numItemBlocks=item_blocks, coldStartStrategy="drop")
    model = als.fit(rows)
    named = lambda factors, numbers, name: factors.join(numbers.hint("merge"), factors["id"] == numbers["number"]).select(name, "features")
    return Factors(model, named(model.userFactors, users, "user"), named(model.itemFactors, items, "item"), users, items)


def _held(factors: Factors, took: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """The same as ``recommend`` where all items' factors fit a task: one pass over users, no product of tables."""
    found = factors.items.join(factors.item_numbers, "item").select("item", "number", "features").orderBy("item").collect()
    names, at = np.array([r["item"] for r in found], dtype=object), {r["number"]: i for i, r in enumerate(found)}
    matrix = np.array([r["features"] for r in found], dtype=np.float32)  # in order of names: of equal scores the first comes first
    lookup = np.full(max(at, default=0) + 1, -1)
    lookup[list(at)] = list(at.values())
    most = max(1, SCORES_AT_ONCE // max(1, len(names)))

    def ranked(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            for start in range(0, len(whole), most):
                part = whole.iloc[start : start + most]
                exact = np.array(part["features"].tolist(), dtype=np.float32) @ matrix.T
                scores = np.round(exact.astype(np.float64), 6)
                taken = [np.asarray(t, dtype=np.int64) for t in part["took"]]
                row = np.repeat(np.arange(len(part)), [len(t) for t in taken])
                number = np.concatenate(taken) if taken else np.empty(0, dtype=np.int64)
                place = np.where(number < len(lookup), lookup[np.minimum(number, len(lookup) - 1)], -1)
                scores[row[place >= 0], place[place >= 0]] = -np.inf
                best = np.argsort(-scores, axis=1, kind="stable")[:, : max(k, 0)]
                top = np.take_along_axis(scores, best, axis=1)
                kept = np.isfinite(top)
                who = np.broadcast_to(np.arange(len(part))[:, None], best.shape)[kept]
                rank = np.broadcast_to(np.arange(1, best.shape[1] + 1, dtype=np.int32), best.shape)[kept]
                yield pd.DataFrame({"user": part["user"].to_numpy()[who], "item": names[best[kept]], "rank": rank, "score": top[kept]})

    numbers = took.join(factors.item_numbers, "item").groupBy("user").agg(F.collect_list("number").alias("took"))
    asked = known.join(numbers.hint("merge"), "user", "left").select("user", "number", F.coalesce("took", F.array().cast("array<int>")).alias("took"))
    rows = asked.join(factors.model.userFactors.hint("merge"), F.col("number") == F.col("id")).select("user", "features", "took")
    return rows.mapInPandas(ranked, "user string, item string, rank int, score double")


def recommend(factors: Factors, history: DataFrame, users: DataFrame, k: int = 5) -> DataFrame:
    """``user, item, rank, score``: the k best items of each of ``users`` that its history lacks."""
    known = users.select("user").distinct().join(factors.user_numbers.hint("merge"), "user")
    took = history.select("user", "item").distinct()
    if factors.item_numbers.count() * factors.model.rank <= HELD_CELLS:
        return _held(factors, took, known, k)
    sizes = took.join(known.hint("merge"), "user").groupBy("user").agg(F.first("number").alias("u"), F.count("*").alias("n"))
    asked = materialise(known.join(sizes.select("user", "n").hint("merge"), "user", "left").select("user", F.col("number").alias("u"), F.ceil(F.log2(F.coalesce("n", F.lit(0)) + 1)).cast("int").alias("power")), "rank-users")
    listed = None
    for power in sorted(r["power"] for r in asked.select("power").distinct().collect()):  # 30 at most
        top = factors.model.recommendForUserSubset(asked.where(F.col("power") == power).select("u"), k + 2**power)
        part = top.select("u", F.explode("recommendations").alias("r")).select("u", F.col("r.i").alias("number"), F.col("r.rating").cast("double").alias("score"))
        listed = part if listed is None else listed.unionByName(part)
    if listed is None:
        return asked.select("user", F.lit("").alias("item"), F.lit(0).alias("rank"), F.lit(0.0).alias("score")).limit(0)
    fresh = listed.join(asked.select("u", "user").hint("merge"), "u").join(factors.item_numbers, "number").select("user", "item", "score").join(took.hint("merge"), ["user", "item"], "left_anti")
    place = F.row_number().over(Window.partitionBy("user").orderBy(F.desc(F.round("score", 6)), "item"))
    return fresh.withColumn("rank", place).where(F.col("rank") <= k).select("user", "item", "rank", F.round("score", 6).alias("score"))


def quality(recs: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """``ndcg, hit_rate, users_scored`` at k over the users of ``relevant``; a user without ranks counts as 0."""
    size = relevant.select("user", "item").distinct().groupBy("user").agg(F.count("*").alias("n"))
    found = recs.where(F.col("rank") <= k).join(relevant.select("user", "item").distinct().hint("merge"), ["user", "item"])
    gains = found.groupBy("user").agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("gain"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1))
    per = size.join(gains.hint("merge"), "user", "left").select((F.coalesce("gain", F.lit(0.0)) / ideal).alias("ndcg"), F.col("gain").isNotNull().cast("double").alias("hit"))
    return per.agg(F.round(F.avg("ndcg"), 4).alias("ndcg"), F.round(F.avg("hit"), 4).alias("hit_rate"), F.count("*").alias("users_scored"))
