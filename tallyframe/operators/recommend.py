"""Item-to-item recommendation as joins, aggregations and ranks over ``user, item, w``.

Tables with a row for each user are never broadcast, however small their files are: they would pass through the
driver. What a user's interactions become (pairs, scores) is many times the interactions, so these are dealt out by
their number, ``ROWS_A_TASK`` to a task, and not by the bytes they take before that.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import coerce
from tallyframe.functions.scratch import materialise
from tallyframe.operators.ordering import positions


def interactions(df: DataFrame, user: str, item: str, weight: str | None = None) -> DataFrame:
    """``user, item, w``: weights of repeated pairs add up; empty ids and weights that are no numbers go."""
    w = coerce.number(coerce.cell(df, weight), coerce.kind_of(df, weight)) if weight else F.lit(1.0)
    rows = df.select(F.col(f"`{user}`").cast("string").alias("user"), F.col(f"`{item}`").cast("string").alias("item"), w.alias("w"))
    return rows.where((F.col("user") != "") & (F.col("item") != "") & F.col("w").isNotNull()).groupBy("user", "item").agg(F.sum("w").alias("w"))


def split_order(salt: str = "") -> Column:
    """A fixed-width hash of salt, user and item."""
    return F.substring(F.md5(F.concat(F.lit(salt + "\0"), F.col("user"), F.lit("\0"), F.col("item")).cast("binary")), 1, 16)


def split(data: DataFrame, holdout: float = 0.3, salt: str = "") -> DataFrame:
    """``data`` with ``held``: the last of each user's items in hash order; one item is never held."""
    own = Window.partitionBy("user")
    n = F.count("*").over(own)
    held = F.when(n < 2, 0).otherwise(F.least(n - 1, F.greatest(F.lit(1), F.bround(n * F.lit(holdout), 0).cast("int"))))
    place = F.row_number().over(own.orderBy(split_order(salt)))
    return data.select("user", "item", "w", (place > n - held).alias("held"))


#: Items of a user that meet in one task.
BLOCK = 2000
#: Interactions that are dealt to one task, about.
ROWS_A_TASK = 100_000
#: Rows of item similarities that go to every task; more are joined by a shuffle.
BROADCAST_PAIRS = 200_000


def tasks_for(rows: DataFrame) -> int:
    """Tasks for work on interactions: more as there are more of them."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / ROWS_A_TASK))


def _in_blocks(train: DataFrame) -> DataFrame:
    """``user, item, w, block, i, j``: a user's items in blocks, each copied to the pairs of blocks it is in.

    Users of up to BLOCK items have one block and no copies; for others the pairs of items are dealt
    out over the cluster.
    """
    sizes = train.groupBy("user").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = train.join(sizes.hint("merge"), "user").withColumn("block", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    return placed.select("user", "item", "w", "block", F.explode(pairs).alias("p")).select("user", "item", "w", "block", "p.i", "p.j")


def item_similarity(train: DataFrame) -> DataFrame:
    """``item, other, sim`` of items that share a user, both ways round: cosine of their weights."""
    norms = train.groupBy("item").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    rows = _in_blocks(train).repartition(tasks_for(train), "user", "i", "j")
    a, b = rows.withColumnsRenamed({"w": "wa", "block": "ba"}), rows.withColumnsRenamed({"item": "other", "w": "wb", "block": "bb"})
    dots = a.join(b.hint("merge"), ["user", "i", "j"]).where("item < other and (ba <> bb or i = j)").groupBy("item", "other").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    both = dots.join(norms, "item").join(norms.toDF("other", "norm_other"), "other").where("norm > 0 and norm_other > 0").select("item", "other", (F.col("dot") / (F.col("norm") * F.col("norm_other"))).alias("sim"))
    turned = F.array(F.struct(F.col("item").alias("item"), F.col("other").alias("other")), F.struct(F.col("other").alias("item"), F.col("item").alias("other")))
    return both.select(F.explode(turned).alias("p"), "sim").select("p.item", "p.other", "sim")


def popularity(train: DataFrame) -> DataFrame:
    return train.groupBy("item").agg(F.sum("w").alias("pop"))


def _top(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("user").orderBy(F.desc(F.round("score", 9)), "item"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("user", "item", "rank", F.round("score", 6).alias("score"))


def popular_top(users: DataFrame, seen: DataFrame, pop: DataFrame, k: int) -> DataFrame:
    """The most popular items that each user has not seen.

    Items are ranked once. Between two items that a user has seen, all ranks are new to the user, so
    the first ``k`` new ranks come from the gaps between the user's own, in order.
    """
    ranked = positions(pop.select((-F.col("pop")).alias("p"), "item", "pop"), ["p", "item"], "place").drop("p")
    known = ranked.count()
    own = seen.select("user", "item").distinct().join(ranked.select("item", "place"), "item").select("user", "place")
    marks = users.select("user", F.explode(F.array(F.lit(-1).cast("long"), F.lit(known).cast("long"))).alias("place")).unionByName(own.join(users.hint("merge"), "user", "left_semi"))
    by = Window.partitionBy("user").orderBy("place")
    new = F.col("place") + 2 - F.row_number().over(by)  # new ranks up to here, and the next mark
    gaps = marks.select("user", "place", new.alias("before"), F.lead("place").over(by).alias("next"))
    wide = gaps.where((F.col("next") - F.col("place") > 1) & (F.col("before") < k))
    listed = wide.select("user", "before", "place", F.posexplode(F.sequence(F.col("place") + 1, F.least(F.col("next") - 1, F.col("place") + k - F.col("before")))).alias("step", "at"))
    chosen = listed.select("user", F.col("at").alias("place"), (F.col("before") + F.col("step") + 1).cast("int").alias("rank"))
    return chosen.join(ranked, "place").select("user", "item", "rank", F.round(F.col("pop").cast("double"), 6).alias("score"))


def _scores(history: DataFrame, sim: DataFrame, users: DataFrame | None) -> DataFrame:
    """``user, item, score`` of items that are similar to a user's own and not among them.

    Few similarities go to every task as a list for each item: a user's interactions are shuffled once, by user, and
    sums, what is taken already, and ranks come from the same task. With more similarities the products are shuffled.
    """
    tasks = tasks_for(history)
    own = history.select("user", "item", "w").repartition(tasks, "user")
    if users is not None:
        own = own.join(users.select("user").repartition(tasks, "user").hint("merge"), "user", "left_semi")
    if sim.limit(BROADCAST_PAIRS + 1).count() > BROADCAST_PAIRS:
        found = own.join(sim, "item").groupBy("user", "other").agg(F.sum(F.col("sim") * F.col("w")).alias("score"))
        return found.select("user", F.col("other").alias("item"), "score").join(history.select("user", "item").hint("merge"), ["user", "item"], "left_anti")
    lists = sim.groupBy("item").agg(F.collect_list(F.struct("other", "sim")).alias("near"))
    itself = F.array(F.struct(F.col("item").alias("other"), F.lit(None).cast("double").alias("sim")))
    near = own.join(F.broadcast(lists), "item", "left").select("user", "w", F.explode(F.when(F.col("near").isNull(), itself).otherwise(F.concat("near", itself))).alias("x"))
    sums = near.groupBy("user", F.col("x.other").alias("item")).agg(F.sum(F.col("x.sim") * F.col("w")).alias("score"), F.count_if(F.col("x.sim").isNull()).alias("taken"))
    return sums.where("taken = 0").select("user", "item", "score")


def recommend(history: DataFrame, sim: DataFrame, pop: DataFrame, k: int = 5, users: DataFrame | None = None) -> DataFrame:
    """``user, item, rank, score`` from similar items, popular ones for users without a score."""
    top = materialise(_top(_scores(history, materialise(sim, "rec-similar"), users), k), "rec-top")
    users = history.select("user").distinct() if users is None else users
    cold = materialise(users.join(top.select("user").distinct().hint("merge"), "user", "left_anti"), "rec-cold")
    if cold.isEmpty():
        return top
    return top.unionByName(popular_top(cold, history.join(cold.hint("merge"), "user", "left_semi"), pop, k))


def ranking_metrics(recs: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """``precision, recall, map`` averaged over the users of ``relevant``."""
    size = relevant.groupBy("user").agg(F.count("*").alias("n_relevant"))
    listed = recs.groupBy("user").agg(F.count("*").alias("n_listed"))
    found = recs.join(relevant.select("user", "item").hint("merge"), ["user", "item"]).withColumn("hit", F.row_number().over(Window.partitionBy("user").orderBy("rank")))
    hits = found.groupBy("user").agg(F.count("*").alias("hits"), F.sum(F.col("hit") / F.col("rank")).alias("gain"))
    per = size.join(listed.hint("merge"), "user", "left").join(hits.hint("merge"), "user", "left")
    n = F.coalesce("hits", F.lit(0))
    ap = F.when(n > 0, F.col("gain") / F.least("n_relevant", "n_listed")).otherwise(0.0)
    return per.agg(F.round(F.avg(n / F.lit(k)), 4).alias("precision"), F.round(F.avg(n / F.col("n_relevant")), 4).alias("recall"), F.round(F.avg(ap), 4).alias("map"), F.count("*").alias("users_scored"))


def evaluate(data: DataFrame, k: int = 5, holdout: float = 0.3, folds: int = 1) -> DataFrame:
    """A row for each fold: ranking metrics of the recommender and of popularity, lift and coverage.

    What several plans read (splits, similarities, popularity, lists) is computed once and written to the shared folder.
    """
    rows, once = [], lambda df: materialise(df, "rec-evaluate")
    for fold in range(folds):
        parts = once(split(data, holdout, str(fold) if folds > 1 else ""))
        train, held = parts.where("not held").drop("held"), parts.where("held").drop("held")
        users, pop = once(held.select("user").distinct()), once(popularity(train))
        recs = once(recommend(train, item_similarity(train), pop, k, users))
        base = once(popular_top(users, train.join(users.hint("merge"), "user", "left_semi"), pop, k))
        parts = [
            ranking_metrics(recs, held, k),
            ranking_metrics(base, held, k).toDF("popular_precision", "popular_recall", "popular_map", "n"),
            recs.agg(F.count_distinct("item").alias("covered")),
            pop.agg(F.count("*").alias("items_known")),
        ]
        one = parts[0].withColumn("fold", F.lit(fold))
        for p in parts[1:]:  # one row each
            one = one.join(p.withColumn("fold", F.lit(fold)), "fold")
        lift = F.when(F.col("popular_precision") > 0, F.round((F.col("precision") / F.col("popular_precision") - 1) * 100, 2)).when(F.col("precision") > 0, 100.0)
        rows.append(one.select("fold", "users_scored", "items_known", "precision", "recall", "map", "popular_precision", "popular_recall", "popular_map", lift.alias("lift"), F.round(F.col("covered") / F.col("items_known"), 4).alias("coverage")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def summary(evaluated: DataFrame) -> DataFrame:
    """One row from the folds of ``evaluate``: averages of what was measured, and the spread of the lift."""
    means = [c for c in evaluated.columns if c != "fold"]
    return evaluated.agg(F.count("*").alias("folds"), *(F.round(F.avg(c), 4).alias(c) for c in means), F.min("lift").alias("lift_min"), F.max("lift").alias("lift_max")).where("folds > 0")


def deliverable(recs: DataFrame, user: str, item: str) -> DataFrame:
    """``recommend``'s rows under the caller's names, marked as recommendations."""
    return recs.select(F.col("user").alias(user), F.col("item").alias(item), "rank", "score", F.lit("yes").alias("is_recommendation"))


def verdict(lift: float | None, spread: tuple[float, float] | None = None, precision: float | None = None) -> str:
    """A word for how far the recommender beats popularity; a spread across zero is never trusted.

    ``lift`` is null where popularity found nothing; a ``precision`` of 0 means that nobody took anything.
    """
    if precision == 0:
        return "unpredictable"
    if lift is None:
        return "not scored" if precision is None else "no baseline"
    if spread and spread[0] < 0 < spread[1]:
        return "unproven"
    return "trusted" if lift > 20 else "weak" if lift > 0 else "tied" if lift == 0 else "unpredictable"
