"""Classification of frame rows: folds, a forest, and metrics as aggregations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.scratch import free_names, materialise
from tallyframe.operators.ordering import running_before

TREES, DEPTH = 60, 8


def folds(df: DataFrame, key: str, label: str, k: int, seed: int = 0) -> DataFrame:
    """``df`` with ``fold``: rows of each class dealt round in hash order of their key.

    A class is ranked in 4096 ranges of the hash, whose counts give the rank that each begins with.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(f"`{key}`").cast("string")).cast("binary"))
    if "fold" in (c.lower() for c in df.columns):
        raise ValueError("fold: the table has a column of that name already")
    at, place, name, of, start = free_names(df, "order", "range", "class", "of", "start")
    ranged = df.withColumns({at: order, place: F.coalesce(F.substring(order, 1, 3), F.lit(""))})
    sizes = ranged.groupBy(F.col(f"`{label}`").alias(name), F.col(place).alias(of)).count()
    ahead = Window.partitionBy(name).orderBy(of).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(name, of, F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias(start))
    joined = ranged.join(starts, F.col(f"`{label}`").eqNullSafe(F.col(name)) & (F.col(place) == F.col(of)))
    rank = F.col(start) + F.row_number().over(Window.partitionBy(f"`{label}`", place).orderBy(at)) - 1
    return joined.withColumn("fold", (rank % k).cast("int")).select(*(F.col(f"`{c}`") for c in df.columns), "fold")


def populations(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """``df`` with ``population``: scorable, to_predict (no label) or incomplete (a feature lacks)."""
    whole = F.lit(True)
    for f in features:
        whole = whole & F.col(f"`{f}`").isNotNull()
    return df.withColumn("population", F.when(~whole, "incomplete").when(F.col(label).isNull(), "to_predict").otherwise("scorable"))


@dataclass
class LeafWeighted:
    """A forest whose splits know no weights, and the class shares of each tree's leaves, weighted."""

    model: object
    #: By tree, leaf and class.
    shares: list[list[list[float]]]


def forest(train: DataFrame, label: str, features: list[str], trees: int = TREES, depth: int = DEPTH, balanced: bool = False, seed: int = 0):
    """A fitted pipeline of a random forest; a single class is refused.

    ``balanced`` weighs classes by how rare they are, in the leaves only: trees are the same with and without, and each
    leaf's shares come from the training rows that lie in it, counted by tree, leaf and class.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    counts = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}
    if len(counts) < 2:
        raise ValueError(f"{label}: one class only ({', '.join(map(str, counts))}), nothing to tell apart")
    stages = [VectorAssembler(inputCols=features, outputCol="__features")]
    settings = {"labelCol": "__label", "featuresCol": "__features", "numTrees": trees, "maxDepth": depth, "impurity": "gini", "featureSubsetStrategy": "sqrt", "seed": seed, "probabilityCol": "__probability", "rawPredictionCol": "__raw", "predictionCol": "__prediction", "leafCol": "__leaf"}
    rows = train.withColumn("__label", F.col(label).cast("double"))
    model = Pipeline(stages=[*stages, RandomForestClassifier(**settings)]).fit(rows)
    if not balanced:
        return model
    total = sum(counts.values())
    weight = {int(c): total / (len(counts) * n) for c, n in counts.items()}
    return LeafWeighted(model, leaf_shares(model.transform(rows), "__label", weight, trees))


def leaf_shares(placed: DataFrame, label: str, weight: dict[int, float], trees: int) -> list[list[list[float]]]:
    """Weighted class shares by tree and leaf: at most ``trees * 2 ** depth`` leaves, counted in one aggregation."""
    from pyspark.ml.functions import vector_to_array

    leaves = placed.select(F.col(label).cast("int").alias("class"), F.posexplode(vector_to_array("__leaf")).alias("tree", "leaf"))
    counts = leaves.groupBy("tree", F.col("leaf").cast("int").alias("leaf"), "class").count().collect()
    width, found = max(weight) + 1, [{} for _ in range(trees)]
    for r in counts:
        found[r["tree"]].setdefault(r["leaf"], [0.0] * width)[r["class"]] += r["count"] * weight[r["class"]]
    return [[[x / (sum(own) or 1.0) for x in own] for leaf in range(max(by, default=-1) + 1) for own in [by.get(leaf, [0.0] * width)]] for by in found]


def predict(model, df: DataFrame, positive: int = 1, threshold: float = 0.5) -> DataFrame:
    """``df`` with ``proba`` of the positive class and ``pred``; of classes that are equally likely, the larger."""
    from pyspark.ml.functions import vector_to_array

    if isinstance(model, LeafWeighted):
        shares = df.sparkSession.createDataFrame([(model.shares,)], "__shares array<array<array<double>>>")
        scored = model.model.transform(df).crossJoin(F.broadcast(shares))  # one row
        width = len(model.shares[0][0])
        own = F.transform(vector_to_array("__leaf"), lambda leaf, tree: F.get(F.get(F.col("__shares"), tree), leaf.cast("int")))
        mean = lambda c: F.aggregate(F.col("__own"), F.lit(0.0), lambda a, x: a + F.get(x, F.lit(c))) / len(model.shares)
        scored = scored.withColumn("__own", own).withColumn("__shared", F.array(*(mean(c) for c in range(width)))).drop("__own", "__shares")
        best = F.array_max(F.transform("__shared", lambda p, c: F.struct(F.round(p, 12).alias("p"), c.alias("c"))))["c"]
        shared, size = F.col("__shared"), F.size("__shared")
    else:
        scored = model.transform(df)
        shared, size, best = vector_to_array("__probability"), F.size(vector_to_array("__probability")), F.col("__prediction").cast("int")
    p = F.get(shared, F.lit(positive))
    said = scored.withColumn("proba", p).withColumn("pred", F.when(size == 2, F.when(p >= threshold, positive).otherwise(1 - positive)).otherwise(best))
    return said.drop("__features", "__raw", "__probability", "__prediction", "__leaf", "__shared")


def cross_validate(df: DataFrame, key: str, label: str, features: list[str], k: int = 5, trees: int = TREES, depth: int = DEPTH, seed: int = 0, balanced: bool = False) -> DataFrame:
    """Out-of-fold ``proba, pred`` of every scorable row."""
    counts = [r["count"] for r in df.groupBy(label).count().collect()]
    k = max(2, min(k, min(counts, default=2)))
    dealt, out = materialise(folds(df, key, label, k, seed), "folds"), None  # read by every fold's forest
    for f in range(k):
        part = predict(forest(dealt.where(F.col("fold") != f), label, features, trees, depth, balanced, seed), dealt.where(F.col("fold") == f))
        out = part if out is None else out.unionByName(part)
    return out


def deliverable(df: DataFrame, label: str, features: list[str], positive: int = 1, threshold: float = 0.5, trees: int = TREES, depth: int = DEPTH, seed: int = 0) -> DataFrame:
    """Every row with ``proba, pred`` and ``is_prediction``: no (its label is known), yes (predicted), unscorable (a feature lacks).

    The forest is fitted on the rows whose label is known; these have no prediction here (see ``cross_validate``).
    """
    rows = materialise(populations(df, label, features), "populations")
    known, asked, rest = (rows.where(F.col("population") == p).drop("population") for p in ("scorable", "to_predict", "incomplete"))
    nothing = {"proba": F.lit(None).cast("double"), "pred": F.lit(None).cast("int")}
    said = predict(forest(known, label, features, trees, depth, seed=seed), asked, positive, threshold)
    parts = [known.withColumns(nothing).withColumn("is_prediction", F.lit("no")), said.withColumn("is_prediction", F.lit("yes")), rest.withColumns(nothing).withColumn("is_prediction", F.lit("unscorable"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count("*").alias("rows"))


def per_class(df: DataFrame, label: str, pred: str) -> DataFrame:
    """``class, support, precision, recall, f1``."""
    pairs = confusion(df, label, pred)
    both = pairs.select(F.explode(F.array(F.struct(F.col("label").alias("class"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("pred").alias("class"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("x"), "rows", (F.col("label") == F.col("pred")).alias("same")).select("x.*", "rows", "same")
    sums = both.groupBy("class").agg(F.sum(F.col("t") * F.col("rows")).alias("support"), F.sum(F.col("p") * F.col("rows")).alias("predicted"), F.sum(F.when(F.col("same"), F.col("t") * F.col("rows")).otherwise(0)).alias("hit"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("hit"), F.col("predicted")), ratio(F.col("hit"), F.col("support"))
    return sums.select("class", "support", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(ratio(2 * p * r, p + r), 4).alias("f1"))


def roc_auc(df: DataFrame, label: Column, score: str) -> DataFrame:
    """``auc`` from average ranks, ties sharing theirs.

    Ranks come from counts by distinct score, added up within ranges of scores.
    """
    by = df.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.count_if(label).alias("pos"))
    ranked = running_before(by, "s", "n", "before").select("n", "pos", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))
    pos, total = F.sum("pos"), F.sum("n")
    return ranked.agg(F.round((F.sum(F.col("pos") * F.col("rank")) - pos * (pos + 1) / 2) / (pos * (total - pos)), 4).alias("auc"))


def macro_f1(classes: DataFrame) -> DataFrame:
    """``macro_f1``: the mean over all classes of ``per_class``, those only predicted included."""
    return classes.agg(F.round(F.avg("f1"), 4).alias("macro_f1"))


def verdict(lift: float | None, macro: float) -> str:
    """A word for how far a classifier beats the most common class; ``mixed`` if it finds some class badly."""
    if lift is None:
        return "no baseline"
    if lift > 10:
        return "trusted" if macro > 0.6 else "mixed"
    return "weak" if lift > 0 else "unpredictable"


def accuracy(df: DataFrame, label: str, pred: str) -> DataFrame:
    """``accuracy``, that of the most common class, and the lift over it in percent."""
    by = df.groupBy(label).agg(F.count("*").alias("n"), F.count_if(F.col(label) == F.col(pred)).alias("hit"))
    n, hit, most = F.sum("n"), F.sum("hit"), F.max("n")
    return by.agg(F.round(hit / n, 4).alias("accuracy"), F.round(most / n, 4).alias("baseline"), F.round((hit / most - 1) * 100, 4).alias("lift"))
