"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.scratch import remove, stored


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``node, root`` for every node of an edge; ``root`` is the smallest node reachable.

    Each round joins every node's edges with its smallest neighbour, first from the smaller end
    (large star), then from the larger end (small star), until every edge points at its root.
    Rounds grow with the logarithm of a component's size; the table of a round replaces that of
    the one before. Edges with a null end and loops are dropped; an empty table gives an empty one.
    """
    low, high = F.least(u, v), F.greatest(u, v)
    stars, path = stored(edges.where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v))).select(high.alias("a"), low.alias("b")).distinct(), "edges")
    seen = None
    while True:
        state = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select("a", F.col("m").alias("b")).unionByName(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        old = path
        stars, path = stored(small, "stars")
        remove(edges.sparkSession, old)
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return roots.unionByName(stars.select(F.col("a").alias("node"), F.col("b").alias("root")))
