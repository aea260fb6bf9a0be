"""Connected components of a graph that stays distributed (alternating large-star and small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsespark.llm._common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges(a, b)`; component is the smallest node reachable.

    Self loops and repeated edges are harmless. No neighbourhood is ever collected: each round takes the minimum of
    a node's neighbours by a combinable aggregate and joins it back, so a hub's rows can be split. Isolated nodes are
    not in the result. An empty input gives an empty result.
    """
    star = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        both = star.union(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        after = stored(small.where("a <> b").distinct(), "edges")
        # stable once every node points at one root and no root points anywhere
        unsettled = after.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
        star = after
        if not unsettled and not after.select("b").distinct().join(after.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count():
            break
    return star.select(F.col("a").alias("node"), F.col("b").alias("component")).union(star.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
