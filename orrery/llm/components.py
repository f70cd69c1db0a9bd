"""Connected components of a link table by alternating star contraction; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orrery.storage import discard, stored


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``a, b`` (undirected, of any type that can be ordered) to ``node, root`` for every node that has a link; root is the smallest reachable node.

    Each round joins every node's neighbours to the least of them (large star over larger neighbours, then small star over
    smaller ones). Minima are partial aggregates; rounds are written to the shared folder, so that lineage stays short.
    A hub's rows meet its one minimum in a join; minima are stored first, so that both sides are plain shuffles and AQE can split the hub's
    (merged by a hint: compressed files tell Spark too low a size, and no minima may be broadcast).
    It takes about as many rounds as the logarithm of a component's width; after ``most_rounds`` it is an error.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    for _ in range(most_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "minima")
        large = stored(both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "stars")
        least2 = stored(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = large.join(least2.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least2.select("u", F.col("m").alias("v")))
        new = stored(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        # Done when every node has one link, to a node that has none below it.
        many = new.groupBy("u").count().filter("count > 1").limit(1).count()
        deep = 0 if many else new.join(new.select(F.col("u").alias("w")).hint("merge"), F.col("v") == F.col("w"), "left_semi").limit(1).count()
        discard(edges, least, large, least2)
        edges = new
        if not many and not deep:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
