"""Connected components of an edge table, without moving it to the driver."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root``: the least node of each component, for every node of ``edges`` (``a``, ``b``).

    Alternates large-star and small-star steps: each joins every neighbourhood to
    its least node, so the rounds grow with the logarithm of the longest path. Every
    step is a stored table. The least nodes come from partial minima, a row a task,
    and are stored before they are joined back: so the join has a shuffle of its own,
    in which adaptive execution can split a hub.
    """
    edges = stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges"
    )
    while True:
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("near")).select("a", F.least("near", "a").alias("root")), "least")
        # Large star: neighbours above a node go to the least of its neighbourhood.
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b"))
        large = stored(large.where("a <> b").distinct(), "large-star")
        # Small star: neighbours below a node, and the node, go to the least of them.
        down = stored(large.groupBy("a").agg(F.min("b").alias("root")), "below")
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("root").alias("b"))
        small = small.union(down.select("a", F.col("root").alias("b"))).where("a <> b").distinct()
        small = stored(small, "small-star")
        # Done when every node points at one root that points nowhere.
        heads = small.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        chained = small.join(small.select(F.col("a").alias("b")), "b", "left_semi")
        if heads.where("n > 1").isEmpty() and chained.isEmpty():
            roots = small.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return small.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
        edges = small
