"""Connected components of a large edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); root is the smallest
    node of its component.

    Alternates the large-star and the small-star step: each node links its
    larger (smaller) neighbours to its smallest one, until the edges are a star
    around each root.  A round is two group-and-join steps over the edges, which
    never outnumber those given; rounds grow with the logarithm of the nodes.
    Each round is a table in the shared folder, so that a lost executor
    costs a re-read, and one count per round comes to the driver.
    """
    now = materialize(edges.select("a", "b").where("a <> b"), "edges")
    sign = None
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: every edge now runs from the larger node a to the smaller b.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        nxt = (small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                            F.col("m").alias("b")).distinct())
        now = materialize(nxt, "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == sign:
            break
        sign = tuple(seen)
    # Stars: each node but the roots has one edge, to its root.
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
