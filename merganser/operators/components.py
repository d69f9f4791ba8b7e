"""Connected components by stars: edges of a node move to its least neighbour until every component is one star.

Each round is two aggregations and two joins by node; a path of n nodes takes about log2(n) rounds. Edges stay distributed, and
each round is cut to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merganser.operators.lineage import cut


def _round(edges: DataFrame) -> DataFrame:
    """edges: high, low."""
    seen = edges.select(F.col("high").alias("node"), F.col("low").alias("other")).unionByName(edges.select(F.col("low").alias("node"), F.col("high").alias("other")))
    least = seen.groupBy("node").agg(F.least("node", F.min("other")).alias("to"))
    # what lies above a node hangs on the node's least neighbour, or on the node
    large = seen.filter("other > node").join(least, "node").select(F.col("other").alias("high"), F.col("to").alias("low")).distinct()
    lowest = large.groupBy("high").agg(F.min("low").alias("to"))
    # what lies below it hangs there, too
    small = large.join(lowest, "high").filter("low > to").select(F.col("low").alias("high"), F.col("to").alias("low"))
    return small.unionByName(lowest.select("high", F.col("to").alias("low"))).distinct()


def _stars(edges: DataFrame) -> bool:
    ends = edges.select(F.col("high").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("low").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    other = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)")
    return other.limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge to another, where root is the least node that it is connected with; roots are left out.

    edges: a, b, in any order, repeated or not; null ends count for nothing.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct())
    while not _stars(now):
        now = cut(_round(now))
    return now.select(F.col("high").alias("node"), F.col("low").alias("root"))
