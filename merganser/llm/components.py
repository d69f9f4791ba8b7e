"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is two aggregations and two joins on node ids; rounds are written to the shared folder, which cuts lineage.
Edges are never collected. Nodes with very many edges don't meet in one join key: such hubs are few, as the number of edges
bounds them, so they are broadcast to their edges, which stay where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merganser.llm.common import Workspace


#: A node is a hub from so many edges on; and at most so many nodes are hubs, whatever the number of edges.
HUB, HUBS = 1_000_000, 100_000
#: Edges of one file of a round.
EDGES = 500_000


def _with_least(edges: DataFrame, heavy: int | None) -> DataFrame:
    """(a, b, m): edges with the least neighbour of a, or a itself. heavy: None if all edges are fewer than a hub's."""
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")).withColumnRenamed("a", "node")
    if heavy is None:
        return edges.join(least, F.col("a") == F.col("node")).select("a", "b", "m")
    hubs = least.filter(F.col("n") > heavy)  # at most the number of edges / heavy rows of three numbers
    some = least.filter(F.col("n") <= heavy)
    of_hubs = edges.join(F.broadcast(hubs), F.col("a") == F.col("node"))
    others = edges.join(F.broadcast(hubs.select(F.col("node").alias("hub"))), F.col("a") == F.col("hub"), "left_anti").join(some, F.col("a") == F.col("node"))
    return others.select("a", "b", "m").unionByName(of_hubs.select("a", "b", "m"))


def _large_star(edges: DataFrame, heavy: int | None) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both, heavy).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, heavy: int | None) -> DataFrame:
    """edges: a > b."""
    joined = _with_least(edges, heavy)
    least = edges.groupBy("a").agg(F.min("b").alias("b"))
    return joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least)


def connected_components(edges: DataFrame, work: Workspace, name: str = "components") -> DataFrame:
    """(node, root) of every node that has an edge, where root is the least node it is connected with; roots are left out.

    edges: a, b of type long, in any order, repeated or not.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before, k = work.write(now, f"{name}-0"), None, 0
    while True:
        n, check = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if n == 0 or (n, check) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, k = (n, check), k + 1
        heavy = max(HUB, 2 * n // HUBS) if 2 * n > HUB else None
        # rounds do not add edges: few of them need no more files
        now = work.write(_small_star(_large_star(now, heavy).distinct(), heavy).distinct().coalesce(1 + n // EDGES), f"{name}-{k}")
        work.drop(f"{name}-{k - 1}")
