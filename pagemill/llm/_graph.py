"""Connected components of a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import release, stored


#: Up to so many edges, of 32 bytes, may meet in one task: all of a smaller table may be one node's.
FEW = 500_000
#: In a larger table a node is a hub from a share of all edges on that no more than HUBS nodes can have.
HUBS = 50_000


def _with(rows: DataFrame, per_node: DataFrame, edges: int) -> DataFrame:
    """``rows`` joined to ``per_node(u, m, n)`` by u; hubs (a bounded number) by broadcast, so no task gets all rows of one."""
    if edges <= FEW:
        return rows.join(per_node.drop("n"), "u")
    limit = max(FEW // 100, 2 * edges // HUBS)
    hubs = F.broadcast(per_node.where(F.col("n") > limit).drop("n"))
    others = rows.join(hubs.select("u"), "u", "left_anti").join(per_node.where(F.col("n") <= limit).drop("n"), "u")
    return rows.join(hubs, "u").unionByName(others)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges(u, v)`` with the smallest node of its component.

    Each round is two grouped minima and joins; edges stay in the cluster.  Minima are partial before
    they are shuffled, and hubs are joined by broadcast, so a node may have any number of neighbours.
    """
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    state, size = None, edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _with(both, low, size).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        tied = _with(large, low, size)
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges, old = stored(small.where("u <> v").distinct()), edges
        release(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state, size = now, now[0]
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
