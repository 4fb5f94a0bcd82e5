"""Connected components of an undirected graph, as rounds of joins.

Each round reconnects the neighbours of a node to the smallest of them, once from the larger side
and once from the smaller one. After a number of rounds that grows with the logarithm of the graph
all edges are stars around the smallest node of a component. Nothing but the edge count reaches the
driver; each round is written to the shared checkpoint folder, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    out = both.where(F.col("b") > F.col("a")).join(low, F.col("a") == F.col("k"))
    return out.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
    out = down.join(low, F.col("a") == F.col("k"))
    moved = out.select(F.col("b").alias("a"), F.col("m").alias("b"))
    kept = low.select(F.col("k").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(kept).where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (a, b); the component is its smallest node.

    Loops and repeated edges do no harm, edges with a null end are left out, no edges give no rows.
    """
    now = cut_lineage(edges.where("a is not null and b is not null and a != b").select("a", "b").distinct())
    for _ in range(MAX_ROUNDS):
        after = cut_lineage(_small_star(_large_star(now)))
        # a settled set of stars is its own image
        changed = after.exceptAll(now).limit(1).count() or now.count() != after.count()
        now = after
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
