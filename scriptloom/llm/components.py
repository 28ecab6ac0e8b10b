"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.workspace import write_table


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node of ``edges`` (columns ``a``, ``b`` of one orderable type).

    Returns ``node``, ``component`` for every node that has an edge; a node that is
    its own component's smallest is included.  Self-loops, repeated edges and nulls
    are ignored.  Each round is two aggregations with map-side combine and two joins
    (a hub's edges are split by AQE); its result is written to the shared folder.
    Nothing but two numbers a round goes to the driver.
    """
    canonical = (
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    current = write_table(canonical, "edges")
    mark = None
    for _ in range(max_rounds):
        seen = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(seen) == mark or seen[0] == 0:
            break
        mark = tuple(seen)
        # Edges (a, b) have a < b.  Large star: every larger neighbour of a node goes to the least of its neighbourhood.
        least = (
            current.select(F.col("a").alias("u"), F.col("b").alias("v"))
            .union(current.select(F.col("b").alias("u"), F.col("a").alias("v")))
            .groupBy("u")
            .agg(F.min("v").alias("m"))
            .select("u", F.least("u", "m").alias("m"))
        )
        large = current.join(least, current["a"] == least["u"]).select(F.col("m").alias("a"), "b").distinct()
        # Small star: every smaller neighbour of a node, and the node, go to the least of them.
        lower = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        small = large.join(lower, large["b"] == lower["u"]).select(
            F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("e")
        )
        current = write_table(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
    else:
        raise RuntimeError(f"components not found in {max_rounds} rounds")
    roots = current.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return current.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots)
