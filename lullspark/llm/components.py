"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lullspark.llm.common import stored


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step over ``a > b`` edges: neighbours of a node move to the least of them.

    Large: neighbours above the node; small: those below it and the node itself. The
    least neighbour is a partial aggregate, so a node of any degree is no bottleneck.
    """
    if small:
        around = edges
    else:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = around.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    linked = around.join(least, "a")
    if small:
        moved = linked.select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        moved = moved.select("e.a", F.col("e.m").alias("b"))
    else:
        moved = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links (a, b)``; the root is the least node.

    Large-star and small-star steps alternate (Kiveris et al., 2014) until the edges no
    longer change. Each round is written to the shared folder, which cuts the lineage.
    """
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges, seen = stored(ordered.where("a <> b").distinct(), "links"), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state[0] == 0 or state == seen:
            roots = edges.select(F.explode(F.array("a", "b")).alias("node"), F.col("b").alias("root"))
            return roots.distinct()
        seen = state
        edges = stored(_star(_star(edges, small=False), small=True), "links")
