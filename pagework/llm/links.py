"""Connected components of a link table, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagework.plans.stage import stage

ROUNDS = 60


def _hooked(edges: DataFrame, mine: str) -> DataFrame:
    """Neighbours ``v`` of every ``u`` with ``m``, the least of u and those
    neighbours.  Minima are reduced before the shuffle; a node with very many
    neighbours is only read in a join, which skew splitting deals out."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    return joined.select("u", "v", F.least("u", "m").alias("m")).where(mine)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): ``root`` is the smallest
    node of its component.  Nodes that are in no link are not returned.

    Every round is written to the shared folder; the driver sees a count and a
    checksum only.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    for _ in range(ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hooked(both, "v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _hooked(large, "u > v")
        small = small.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = stage(small, "stars")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components have not settled in {ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
