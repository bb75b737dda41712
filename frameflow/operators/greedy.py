"""Greedy choices in a fixed order, expressed as rounds over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import checkpoint, forget


def keep_unblocked(nodes: DataFrame, blocks: DataFrame, node: str) -> DataFrame:
    """Walk nodes in order and keep each one no kept node blocks.

    blocks: (src, dst), src earlier than dst. Every round settles all nodes
    whose blockers are settled, so rounds follow the longest chain, not the
    number of nodes.
    """
    undecided = checkpoint(nodes.select(node).distinct())
    edges = checkpoint(blocks.select("src", "dst").distinct())
    kept, settled = nodes.select(node).limit(0), None
    while not undecided.isEmpty():
        waiting = (edges.join(undecided.select(F.col(node).alias("src")), "src", "left_semi")
                   .select(F.col("dst").alias(node)).distinct())
        free = checkpoint(undecided.join(waiting, node, "left_anti"))
        more = checkpoint(kept.unionByName(free))
        forget(settled)
        kept = settled = more
        blocked = (edges.join(free.select(F.col(node).alias("src")), "src", "left_semi")
                   .select(F.col("dst").alias(node)).distinct())
        rest = checkpoint(undecided.join(free, node, "left_anti")
                          .join(blocked, node, "left_anti"))
        forget(undecided, free)
        undecided = rest
    return kept
