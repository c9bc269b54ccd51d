"""Connected components of a link table by alternating large-star and small-star rounds.

Public method: Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Each round is
two aggregations (combined before the shuffle) and two joins against one row per node, so a node
with very many links is split like any skewed join and no node's links meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logjury.llm.shared import stored


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``(node, component)`` for every node of a link; ``component`` is its smallest reachable node.

    Links are undirected; loops, repeated links and links with null ends are ignored. An empty
    table gives an empty table. The nodes must be of one orderable type.
    """
    pair = links.where(F.col(left) != F.col(right)).select(
        F.greatest(left, right).alias("hi"), F.least(left, right).alias("lo")
    )
    current = stored(pair.distinct())
    mark = _mark(current)
    while mark[0]:
        current = stored(_small_star(_large_star(current)))
        before, mark = mark, _mark(current)
        if mark == before:
            break
    members = current.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = current.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return members.union(roots)


def _large_star(pairs: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = pairs.union(pairs.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    around = both.select(F.col("hi").alias("node"), F.col("lo").alias("other"))
    least = around.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
    larger = around.where(F.col("other") > F.col("node"))
    return larger.join(least, "node").select(F.col("other").alias("hi"), F.col("least").alias("lo")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = pairs.groupBy("hi").agg(F.min("lo").alias("least"))
    moved = (
        pairs.join(least, "hi")
        .where(F.col("lo") != F.col("least"))
        .select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
    )
    return moved.union(least.select("hi", F.col("least").alias("lo"))).distinct()


def _mark(pairs: DataFrame) -> tuple[int, int]:
    """Count and order-free checksum; equal marks of two rounds mean nothing moved."""
    row = pairs.agg(
        F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("hi", "lo")), F.lit(0))
    ).first()
    return row[0], row[1]
