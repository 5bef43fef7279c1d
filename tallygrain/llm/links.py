"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallygrain.llm.shared import saved


def components(links: DataFrame, purpose: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has a link; root is the smallest reachable node.

    ``links`` has long columns a and b.  Each round hangs every node below the
    smallest node it knows, first from larger to smaller neighbours and then
    among the smaller ones, until only stars are left; the number of rounds
    grows with the logarithm of the longest chain.  All steps are aggregations
    and equi-joins with one row per node on one side, and each round is written
    to the shared folder, so neither lineage nor a hub's neighbours pile up.
    """
    edges = saved(
        links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), purpose
    )
    before = _sum(edges)
    for _ in range(rounds):
        if before[0] == 0:
            break
        edges = saved(_small_star(_large_star(edges)), purpose)
        now = _sum(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots)


def _sum(edges: DataFrame) -> tuple:
    key = F.xxhash64("hi", "lo")
    return tuple(edges.agg(F.count("*"), F.sum(key.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftrightunsigned(key, 32))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, are linked to the smallest of them."""
    edges = edges.distinct()
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").where(F.col("lo") > F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()
