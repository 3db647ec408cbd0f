"""Connected components by alternating star contraction (large star, small star).

Each round hooks every node to the smallest neighbour it can see. Rounds grow with the logarithm
of the longest chain, the edge set never grows beyond twice its size, and no step gathers a
node's neighbours: only their minimum is aggregated, map-side first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirepulse.session import shared_dir

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
    smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.join(smallest, "u")
        .filter(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .filter("u <> v")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
    hooked = edges.join(smallest, "u").filter(F.col("v") != F.col("m"))
    return (
        hooked.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(smallest.select("u", F.col("m").alias("v")))
        .distinct()
    )


def _is_star_forest(edges: DataFrame) -> bool:
    """Every child has one parent and no parent is a child: one small aggregation."""
    roles = edges.select("u", F.lit(1).alias("child"), F.lit(0).alias("parent")).union(
        edges.select("v", F.lit(0), F.lit(1))
    )
    mixed = (
        roles.groupBy("u")
        .agg(F.sum("child").alias("parents"), F.max("parent").alias("is_parent"))
        .filter("parents > 1 or (parents = 1 and is_parent = 1)")
    )
    return mixed.isEmpty()


def connected_components(
    nodes: DataFrame, edges: DataFrame, max_rounds: int = MAX_ROUNDS
) -> DataFrame:
    """(id, component) for every row of ``nodes``; the component is its smallest id.

    ``edges`` has (src, dst). The driver only learns whether a round was the last; each round's
    edges go to the reliable checkpoint folder, which cuts the lineage and survives a lost
    executor. Nodes without edges never enter the loop.
    """
    shared_dir(nodes.sparkSession)
    current = (
        edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .filter("u <> v")
        .distinct()
        .checkpoint()
    )
    rounds = 0
    while not _is_star_forest(current):
        if rounds == max_rounds:
            raise RuntimeError(f"no fixed point after {max_rounds} rounds")
        current = _small_star(_large_star(current)).checkpoint()
        rounds += 1
    roots = current.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return (
        nodes.select("id")
        .join(roots, "id", "left")
        .select("id", F.coalesce("component", "id").alias("component"))
    )
