"""Connected components of a stored edge list, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def _outward(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to the smallest node around it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.where(F.col("v") > F.col("u")).join(least, "u")
            .select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct())


def _inward(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of these."""
    joined = edges.join(edges.groupBy("a").agg(F.min("b").alias("m")), "a")
    moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return moved.union(joined.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, name: str = "edges", rounds: int = 100) -> DataFrame:
    """(node, root): the smallest node of its component, for each node with an edge (a, b), a > b.

    Only minima per node are aggregated, never lists of neighbours; each round is written to the shared folder.
    The number of rounds grows with the logarithm of the size of the largest component.
    """
    edges = stored(edges.distinct(), name)
    before = None
    for _ in range(rounds):
        mark = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before or mark[0] == 0:
            break
        before = mark
        edges = stored(_inward(_outward(edges)), name)
    else:
        raise RuntimeError(f"components are not stable after {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).distinct()
