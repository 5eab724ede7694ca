"""Distributed union-find on edge tables by alternating large-star and small-star rounds.

Every round is two joins and two map-side-combined aggregates over edges; no vertex's neighbours are ever gathered. A round's
table is written and the one before it deleted. Nothing reaches the driver but two numbers per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from guidescape.runtime import checkpointed, release


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a vertex to the smallest vertex around it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a vertex, and the vertex itself, to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _digest(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]


def connected(edges: DataFrame) -> DataFrame:
    """(id, root): for every vertex with an edge to a smaller one, the smallest vertex it is connected with.

    ``edges``: columns a and b of one type, in any direction, repeats and loops allowed. Roots themselves have no row.
    """
    current = checkpointed(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = _digest(current)
    while before[0]:
        step = checkpointed(_small_star(_large_star(current)))
        release(current)
        current, now = step, _digest(step)
        if now == before:
            break
        before = now
    return current.select(F.col("a").alias("id"), F.col("b").alias("root"))
